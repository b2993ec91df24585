import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowlens.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    built = session("flowlens-tests", "local[8]", spark__sql__shuffle__partitions="8",
                    spark__ui__enabled="false", spark__driver__memory="8g",
                    spark__sql__streaming__noDataMicroBatches__enabled="true")
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()
