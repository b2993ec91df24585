"""The package reaches the Python workers of a session started in another folder."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as entry
from flowlens.session import session
spark = session("elsewhere", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false")
rows = entry.queries()["audit_latest"](spark, "/root/testdata/sf0.001").collect()
print("ROWS", len(rows))
"""


def test_python_workers_find_the_package_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_ENV_LOADED", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 20" in done.stdout, done.stderr[-2000:]
