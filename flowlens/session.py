"""Session settings shared by tests, bench and jobs."""

from __future__ import annotations

import pathlib
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "flowlens", master: str | None = None, **conf: str) -> SparkSession:
    """Builds (or reuses) a session with the settings every operator assumes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``; under a local master a scratch folder will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once per application, so that it need not lie on their path."""
    context = spark.sparkContext
    if getattr(context, "_flowlens_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/{package.name}", "zip",
                                  package.parent, package.name)
    context.addPyFile(archive)
    context._flowlens_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
