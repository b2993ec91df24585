"""What the operators of this package share: table readers, lineage cuts and column helpers."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import cut_lineage, shared_folder, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, the SQL that defines its rows."""
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql.strip()
        return build
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: a result that several later steps read, safe against lost executors."""
    return cut_lineage(df)


def stored(df: DataFrame) -> DataFrame:
    """A small result as a Parquet table in the shared folder, removed when the JVM ends.

    Unlike a checkpoint it has a measured size, so the planner itself decides whether a join broadcasts it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def md5_unit(*parts: Column | str) -> Column:
    """A draw in [0, 1) that only depends on the parts: 13 hex digits of their md5 (SQL can state it)."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("null"))
                              for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of an id written as text; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(zlib.crc32(b"")))


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores added until no column has it (names compare without case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def prepare(spark: SparkSession, batch: int = 1 << 24) -> None:
    """Settings of the session for operators with several steps or with texts in Python.

    Arrow batches are bounded in bytes, so that many long texts do not meet in one; shuffle files go when the execution
    that wrote them ends, since what later steps need is checkpointed or stored.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, text: str = "text",
                    key: str = "doc_id", keep: Column | None = None) -> DataFrame:
    """``_key, _label, _text``: at most ``rows`` labelled documents, the same ones on every run.

    Ids whose labels are null or disagree are left out, and so is every id for which ``keep`` is false. The ids come
    first, so no text is moved for a row that is not in the sample.
    """
    named = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label"))
    if keep is not None:
        named = named.filter(keep)
    once = (named.filter(F.col("_key").isNotNull() & F.col("_label").isin(0, 1)).groupBy("_key")
            .agg(F.min("_label").alias("_label"), F.max("_label").alias("_top")).filter("_label = _top"))
    draw = F.md5(F.col("_key").cast("string").cast("binary"))
    picked = once.orderBy(draw, "_key").limit(rows).select("_key", "_label")
    found = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    # At most `rows` rows, so the broadcast is bounded.
    return found.join(F.broadcast(picked), F.col("_id") == F.col("_key")).select("_key", "_label", "_text")
