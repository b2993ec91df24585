"""Named queries over the driver tables, each next to the SQL that defines its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql.strip()
        return build
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    # The files carry local times without a zone; they are read as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def flow(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as flows: user -> event type."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.pmod("user_id", F.lit(4)).alias("stream"),
        F.col("user_id").alias("src"), F.col("event_type").alias("dst"),
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("port"),
        F.floor(F.col("value") * 100).cast("bigint").alias("bytes"),
        F.pmod(F.col("event_id") * 37, F.lit(500)).alias("duration_ms"), "value")


# The same view for the SQL side.
FLOW = """flow as (
  select event_id as seq, epoch_us(ts) as ts_us, user_id % 4 as stream, user_id as src, event_type as dst,
         cast(regexp_extract(props, '[0-9]+') as integer) as port,
         cast(floor(value * 100) as bigint) as bytes, (event_id * 37) % 500 as duration_ms, value
  from events)"""

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def r6(column) -> "F.Column":
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Rounds the named double columns to six places."""
    return df.select(*[r6(c).alias(c) if c in columns else F.col(c) for c in df.columns])
