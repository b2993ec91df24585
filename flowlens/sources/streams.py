"""Event stream sources and the table, stream and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators.contract import parse_events


def kafka_events(spark: SparkSession, servers: str, topic: str, per_batch: int = 2_000_000, **options: str) -> DataFrame:
    """Checked events of a Kafka topic, from the latest offsets; every query gets its own full copy."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
           .option("startingOffsets", "latest").option("maxOffsetsPerTrigger", per_batch).options(**options).load())
    return parse_events(raw.select("key", "value", "timestamp"))


def file_events(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", glob: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    """A folder of files as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def keyed_messages(events: DataFrame) -> DataFrame:
    """Events as (key, value) messages keyed by their source, so one source stays in order."""
    fields = [c for c in events.columns if c != "reject_reason"]
    return events.select(F.col("source_ip").alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def publish(events: DataFrame, servers: str, topic: str, checkpoint: str):
    """Streams events to a Kafka topic."""
    return (keyed_messages(events).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("topic", topic).option("checkpointLocation", checkpoint).start())


def publish_batch(events: DataFrame, servers: str, topic: str) -> None:
    keyed_messages(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def write_events_json(events: DataFrame, folder: str) -> None:
    """Event dataset as JSON lines."""
    events.write.mode("errorifexists").json(folder)


def write_report(report: DataFrame, folder: str) -> None:
    """A metric table (one or few rows) as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(folder)


def append_log(log: DataFrame, folder: str) -> None:
    """Appends audit rows, laid out by day and type so that later scans can skip."""
    day = F.to_date(F.timestamp_micros("ts_us"))
    log.withColumn("day", day).write.mode("append").partitionBy("day", "entry_type").parquet(folder)


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("day")


def append_jdbc(log: DataFrame, url: str, table: str, **options: str) -> None:
    """Appends audit rows to a database table."""
    log.write.format("jdbc").option("url", url).option("dbtable", table).options(**options).mode("append").save()
