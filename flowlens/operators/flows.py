"""Bidirectional flow assembly from packets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.windows import anchored_windows
from flowlens.schemas import FLOW_ACTIVE_SECONDS, FLOW_IDLE_SECONDS, MICROS

_ENDS = ("end_a", "end_b", "protocol")


def endpoint(ip: str, port: str) -> Column:
    """Comparable (address, port) pair; a missing port sorts first."""
    return F.struct(F.col(ip).alias("ip"), F.coalesce(F.col(port), F.lit(-1)).alias("port"))


def assemble_flows(
    packets: DataFrame,
    keys: Sequence[str] = ("capture",),
    idle_us: int = int(FLOW_IDLE_SECONDS * MICROS),
    active_us: int = int(FLOW_ACTIVE_SECONDS * MICROS),
    segment_us: int | None = None,
) -> DataFrame:
    """One row per flow: the 5-tuple in either direction, cut after a gap over ``idle_us`` or past ``active_us``.

    Forward is the direction of the flow's first packet. Packets are first summed per flow and sender, so
    a flow that holds most of a capture reaches the last step as two rows.
    """
    keys = list(keys)
    a, b = endpoint("src_ip", "src_port"), endpoint("dst_ip", "dst_port")
    keyed = packets.withColumn("end_a", F.least(a, b)).withColumn("end_b", F.greatest(a, b))
    cut = anchored_windows(keyed, active_us, [*keys, *_ENDS], strict=True, idle_us=idle_us, segment_us=segment_us)
    sender = cut.groupBy(*keys, *_ENDS, "window_start", "src_ip", "src_port").agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum(F.col("length").cast("bigint")).alias("bytes"),
        F.min(F.struct("ts_us", "seq", "dst_ip", "dst_port")).alias("first"),
        F.max("ts_us").alias("last_us"))
    opener = F.min_by(F.struct("src_ip", "src_port", "packets", "bytes", F.col("first.dst_ip").alias("dst_ip"),
                               F.col("first.dst_port").alias("dst_port")),
                      F.struct("first.ts_us", "first.seq"))
    flow = sender.groupBy(*keys, *_ENDS, "window_start").agg(
        opener.alias("o"), F.sum("packets").alias("packets"), F.sum("bytes").alias("total_bytes"),
        F.min("first.ts_us").alias("start_us"), F.max("last_us").alias("end_us"))
    return with_ratios(flow.select(
        *keys,
        F.col("o.src_ip").alias("source_ip"), F.col("o.dst_ip").alias("dest_ip"),
        F.col("o.src_port").alias("source_port"), F.col("o.dst_port").alias("dest_port"),
        "protocol", "start_us", "end_us", "packets", "total_bytes",
        F.col("o.packets").alias("packets_fwd"), (F.col("packets") - F.col("o.packets")).alias("packets_bwd"),
        F.col("o.bytes").alias("bytes_fwd"), (F.col("total_bytes") - F.col("o.bytes")).alias("bytes_bwd"),
        F.bround((F.col("end_us") - F.col("start_us")).cast("double") / 1000.0).cast("bigint").alias("duration_ms")))


def with_ratios(flows: DataFrame) -> DataFrame:
    """Mean packet size and packet rate, zero where undefined."""
    n, ms = F.col("packets").cast("double"), F.col("duration_ms").cast("double")
    return (flows
            .withColumn("mean_packet_bytes", F.when(n > 0, F.col("total_bytes").cast("double") / n).otherwise(0.0))
            .withColumn("packet_rate_hz", F.when(ms > 0, n / (ms / 1000.0)).otherwise(0.0)))


def flow_rows(flows: DataFrame, category: Column, label: Column, raw_label: Column) -> DataFrame:
    """Assembled flows in the shared flow-row shape, with their own statistics as features."""
    names = {
        "flow_packets": "packets", "flow_bytes": "total_bytes", "packets_fwd": "packets_fwd",
        "packets_bwd": "packets_bwd", "bytes_fwd": "bytes_fwd", "bytes_bwd": "bytes_bwd",
        "duration_ms": "duration_ms", "mean_packet_bytes": "mean_packet_bytes", "packet_rate_hz": "packet_rate_hz",
    }
    pairs = [x for name, source in names.items() for x in (F.lit(name), F.col(source).cast("double"))]
    return flows.select(
        "source_ip", "dest_ip", "source_port", "dest_port", "protocol", "total_bytes", "duration_ms",
        raw_label.alias("raw_label"), category.alias("category"), label.alias("label"),
        F.lit(0).alias("difficulty"), F.create_map(*pairs).alias("features"), F.lit("real").alias("origin"),
        F.timestamp_micros("start_us").alias("ts"))
