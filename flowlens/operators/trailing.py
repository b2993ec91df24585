"""Trailing time-window features per source host, one row per event."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.scan import running_sums, split_points
from flowlens.schemas import MICROS, WINDOW_SECONDS

FEATURES = (
    "event_rate", "byte_rate", "dest_port_entropy",
    "unique_dest_count", "avg_duration_ms", "same_dest_ratio",
)
ORDER = ("t", "kind", "seq")
HOT_ROWS = 4_000_000
#: Units of ``c * log2(c)``: exact to 3e-11, and a window may hold 2 * 10^7 events before a total leaves 64 bits.
UNIT = float(1 << 34)

Totals = Callable[[DataFrame, Sequence[str], Mapping[str, Column]], DataFrame]


def _changes(events: DataFrame, keys: Sequence[str], window_us: int, bucket_us: int) -> DataFrame:
    """Arrivals and expiries per time bucket; the last window of a bucket is copied into the next as history."""
    home = F.col("ts_us") - F.pmod("ts_us", F.lit(bucket_us))
    after = home + bucket_us

    def change(bucket: Column, time: Column, kind: int, own: bool) -> Column:
        return F.struct(bucket.alias("bucket"), time.alias("t"), F.lit(kind).alias("kind"),
                        F.lit(1 - 2 * kind).cast("bigint").alias("sign"), F.lit(own).alias("own"))

    arrival, expiry = F.col("ts_us"), F.col("ts_us") + window_us
    spans = F.when(expiry >= after, F.array(change(home, arrival, 0, True), change(after, arrival, 0, False),
                                            change(after, expiry, 1, False))
                   ).otherwise(F.array(change(home, arrival, 0, True), change(home, expiry, 1, False)))
    return events.select(
        *keys, "seq", "ts_us", "dst", "port", F.col("bytes").cast("bigint").alias("bytes"),
        F.col("duration_ms").cast("bigint").alias("duration_ms"), F.explode(spans).alias("change"),
    ).select(*keys, "seq", "ts_us", "dst", "port", "bytes", "duration_ms", "change.*")


def _sweep(changes: DataFrame, keys: Sequence[str], totals: Totals) -> DataFrame:
    """Running totals over the changes; ``totals`` says how a running total is computed."""
    group, sign = [*keys, "bucket"], F.col("sign")
    # In whole units, so that what an arrival adds its expiry takes away to the last bit.
    weight = lambda c: F.when(c > 0, F.round(c * F.log2(c.cast("double")) * UNIT).cast("bigint")).otherwise(0)
    has_port = F.col("port").isNotNull()
    keyed = changes.withColumn("_port", F.coalesce(F.col("port").cast("bigint"), F.lit(-1)))
    counted = totals(totals(keyed, [*group, "dst"], {"on_dest": sign}), [*group, "_port"], {"on_port": sign})
    steps = counted.select(
        "*",
        F.when((sign > 0) & (F.col("on_dest") == 1), 1)
        .when((sign < 0) & (F.col("on_dest") == 0), -1).otherwise(0).alias("d_dests"),
        F.when(has_port, weight(F.col("on_port")) - weight(F.col("on_port") - sign)).otherwise(0)
        .alias("d_weight"))
    return totals(steps, group, {
        "n": sign, "window_bytes": sign * F.col("bytes"), "window_duration": sign * F.col("duration_ms"),
        "dests": F.col("d_dests"), "ports": F.when(has_port, sign).otherwise(0), "weight": F.col("d_weight"),
    }).filter((F.col("kind") == 0) & F.col("own"))


def _within_group(df: DataFrame, group: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """One task per group: a sorted pass."""
    over = Window.partitionBy(*group).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select("*", *[F.sum(e).over(over).alias(name) for name, e in sums.items()])


def _across_groups(points: Sequence[str]) -> Totals:
    """Many tasks per group: the two-level scan over one order-preserving text key, which also splits equal times."""
    return lambda df, group, sums: running_sums(df, ["_at"], sums, group, points)


def trailing_features(
    events: DataFrame,
    window_us: int = int(WINDOW_SECONDS * MICROS),
    keys: Sequence[str] = ("src",),
    bucket_windows: int = 30,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Six features over the inclusive trailing window of each event's source.

    Input columns: ``keys``, ``seq`` (arrival order), ``ts_us``, ``dst``, ``port`` (nullable), ``bytes``,
    ``duration_ms``. An event exactly one window old still counts; events with the same time that arrive
    later do not.

    Every event is turned into an arrival and an expiry, and the features are running totals over those
    changes, so the work is linear in the events however full a window is. Time is cut into buckets of
    ``bucket_windows`` windows, so a busy source is many groups, all sharing one shuffle. A source that
    sends more than ``hot_rows`` events within one bucket is swept by many tasks instead of one; there are
    at most ``rows / hot_rows`` such groups.
    """
    keys = list(keys)
    bucket_us = window_us * bucket_windows
    home = (F.col("ts_us") - F.pmod("ts_us", F.lit(bucket_us))).alias("bucket")
    sizes = events.groupBy(*keys, home).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.filter(F.col("_n") > hot_rows).drop("_n")
    changes = _changes(events, keys, window_us, bucket_us)
    group = [*keys, "bucket"]
    if hot.isEmpty():
        swept = _sweep(changes.repartition(*group), keys, _within_group)
    else:
        cold = changes.join(hot, group, "left_anti").repartition(*group)
        text = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")
        warm = changes.join(hot, group, "left_semi").withColumn(
            "_at", F.concat(text("t"), F.col("kind").cast("string"), text("seq")))
        spread = _sweep(warm, keys, _across_groups(split_points(warm, "_at")))
        swept = _sweep(cold, keys, _within_group).unionByName(spread.drop("_at"))
    n, ports = F.col("n").cast("double"), F.col("ports").cast("double")
    span = F.lit(window_us / MICROS)
    entropy = F.when(F.col("ports") > 0, F.greatest(F.lit(0.0), F.log2(ports) - F.col("weight") / UNIT / ports))
    return swept.select(
        *keys, "seq", "ts_us", "n",
        (n / span).alias("event_rate"),
        (F.col("window_bytes").cast("double") / span).alias("byte_rate"),
        (F.coalesce(entropy, F.lit(0.0)) + F.lit(0.0)).alias("dest_port_entropy"),
        F.col("dests").cast("double").alias("unique_dest_count"),
        (F.col("window_duration").cast("double") / n).alias("avg_duration_ms"),
        (F.col("on_dest").cast("double") / n).alias("same_dest_ratio"),
    )
