"""Deterministic samples, splits, hold-outs and quotas.

Positions and ranks come from the two-level scan, so a file or class that holds most of the rows is
numbered by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.scan import cell_count, row_positions


def chronological(df: DataFrame, ts: str = "ts_us", seq: str = "seq") -> DataFrame:
    """Capture order, rows without a time last."""
    return df.orderBy(F.col(ts).asc_nulls_last(), F.col(seq).asc())


def with_size(df: DataFrame, keys: Sequence[str], name: str = "size") -> DataFrame:
    """Rows of the key as a column, by aggregate and join (a window would gather the key)."""
    if not keys:
        return df.withColumn(name, df.agg(F.count(F.lit(1))).scalar())
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return df.join(sizes, list(keys))


def prefix(df: DataFrame, order: Sequence[str], count: int, keys: Sequence[str] = ()) -> DataFrame:
    """First ``count`` rows of every key."""
    return row_positions(df, order, keys, "_at").filter(F.col("_at") < count).drop("_at")


def stride(df: DataFrame, order: Sequence[str], every: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose 0-based position in the key is a multiple of ``every``."""
    if every < 1:
        raise ValueError("stride must be >= 1")
    return row_positions(df, order, keys, "position").filter(F.pmod("position", F.lit(every)) == 0)


def budget_stride(df: DataFrame, order: Sequence[str], budget: int, keys: Sequence[str] = ()) -> DataFrame:
    """Stride ``max(1, rows // budget)`` per key, stopped after ``budget`` rows."""
    sized = with_size(row_positions(df, order, keys, "position"), keys, "_size")
    step = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("_size") / budget).cast("bigint"))
    return sized.filter((F.pmod("position", step) == 0) & ((F.col("position") / step) < budget)).drop("_size")


def _picked(position: Column, size: Column, target: int | Column, linspace: bool) -> Column:
    """Is ``position`` one of the evenly spaced indices? Uses the same float products as the definition."""
    target = F.lit(target) if isinstance(target, int) else target
    p, n, k = position.cast("double"), size.cast("double"), target.cast("double")
    if linspace:
        step = F.when(k > 1, (n - 1) / (k - 1)).otherwise(F.lit(0.0))
        index = lambda i: F.when((i == k - 1) & (k > 1), n - 1).otherwise(F.floor(i * step))
    else:
        step = n / k
        index = lambda i: F.least(n - 1, F.floor(i * step))
    guess = F.when(step > 0, F.floor(p / step)).otherwise(F.lit(0.0))
    tries = [guess - 1, guess, guess + 1, guess + 2]
    hit = F.lit(False)
    for i in tries:
        hit = hit | ((i >= 0) & (i < k) & (index(i) == p))
    return (k >= n) | hit


def even_sample(df: DataFrame, order: Sequence[str], target: int, keys: Sequence[str] = (),
                linspace: bool = False) -> DataFrame:
    """``target`` evenly spaced rows per key: ``int(i * n / k)`` or a truncated linspace that hits the last row."""
    placed = with_size(row_positions(df, order, keys, "position"), keys, "_size")
    return placed.filter(_picked(F.col("position"), F.col("_size"), target, linspace)).drop("_size")


def hash_rank(df: DataFrame, seed: int, identity: str, keys: Sequence[str], name: str = "hash_rank") -> DataFrame:
    """0-based rank in the order of ``sha2(seed:id)`` per key; hash prefixes are even cells, 16 or more per reducer."""
    hashed = df.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(identity).cast("string")), 256))
    digits = math.ceil(math.log(16 * cell_count(df), 16))
    cell = F.conv(F.substring("_h", 1, digits), 16, 10).cast("bigint")
    return row_positions(hashed, ["_h"], keys, name, cell=cell).drop("_h")


def class_split(df: DataFrame, keys: Sequence[str], identity: str, seed: int = 42, ratio: float = 0.67) -> DataFrame:
    """Adds ``side`` ('train'/'test'): per key the first ``floor(ratio * n)`` rows in hash order train."""
    ranked = with_size(hash_rank(df, seed, identity, keys, "_rank"), keys, "_size")
    train = F.col("_rank") < F.floor(F.col("_size") * F.lit(ratio))
    return ranked.withColumn("side", F.when(train, "train").otherwise("test")).drop("_rank", "_size")


def group_holdout(df: DataFrame, class_col: str, group_col: str, order: Sequence[str],
                  seed: int = 42, ratio: float = 0.67) -> DataFrame:
    """Whole groups to one side per class; a class with one group holds out every third row.

    ``strategy`` says which rule applied.
    """
    groups = df.select(class_col, group_col).distinct().withColumn(
        "_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group_col).cast("string")), 256))
    ranked = groups.withColumn("_rank", F.row_number().over(Window.partitionBy(class_col).orderBy("_h")))
    sizes = groups.groupBy(class_col).agg(F.count(F.lit(1)).alias("_groups"))
    keep = F.greatest(F.lit(1), F.least(F.col("_groups") - 1, F.bround(F.col("_groups") * F.lit(ratio)).cast("bigint")))
    sided = ranked.join(sizes, class_col).select(
        class_col, group_col, "_groups", F.when(F.col("_rank") <= keep, "train").otherwise("test").alias("_side"))
    placed = row_positions(df, order, [class_col], "_at").join(sided, [class_col, group_col])
    single = F.col("_groups") == 1
    return placed.withColumn(
        "side", F.when(single, F.when(F.pmod("_at", F.lit(3)) == 2, "test").otherwise("train"))
        .otherwise(F.col("_side"))
    ).withColumn("strategy", F.when(single, "stride_within_group").otherwise("group_holdout")).drop(
        "_at", "_groups", "_side")


def leave_one_out(folds: DataFrame, fold: str = "day") -> DataFrame:
    """Pairs (held out fold, training fold); built from the short list of folds, never from the rows."""
    ids = folds.select(fold).distinct()
    numbered = ids.groupBy().agg(F.sort_array(F.collect_set(fold)).alias("all"))
    return numbered.select(F.explode("all").alias("test_fold"), "all").select(
        "test_fold", F.explode(F.filter("all", lambda d: d != F.col("test_fold"))).alias("train_fold"))


def balance_down(df: DataFrame, class_col: str, order: Sequence[str], cap: int | None = None) -> DataFrame:
    """Evenly thins every class to the smallest class's size, and to ``cap`` if given."""
    placed = with_size(row_positions(df, order, [class_col], "position"), [class_col], "_size")
    least = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("_c")).agg(F.min("_c").alias("_target"))
    placed = placed.withColumn("_target", least.scalar())
    if cap:
        placed = placed.withColumn("_target", F.least("_target", F.lit(cap)))
    return placed.filter(_picked(F.col("position"), F.col("_size"), F.col("_target"), False)).drop("_size", "_target")


def quota(df: DataFrame, keys: Sequence[str], order: Sequence[str], count: int) -> DataFrame:
    """First ``count`` rows per key; the planner keeps only that many per key before the shuffle."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= count).drop("_rn")


def census(df: DataFrame, label: str, top: int | None = None) -> DataFrame:
    """Label counts, most frequent first, ties by label."""
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(label))
    return counted.limit(top) if top else counted


def support_gate(df: DataFrame, group: str, class_col: str, classes: Sequence[str], minimum: int) -> DataFrame:
    """Per group: rows of every class and whether all of them reach ``minimum``; thin groups are reported."""
    counts = df.groupBy(group).agg(*[F.count_if(F.col(class_col) == c).alias(f"n_{c}") for c in classes])
    enough = F.lit(True)
    for c in classes:
        enough = enough & (F.col(f"n_{c}") >= minimum)
    return counts.withColumn("usable", enough)


def replay_clock(df: DataFrame, order: Sequence[str], start_us: int, step_us: int = 20_000,
                 keys: Sequence[str] = ()) -> DataFrame:
    """Synthetic event time ``start + i * step`` in the given order."""
    return row_positions(df, order, keys, "_at").withColumn(
        "ts_us", F.lit(start_us) + F.col("_at") * step_us).drop("_at")
