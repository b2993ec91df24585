"""Ordered operators that never put one key's whole history into one task.

A running total, a neighbour lookup or an exact quantile needs an order. Each is done in two levels: the
leading order column is cut into cells of about equal size, the cell is part of the partition key, and a
small table (one row per key and cell) carries the state from cell to cell. The result does not depend
on where the cuts fall, only the balance does.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cell_count(df: DataFrame) -> int:
    """Cells follow the session's shuffle width without a bound, so a hot key spreads over every reducer."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_points(df: DataFrame, value: str | Column, cells: int | None = None) -> list:
    """Ascending cut values of about equal weight, from a sketch (numbers) or a small random sample (text).

    The driver sees the cuts, or at most forty sampled texts per cell.
    """
    cells = cells or cell_count(df)
    probs = [i / cells for i in range(1, cells)]
    column = F.col(value) if isinstance(value, str) else value
    narrow = df.select(column.alias("v"))
    if isinstance(narrow.schema[0].dataType, T.StringType):
        sample = sorted(r["v"] for r in narrow.filter("v is not null").orderBy(F.rand(7)).limit(40 * cells).collect())
        return sorted({sample[int(p * len(sample))] for p in probs}) if sample else []
    row = df.agg(F.percentile_approx(column, probs, 20 * cells).alias("cuts")).first()
    return sorted(set(row["cuts"] or []))


def cell_of(value: Column, points: Sequence) -> Column:
    """Cell number of ``value``: how many cut values are <= it (a balanced comparison tree)."""

    def branch(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(points[middle]), branch(low, middle)).otherwise(branch(middle + 1, high))

    return branch(0, len(points))


def _with_cell(df: DataFrame, lead: str, points: Sequence | None, cell: Column | None) -> DataFrame:
    if cell is None:
        cell = cell_of(F.col(lead), split_points(df, lead) if points is None else points)
    return df.withColumn("_cell", cell)


def running_sums(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, Column],
    keys: Sequence[str] = (),
    points: Sequence | None = None,
    cell: Column | None = None,
) -> DataFrame:
    """Adds inclusive running totals along ``order`` (ascending) inside ``keys``.

    ``order`` must be a total order and its first column must decide the cell.
    """
    keys = list(keys)
    df = _with_cell(df, order[0], points, cell)
    local = (Window.partitionBy(*keys, "_cell").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = df.select("*", *[F.sum(e).over(local).alias(f"_in_{n}") for n, e in sums.items()])
    totals = df.groupBy(*keys, "_cell").agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    before = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_cell")
              .rowsBetween(Window.unboundedPreceding, -1))
    carried = totals.select(
        *keys, "_cell",
        *[F.sum(n).over(before).alias(f"_before_{n}") for n in sums],
    )
    joined = within.join(carried, [*keys, "_cell"])
    kept = [c for c in df.columns if c != "_cell"]
    return joined.select(
        *kept,
        *[(F.col(f"_in_{n}") + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def row_positions(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "position",
                  points: Sequence | None = None, cell: Column | None = None) -> DataFrame:
    """0-based position of every row in its key."""
    out = running_sums(df, order, {name: F.lit(1).cast("bigint")}, keys, points, cell)
    return out.withColumn(name, F.col(name) - 1)


def neighbours(
    df: DataFrame,
    order: Sequence[str],
    take: Mapping[str, str],
    keys: Sequence[str] = (),
    forward: bool = False,
    points: Sequence | None = None,
    cell: Column | None = None,
) -> DataFrame:
    """Adds the previous (or next) row's values: ``take`` maps new column -> source column."""
    keys = list(keys)
    df = _with_cell(df, order[0], points, cell)
    packed = F.struct(*[F.col(s).alias(n) for n, s in take.items()])
    local = Window.partitionBy(*keys, "_cell").orderBy(*order)
    step = F.lead if forward else F.lag
    within = df.withColumn("_near", step(packed).over(local))
    edge = (F.min_by if forward else F.max_by)(packed, F.struct(*order))
    edges = df.groupBy(*keys, "_cell").agg(edge.alias("_edge"))
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_cell")
    edges = edges.select(*keys, "_cell", step("_edge").over(across).alias("_edge"))
    joined = within.join(edges, [*keys, "_cell"])
    near = F.coalesce(F.col("_near"), F.col("_edge"))
    kept = [c for c in df.columns if c != "_cell"]
    return joined.select(*kept, *[near[n].alias(n) for n in take])


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    keys: Sequence[str] = (),
    points: Sequence | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per key, one column per name in ``probs``.

    Equal values are folded into a count before the shuffle and the wanted ranks are found in the
    distributed running count, so no task ever holds one key's values.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if points is None:
        points = split_points(rows, "_v")
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_sums(counts, ["_v"], {"_upto": F.col("_c")}, keys, points)
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranked.join(totals, keys) if keys else ranked.withColumn("_n", totals.scalar())
    position = {n: F.lit(float(p)) * (F.col("_n") - 1).cast("double") for n, p in probs.items()}
    wanted = F.array(*[f(pos).cast("bigint") for pos in position.values() for f in (F.floor, F.ceil)])
    hits = ranked.filter(F.exists(
        wanted, lambda r: (r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto"))))
    covers = lambda r: (r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto"))
    picks = []
    for name, pos in position.items():
        picks.append(F.max(F.when(covers(F.floor(pos)), F.col("_v"))).alias(f"_lo_{name}"))
        picks.append(F.max(F.when(covers(F.ceil(pos)), F.col("_v"))).alias(f"_hi_{name}"))
    ends = hits.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)
    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1).cast("double")
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    return ends.select(*keys, F.col("_n").alias("n"), *out)


def carry_forward(
    df: DataFrame,
    order: Sequence[str],
    take: Mapping[str, str],
    present: Column,
    keys: Sequence[str] = (),
    points: Sequence | None = None,
    cell: Column | None = None,
) -> DataFrame:
    """As-of lookup: adds the values of the latest row at or before this one where ``present`` holds."""
    keys = list(keys)
    df = _with_cell(df, order[0], points, cell)
    packed = F.when(present, F.struct(*[F.col(s).alias(n) for n, s in take.items()]))
    local = (Window.partitionBy(*keys, "_cell").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = df.withColumn("_seen", F.last(packed, ignorenulls=True).over(local))
    edges = df.filter(present).groupBy(*keys, "_cell").agg(F.max_by(packed, F.struct(*order)).alias("_edge"))
    # Every cell needs the state it starts with, also the ones that set none themselves.
    cells = df.groupBy(*keys, "_cell").agg(F.lit(None).alias("_none")).drop("_none")
    before = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_cell")
              .rowsBetween(Window.unboundedPreceding, -1))
    entering = cells.join(edges, [*keys, "_cell"], "left").select(
        *keys, "_cell", F.last("_edge", ignorenulls=True).over(before).alias("_edge"))
    joined = within.join(entering, [*keys, "_cell"])
    seen = F.coalesce(F.col("_seen"), F.col("_edge"))
    kept = [c for c in df.columns if c != "_cell"]
    return joined.select(*kept, *[seen[n].alias(n) for n in take])
