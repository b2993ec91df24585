"""Feature drift: PSI, KS, the drift report, promotion and the model version table.

Baseline and live values come in long form: (feature, value).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.scan import exact_quantiles, running_sums, split_points
from flowlens.schemas import PSI_BREACH

FLOOR = 1e-6
#: Values per sample up to which the KS p-value is counted exactly.
EXACT_UP_TO = 10_000


def _folded(baseline: DataFrame, live: DataFrame) -> DataFrame:
    """Distinct values per feature with their count on either side; copies fold before any join."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    sides = baseline.select("feature", "value", one.alias("b"), none.alias("l")).unionByName(
        live.select("feature", "value", none.alias("b"), one.alias("l")))
    return sides.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.sum("b").alias("b"), F.sum("l").alias("l"))


def _sizes(folded: DataFrame) -> DataFrame:
    """Sample sizes of the baseline's features."""
    return folded.groupBy("feature").agg(F.sum("b").alias("n_b"), F.sum("l").alias("n_l")).filter(F.col("n_b") > 0)


def psi(baseline: DataFrame, live: DataFrame, bins: int = 10) -> DataFrame:
    """Population stability index per baseline feature; 0 when either side is empty."""
    probs = {f"q{i}": i / bins for i in range(1, bins)}
    edges = exact_quantiles(baseline, "value", probs, ["feature"]).select(
        "feature", F.array_sort(F.array_distinct(F.array(*probs))).alias("edges"))
    folded = _folded(baseline, live)
    binned = folded.join(edges, "feature").groupBy(
        "feature", F.size(F.filter("edges", lambda e: e <= F.col("value"))).alias("bin")).agg(
        F.sum("b").alias("b"), F.sum("l").alias("l"))
    joined = binned.join(_sizes(folded), "feature")
    e = F.greatest(F.col("b").cast("double") / F.col("n_b"), F.lit(FLOOR))
    a = F.when(F.col("n_l") > 0, F.greatest(F.col("l").cast("double") / F.nullif(F.col("n_l"), F.lit(0)), F.lit(FLOOR)))
    return joined.groupBy("feature").agg(F.coalesce(F.sum((a - e) * F.log(a / e)), F.lit(0.0)).alias("psi"))


def exact_ks_tail(n: int, m: int, gap: int) -> float:
    """Chance that two samples of one distribution, ``n`` and ``m`` values, are ``gap / (n m)`` or more apart.

    The order of the pooled values is a path on a lattice, every path equally likely. Diagonal by diagonal, each place keeps the
    share of the paths to it that have stayed nearer: a place is reached from its two neighbours on the diagonal before.
    """
    if gap <= 0:
        return 1.0
    i = np.arange(n + 1)
    near = np.zeros(n + 1)
    near[0] = 1.0
    for k in range(1, n + m + 1):
        j = k - i
        from_below = np.concatenate([[0.0], near[:-1]]) * (i / k)
        inside = (j >= 0) & (j <= m) & (np.abs(i * m - j * n) < gap)
        near = np.where(inside, from_below + near * (np.maximum(j, 0) / k), 0.0)
    return min(1.0, max(0.0, 1.0 - float(near[n])))


def _exact_tail(n: pd.Series, m: pd.Series, ks: pd.Series) -> pd.Series:
    return pd.Series([exact_ks_tail(int(a), int(b), round(d * a * b)) for a, b, d in zip(n, m, ks, strict=True)], dtype="float64")


def ks(baseline: DataFrame, live: DataFrame, exact_up_to: int = EXACT_UP_TO) -> DataFrame:
    """Two-sample KS statistic and its p-value per baseline feature.

    The p-value is exact (to 1e-12) where neither sample has more than ``exact_up_to`` values, by the asymptotic series beyond.
    """
    folded = _folded(baseline, live)
    both = baseline.select("value").unionByName(live.select("value"))
    upto = running_sums(folded, ["value"], {"b_upto": F.col("b"), "l_upto": F.col("l")}, ["feature"],
                        points=split_points(both, "value"))
    part = lambda c, n: F.col(c).cast("double") / F.nullif(F.col(n), F.lit(0).cast("bigint"))
    out = upto.join(_sizes(folded), "feature").groupBy("feature").agg(
        F.coalesce(F.max(F.abs(part("b_upto", "n_b") - part("l_upto", "n_l"))), F.lit(0.0)).alias("ks"),
        F.max("n_b").cast("double").alias("_n"), F.max("n_l").cast("double").alias("_m"))
    z = F.col("ks") * F.sqrt(F.col("_n") * F.col("_m") / (F.col("_n") + F.col("_m")))
    # Terms beyond the twentieth are below 1e-13 from z = 0.2 on, and under it the tail is 1.
    series = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0.0), lambda total, k: total + F.when(
        k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * F.col("z") * F.col("z")))
    tail = F.when(F.col("z") < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    if exact_up_to > 0:
        few = F.greatest("_n", "_m") <= exact_up_to
        # The other rows pass a pair of empty samples, whatever their sizes.
        tail = F.when(few, F.pandas_udf(_exact_tail, "double")(*[F.when(few, F.col(c)).otherwise(F.lit(0.0)) for c in ("_n", "_m", "ks")])).otherwise(tail)
    return out.withColumn("z", z).select(
        "feature", "ks", F.coalesce(F.when(F.col("_m") > 0, tail), F.lit(1.0)).alias("p_value"))


def drift_report(scores: DataFrame, live_precision: float, live_recall: float, baseline_precision: float,
                 corrections: DataFrame, sessions: DataFrame, since_us: int) -> DataFrame:
    """One row: per-feature scores, breach, accuracy change, feedback counts and the action."""
    breach = F.coalesce(F.bool_or(F.col("psi") > PSI_BREACH), F.lit(False))
    newer = lambda df: df.agg(F.count_if(F.col("ts_us") > since_us)).scalar()
    return scores.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", "psi")))).alias("scores"),
        F.max("psi").alias("max_psi"), breach.alias("breached"),
    ).select(
        "scores", "max_psi", "breached",
        F.lit(live_precision).alias("precision"), F.lit(live_recall).alias("recall"),
        F.lit(live_precision - baseline_precision).alias("vs_baseline"),
        newer(corrections).alias("corrections"), newer(sessions).alias("decoy_sessions"),
        F.when(F.col("breached"), "retrain_triggered").otherwise("none").alias("action"))


def promotion(current: DataFrame, candidate: DataFrame, metric: str = "f1") -> DataFrame:
    """Per component: promote when there is no current model or the candidate is strictly better."""
    c = current.select("component", F.coalesce(F.col(metric), F.lit(0.0)).alias("current"))
    n = candidate.select("component", F.coalesce(F.col(metric), F.lit(0.0)).alias("candidate"))
    joined = n.join(c, "component", "left")
    return joined.withColumn("promote", F.col("current").isNull() | (F.col("candidate") > F.col("current")))


def current_versions(versions: DataFrame, promotions: DataFrame) -> DataFrame:
    """The version each component points at: its latest promotion of a registered version."""
    known = promotions.join(versions.select("component", "version_id"), ["component", "version_id"], "left_semi")
    latest = known.groupBy("component").agg(F.max_by("version_id", F.col("promoted_us")).alias("version_id"))
    return latest.join(versions, ["component", "version_id"])
