"""Metric tables: distributions, confusion, precision and recall, AUC, thresholds, gates.

Everything ordered works on distinct scores with counts and the two-level scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.scan import exact_quantiles, running_sums, split_points

GOAL_F1 = 0.85
MIN_VECTORS = 100
MIN_ROWS = 500


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division with 0 where the denominator is 0."""
    n, d = numerator.cast("double"), denominator.cast("double")
    return F.when(d != 0, n / d).otherwise(F.lit(0.0))


def long_form(rows: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Wide feature columns as (feature, value) rows."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return rows.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.feature", "p.value")


def class_medians(rows: DataFrame, features: Sequence[str], label: str, attack, benign) -> DataFrame:
    """Exact median of every feature per class and their ratio (NULL when the benign median is 0)."""
    values = long_form(rows.filter(F.col(label).isin(attack, benign)), features, [label])
    medians = exact_quantiles(values, "value", {"median": 0.5}, ["feature", label])
    out = medians.groupBy("feature").agg(
        F.max(F.when(F.col(label) == attack, F.col("median"))).alias("attack_median"),
        F.max(F.when(F.col(label) == benign, F.col("median"))).alias("benign_median"))
    return out.withColumn("ratio", F.when(F.col("benign_median") != 0, F.col("attack_median") / F.col("benign_median")))


def score_stats(rows: DataFrame, score: str, keys: Sequence[str]) -> DataFrame:
    """Count, median, 5th and 95th percentile and mean of the score."""
    points = exact_quantiles(rows, score, {"median": 0.5, "p05": 0.05, "p95": 0.95}, keys)
    means = rows.groupBy(*keys).agg(F.avg(score).alias("mean"))
    return points.join(means, list(keys))


def window_scores(rows: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Event scores lifted to their window, by maximum and by mean."""
    return rows.groupBy(*keys).agg(
        F.max(score).alias("score_max"), F.avg(score).alias("score_mean"), F.count(F.lit(1)).alias("n_events"))


def confusion(rows: DataFrame, truth: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Counts over the full label grid, plus labels that were predicted but are not in it."""
    counted = rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    values = F.array(*[F.lit(v) for v in labels])
    grid = (rows.sparkSession.range(1).select(F.explode(values).alias("truth"))
            .select("truth", F.explode(values).alias("predicted"), F.lit(0).cast("bigint").alias("n")))
    return (counted.filter(F.col("truth").isin(*labels)).unionByName(grid)
            .groupBy("truth", "predicted").agg(F.sum("n").alias("n")))


def class_metrics(rows: DataFrame, truth: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Support, precision, recall and F1 per label; 0 where undefined."""
    counted = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tallies = [F.struct(
        F.lit(v).alias("label"),
        F.coalesce(F.sum(F.when((F.col("t") == v) & (F.col("p") == v), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when((F.col("t") != v) & (F.col("p") == v), F.col("n"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when((F.col("t") == v) & (F.col("p") != v), F.col("n"))), F.lit(0)).alias("fn"),
    ) for v in labels]
    per = counted.agg(F.array(*tallies).alias("a")).select(F.explode("a").alias("a")).select("a.*")
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn"))
    return per.select("label", (F.col("tp") + F.col("fn")).alias("support"), "tp", "fp", "fn",
                      p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def report(rows: DataFrame, truth: str, predicted: str, labels: Sequence[str], positive: str) -> DataFrame:
    """Accuracy, macro averages over ``labels`` and the positive class's figures in one row."""
    per = class_metrics(rows, truth, predicted, labels)
    row = per.agg(
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        F.max(F.when(F.col("label") == positive, F.col("precision"))).alias("precision"),
        F.max(F.when(F.col("label") == positive, F.col("recall"))).alias("recall"),
        F.max(F.when(F.col("label") == positive, F.col("f1"))).alias("f1"))
    accuracy = rows.agg(ratio(F.count_if(F.col(truth) == F.col(predicted)), F.count(F.lit(1))))
    return row.withColumn("accuracy", accuracy.scalar())


def _by_score(rows: DataFrame, score: str, y: str, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys, F.col(score).cast("double").alias("s")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def _ranked(rows: DataFrame, score: str, y: str, keys: Sequence[str], points: Sequence | None) -> DataFrame:
    """Distinct scores with their class counts, running counts from below and the totals."""
    keys = list(keys)
    counted = _by_score(rows, score, y, keys)
    if points is None:
        points = split_points(rows, F.col(score).cast("double"))
    ranked = running_sums(counted, ["s"], {"pos_upto": F.col("pos"), "neg_upto": F.col("neg")}, keys, points)
    totals = counted.groupBy(*keys).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    if keys:
        ranked = ranked.join(totals, keys)
    else:
        ranked = (ranked.withColumn("all_pos", totals.select("all_pos").scalar())
                  .withColumn("all_neg", totals.select("all_neg").scalar()))
    tp = F.col("all_pos") - F.col("pos_upto") + F.col("pos")
    fp = F.col("all_neg") - F.col("neg_upto") + F.col("neg")
    return ranked.withColumn("tp", tp).withColumn("fp", fp).withColumn("fn", F.col("all_pos") - F.col("tp")).withColumn(
        "f1", ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")))


def _area() -> Column:
    """Aggregate over ranked scores: AUC with ties at half weight, NULL when one class is missing."""
    won = F.sum(F.col("pos") * (F.col("neg_upto") * 2 - F.col("neg")).cast("double") / F.lit(2.0))
    p, n = F.max("all_pos").cast("double"), F.max("all_neg").cast("double")
    return F.when((p > 0) & (n > 0), won / (p * n))


def _best() -> Column:
    """Aggregate: highest F1; the lowest threshold wins a tie."""
    return F.max(F.struct(F.col("f1"), (-F.col("s")).alias("down")))


def auc(rows: DataFrame, score: str, y: str, keys: Sequence[str] = (), points: Sequence | None = None) -> DataFrame:
    """ROC AUC with ties at half weight; NULL when one class is missing."""
    return _ranked(rows, score, y, keys, points).groupBy(*keys).agg(
        F.max("all_pos").alias("positives"), F.max("all_neg").alias("negatives"), _area().alias("auc"))


def threshold_curve(rows: DataFrame, score: str, y: str, keys: Sequence[str] = (), points: Sequence | None = None) -> DataFrame:
    """tp, fp, fn and F1 of ``score >= threshold`` for every distinct score."""
    return _ranked(rows, score, y, keys, points).select(
        *keys, F.col("s").alias("threshold"), "tp", "fp", "fn", "f1")


def best_threshold(rows: DataFrame, score: str, y: str, keys: Sequence[str] = (), points: Sequence | None = None) -> DataFrame:
    """Highest F1 over all thresholds; the lowest threshold wins a tie, none is given when F1 is 0."""
    best = _ranked(rows, score, y, keys, points).groupBy(*keys).agg(_best().alias("b"))
    return best.select(*keys, F.col("b.f1").alias("best_f1"), F.when(F.col("b.f1") > 0, -F.col("b.down")).alias("best_threshold"))


def threshold_report(rows: DataFrame, score: str, y: str, threshold: float, keys: Sequence[str] = (),
                     points: Sequence | None = None) -> DataFrame:
    """Metrics at a fixed threshold next to AUC and the best reachable F1, all from one table of distinct scores."""
    at = F.col("s") >= threshold
    count = lambda c, hit: F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0))
    t = _ranked(rows, score, y, keys, points).groupBy(*keys).agg(
        count("pos", at).alias("tp"), count("neg", at).alias("fp"), count("pos", ~at).alias("fn"), count("neg", ~at).alias("tn"),
        _area().alias("auc"), _best().alias("b"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall, f1 = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tp * 2, tp * 2 + fp + fn)
    other = (ratio(tn, tn + fn), ratio(tn, tn + fp), ratio(tn * 2, tn * 2 + fp + fn))
    return t.select(
        *keys, ((precision + other[0]) / 2).alias("precision_macro"), ((recall + other[1]) / 2).alias("recall_macro"),
        ((f1 + other[2]) / 2).alias("f1_macro"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), "auc", F.col("b.f1").alias("best_f1"),
        F.when(F.col("b.f1") > 0, -F.col("b.down")).alias("best_threshold"))


def prediction_breakdown(rows: DataFrame, truth: str, predicted: str, positive: str) -> DataFrame:
    """Predictions by label with abstentions, and the majority-class baseline."""
    share = F.avg((F.col(truth) == positive).cast("double"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(predicted) == "uncertain").alias("abstained"),
        F.count_if(F.col(predicted) == positive).alias("predicted_positive"),
        share.alias("positive_share"), F.greatest(share, 1 - share).alias("majority_accuracy"))


def fold_abstentions(predicted: Column, into: str, abstention: str = "uncertain") -> Column:
    """Gray verdicts counted as the class they lean to; how many there were is ``predictions_by_label``'s to say."""
    return F.when(predicted == abstention, F.lit(into)).otherwise(predicted)


def predictions_by_label(rows: DataFrame, truth: str, predicted: str, into: str, abstention: str = "uncertain") -> DataFrame:
    """Per true label: rows, abstentions and their share, hits before and after abstentions are folded into a class."""
    p, folded = F.col(predicted), fold_abstentions(F.col(predicted), into, abstention)
    return rows.groupBy(F.col(truth).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(p == abstention).alias("abstained"),
        ratio(F.count_if(p == abstention), F.count(F.lit(1))).alias("abstained_share"),
        F.count_if(p == F.col(truth)).alias("hits"), F.count_if(folded == F.col(truth)).alias("hits_folded"),
        F.count_if(folded == into).alias("predicted_as_folded"))


def latency_report(calls: DataFrame, latency: str, status: str, wall_seconds: float) -> DataFrame:
    """Latency percentiles, throughput and status classes of a request log."""
    points = exact_quantiles(calls, latency, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    total = F.count(F.lit(1))
    summary = calls.agg(
        total.alias("requests"), F.avg(latency).alias("mean"), F.max(latency).alias("max"),
        F.count_if(F.col(status).between(200, 299)).alias("n_2xx"),
        F.count_if(F.col(status).between(400, 499)).alias("n_4xx"),
        F.count_if(F.col(status).between(500, 599)).alias("n_5xx"),
        (F.count_if(F.col(status) != 200).cast("double") * 100.0 / total).alias("error_rate_pct"),
        (total.cast("double") / F.lit(max(wall_seconds, 0.001))).alias("per_second"))
    for name in ("p50", "p95", "p99"):
        summary = summary.withColumn(name, points.select(name).scalar())
    return summary


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def log_loss(probability: Column, y: Column) -> Column:
    """Aggregate: mean negative log-likelihood, clipped at 1e-12."""
    hit = F.when(y == 1, probability).otherwise(F.lit(1.0) - probability)
    return F.avg(-F.log(F.least(F.lit(1.0), F.greatest(F.lit(1e-12), hit))))


def temperature_grid(rows: DataFrame, logit: str, y: str, temperatures: Sequence[float]) -> DataFrame:
    """Log-likelihood of ``sigmoid(logit / T)`` for every T, in one pass over the rows."""
    losses = rows.agg(*[log_loss(sigmoid(F.col(logit) / F.lit(float(t))), F.col(y)).alias(f"t{i}")
                        for i, t in enumerate(temperatures)])
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("nll"))
                      for i, t in enumerate(temperatures)])
    return losses.select(F.explode(pairs).alias("p")).select("p.*")


def fit_temperature(rows: DataFrame, logit: str, y: str, low: float = 0.05, high: float = 10.0,
                    steps: int = 24, rounds: int = 4) -> float:
    """T in [low, high] with the smallest loss: a grid that narrows around its best point."""
    least, most = low, high
    for _ in range(rounds):
        grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
        best = temperature_grid(rows, logit, y, grid).orderBy("nll", "temperature").first()["temperature"]
        width = (high - low) / (steps - 1)
        low, high = max(least, best - width), min(most, best + width)
    return best


def goal_gate(metrics: DataFrame, f1: str = "f1", ceiling: str = "ceiling", vectors: str = "vectors",
              rows: str = "rows") -> DataFrame:
    """Is the goal met, could it be met at all, and is there enough data to say so."""
    return (metrics
            .withColumn("goal_met", F.col(f1) >= GOAL_F1)
            .withColumn("goal_reachable", F.col(ceiling) >= GOAL_F1)
            .withColumn("reportable", (F.col(vectors) >= MIN_VECTORS) & (F.col(rows) >= MIN_ROWS)))


def delta(candidate: DataFrame, baseline: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Candidate minus baseline per metric column."""
    b = baseline.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns])
    return candidate.join(b, list(keys)).select(
        *keys, *[(F.col(c) - F.col(f"_b_{c}")).alias(f"delta_{c}") for c in columns])
