"""Queries: distributions, metric tables, thresholds, calibration, drift, promotion."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import drift, evaluate
from flowlens.plans.registry import FLOW, HOUR, flow, query, rounded

# value / 500 plays the score; 'error' is the attack class, 'purchase' an abstention of the predictor.
SCORED = f"""{FLOW}, s as (select *, value / 500 as score, case when dst = 'error' then 1 else 0 end as y,
 case when dst = 'error' then 'flood' when dst = 'click' then 'port_scan' else 'benign' end as truth,
 case when value >= 150 then 'flood' when value >= 60 then 'uncertain' when port % 3 = 0 then 'port_scan' else 'benign' end as predicted
 from flow)"""


def scored(spark, sf):
    return (flow(spark, sf).withColumn("score", F.col("value") / 500)
            .withColumn("y", F.when(F.col("dst") == "error", 1).otherwise(0))
            .withColumn("truth", F.when(F.col("dst") == "error", "flood").when(F.col("dst") == "click", "port_scan").otherwise("benign"))
            .withColumn("predicted", F.when(F.col("value") >= 150, "flood").when(F.col("value") >= 60, "uncertain")
                        .when(F.pmod("port", F.lit(3)) == 0, "port_scan").otherwise("benign")))


@query("class_medians", f"""with {SCORED}, l as (
 select 'bytes' as feature, y, cast(bytes as double) as v from s union all select 'port', y, port from s
 union all select 'duration_ms', y, duration_ms from s),
m as (select feature, quantile_cont(v, 0.5) filter (y = 1) as a, quantile_cont(v, 0.5) filter (y = 0) as b from l group by feature)
select feature, round(a, 6) as attack_median, round(b, 6) as benign_median, round(a / nullif(b, 0), 6) as ratio from m""")
def class_medians(spark, sf):
    return rounded(evaluate.class_medians(scored(spark, sf), ["bytes", "port", "duration_ms"], "y", 1, 0),
                   "attack_median", "benign_median", "ratio")


@query("score_stats", f"""with {SCORED} select dst, count(*) as n, round(quantile_cont(score, 0.5), 6) as median,
 round(quantile_cont(score, 0.05), 6) as p05, round(quantile_cont(score, 0.95), 6) as p95, round(avg(score), 6) as mean
 from s group by dst""")
def score_stats(spark, sf):
    return rounded(evaluate.score_stats(scored(spark, sf), "score", ["dst"]), "median", "p05", "p95", "mean")


@query("window_scores", f"""with {SCORED} select ts_us - ts_us % {HOUR} as window_start, round(max(score), 6) as score_max,
 round(avg(score), 9) as score_mean, count(*) as n_events from s group by 1""")
def window_scores(spark, sf):
    rows = scored(spark, sf).withColumn("window_start", F.col("ts_us") - F.pmod("ts_us", F.lit(HOUR)))
    out = evaluate.window_scores(rows, ["window_start"], "score")
    return out.withColumn("score_max", F.round("score_max", 6)).withColumn("score_mean", F.round("score_mean", 9))


LABELS = ["benign", "flood", "port_scan"]


@query("confusion", f"""with {SCORED}, g as (select a.l as truth, b.l as predicted from
 (select unnest(['benign', 'flood', 'port_scan']) as l) a, (select unnest(['benign', 'flood', 'port_scan']) as l union select predicted from s) b),
c as (select truth, predicted, count(*) as n from s group by all)
select g.truth, g.predicted, coalesce(c.n, 0) as n from g left join c on c.truth = g.truth and c.predicted = g.predicted
where c.n is not null or g.predicted in ('benign', 'flood', 'port_scan')""")
def confusion(spark, sf):
    return evaluate.confusion(scored(spark, sf), "truth", "predicted", LABELS)


PER = f"""{SCORED}, per as (select l.label,
 count(*) filter (truth = l.label and predicted = l.label) as tp, count(*) filter (truth <> l.label and predicted = l.label) as fp,
 count(*) filter (truth = l.label and predicted <> l.label) as fn
 from s, (select unnest(['benign', 'flood', 'port_scan']) as label) l group by l.label),
m as (select label, tp + fn as support, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0), 0) as precision,
 coalesce(tp / nullif(tp + fn, 0), 0) as recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1 from per)"""


@query("class_metrics", f"with {PER} select label, support, tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from m")
def class_metrics(spark, sf):
    return rounded(evaluate.class_metrics(scored(spark, sf), "truth", "predicted", LABELS), "precision", "recall", "f1")


@query("prf_report", f"""with {PER} select round(avg(precision), 6) as precision_macro, round(avg(recall), 6) as recall_macro,
 round(avg(f1), 6) as f1_macro, round(max(precision) filter (label = 'flood'), 6) as precision,
 round(max(recall) filter (label = 'flood'), 6) as recall, round(max(f1) filter (label = 'flood'), 6) as f1,
 round((select avg(case when truth = predicted then 1.0 else 0.0 end) from s), 6) as accuracy from m""")
def prf_report(spark, sf):
    out = evaluate.report(scored(spark, sf), "truth", "predicted", LABELS, "flood")
    return rounded(out, *out.columns)


AUC = f"""{SCORED}, b as (select score, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg from s group by score),
r as (select *, sum(pos) over (order by score) as pos_upto, sum(neg) over (order by score) as neg_upto,
      sum(pos) over () as p, sum(neg) over () as n from b),
curve as (select score as threshold, p - pos_upto + pos as tp, n - neg_upto + neg as fp, pos_upto - pos as fn,
      coalesce(2 * (p - pos_upto + pos) / nullif(2 * (p - pos_upto + pos) + n - neg_upto + neg + pos_upto - pos, 0), 0) as f1 from r),
area as (select sum(pos * (neg_upto - neg / 2)) / (max(p) * max(n)) as auc from r),
best as (select f1, threshold from curve order by f1 desc, threshold limit 1)"""


@query("auc", f"with {AUC} select cast(max(p) as bigint) as positives, cast(max(n) as bigint) as negatives, round((select auc from area), 6) as auc from r")
def auc(spark, sf):
    return rounded(evaluate.auc(scored(spark, sf), "score", "y"), "auc")


@query("auc_by_stream", f"""with {SCORED}, b as (select stream, score, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg from s group by all),
r as (select *, sum(neg) over (partition by stream order by score) as neg_upto from b)
select stream, cast(sum(pos) as bigint) as positives, cast(sum(neg) as bigint) as negatives,
 round(sum(pos * (neg_upto - neg / 2)) / (sum(pos) * sum(neg)), 6) as auc from r group by stream""")
def auc_by_stream(spark, sf):
    return rounded(evaluate.auc(scored(spark, sf), "score", "y", ["stream"]), "auc")


@query("threshold_curve", f"""with {AUC} select threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn,
 round(f1, 6) as f1 from curve""")
def threshold_curve(spark, sf):
    return rounded(evaluate.threshold_curve(scored(spark, sf), "score", "y"), "f1")


@query("best_f1_threshold", f"with {AUC} select round(f1, 6) as best_f1, round(threshold, 6) as best_threshold from best")
def best_f1_threshold(spark, sf):
    return rounded(evaluate.best_threshold(scored(spark, sf), "score", "y"), "best_f1", "best_threshold")


@query("threshold_report", f"""with {AUC}, q as (select case when y = 1 then 'attack' else 'benign' end as t,
 case when score >= 0.1 then 'attack' else 'benign' end as p from s),
per as (select l.label, count(*) filter (t = l.label and p = l.label) as tp, count(*) filter (t <> l.label and p = l.label) as fp,
 count(*) filter (t = l.label and p <> l.label) as fn from q, (select unnest(['benign', 'attack']) as label) l group by l.label),
m as (select label, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall,
 coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1 from per)
select round(avg(precision), 6) as precision_macro, round(avg(recall), 6) as recall_macro, round(avg(f1), 6) as f1_macro,
 round(max(precision) filter (label = 'attack'), 6) as precision, round(max(recall) filter (label = 'attack'), 6) as recall,
 round(max(f1) filter (label = 'attack'), 6) as f1, round((select avg(case when t = p then 1.0 else 0.0 end) from q), 6) as accuracy,
 round((select auc from area), 6) as auc, round((select f1 from best), 6) as best_f1,
 round((select threshold from best), 6) as best_threshold from m""")
def threshold_report(spark, sf):
    out = evaluate.threshold_report(scored(spark, sf), "score", "y", 0.1)
    return rounded(out, *out.columns)


@query("prediction_breakdown", f"""with {SCORED} select count(*) as n, count(*) filter (predicted = 'uncertain') as abstained,
 count(*) filter (predicted = 'flood') as predicted_positive, round(avg(y), 6) as positive_share,
 round(greatest(avg(y), 1 - avg(y)), 6) as majority_accuracy from s""")
def prediction_breakdown(spark, sf):
    return rounded(evaluate.prediction_breakdown(scored(spark, sf), "truth", "predicted", "flood"),
                   "positive_share", "majority_accuracy")


@query("predictions_by_label", f"""with {SCORED}, g as (select *, case when predicted = 'uncertain' then 'port_scan' else predicted end as folded from s)
select truth as label, count(*) as n, count(*) filter (predicted = 'uncertain') as abstained,
 round(count(*) filter (predicted = 'uncertain') / count(*), 6) as abstained_share, count(*) filter (predicted = truth) as hits,
 count(*) filter (folded = truth) as hits_folded, count(*) filter (folded = 'port_scan') as predicted_as_folded from g group by truth""")
def predictions_by_label(spark, sf):
    return rounded(evaluate.predictions_by_label(scored(spark, sf), "truth", "predicted", "port_scan"), "abstained_share")


FOLDED_LABELS = ("benign", "port_scan", "flood")


@query("folded_report", f"""with {SCORED}, g as (select truth, case when predicted = 'uncertain' then 'port_scan' else predicted end as p from s),
m as (select l.label, count(*) filter (truth = label and p = label) as tp, count(*) filter (truth <> label and p = label) as fp,
        count(*) filter (truth = label and p <> label) as fn from g, (select unnest({list(FOLDED_LABELS)}) as label) l group by l.label)
select label, tp + fn as support, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision,
 round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall,
 round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from m""")
def folded_report(spark, sf):
    """Precision, recall and F1 with gray verdicts counted as the class they lean to."""
    rows = scored(spark, sf).withColumn("folded", evaluate.fold_abstentions(F.col("predicted"), "port_scan"))
    out = evaluate.class_metrics(rows, "truth", "folded", FOLDED_LABELS).select("label", "support", "precision", "recall", "f1")
    return rounded(out, "precision", "recall", "f1")


@query("latency_report", f"""with {FLOW}, c as (select duration_ms + value as latency,
 case when port % 50 = 0 then 500 when port % 20 = 0 then 404 else 200 end as status from flow)
select count(*) as requests, round(avg(latency), 6) as mean, round(max(latency), 6) as max,
 count(*) filter (status between 200 and 299) as n_2xx, count(*) filter (status between 400 and 499) as n_4xx,
 count(*) filter (status between 500 and 599) as n_5xx, round(count(*) filter (status <> 200) * 100.0 / count(*), 6) as error_rate_pct,
 round(count(*) / 60.0, 6) as per_second, round(quantile_cont(latency, 0.5), 6) as p50, round(quantile_cont(latency, 0.95), 6) as p95,
 round(quantile_cont(latency, 0.99), 6) as p99 from c""")
def latency_report(spark, sf):
    calls = flow(spark, sf).select(
        (F.col("duration_ms") + F.col("value")).alias("latency"),
        F.when(F.pmod("port", F.lit(50)) == 0, 500).when(F.pmod("port", F.lit(20)) == 0, 404).otherwise(200).alias("status"))
    out = evaluate.latency_report(calls, "latency", "status", 60.0)
    return rounded(out, "mean", "max", "error_rate_pct", "per_second", "p50", "p95", "p99")


TEMPERATURES = [0.25 * i for i in range(1, 17)]


@query("temperature_grid", f"""with {SCORED}, z as (select y, score * 8 - 2 as logit from s),
t as (select cast(unnest({TEMPERATURES}) as double) as temperature),
p as (select t.temperature, y, 1 / (1 + exp(-logit / t.temperature)) as p from z, t)
select temperature, round(avg(-ln(least(1.0, greatest(1e-12, case when y = 1 then p else 1 - p end)))), 6) as nll from p group by temperature""")
def temperature_grid(spark, sf):
    rows = scored(spark, sf).withColumn("logit", F.col("score") * 8 - 2)
    return rounded(evaluate.temperature_grid(rows, "logit", "y", TEMPERATURES), "nll")


@query("goal_gate", f"""with {SCORED}, g as (select stream, count(*) as rows, count(distinct port) as vectors,
 avg(case when truth = predicted then 1.0 else 0.0 end) as f1, max(score) as ceiling from s group by stream)
select stream, rows, vectors, f1 >= 0.85 as goal_met, ceiling >= 0.85 as goal_reachable, vectors >= 100 and rows >= 500 as reportable from g""")
def goal_gate(spark, sf):
    m = scored(spark, sf).groupBy("stream").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("port").alias("vectors"),
        F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("f1"), F.max("score").alias("ceiling"))
    return evaluate.goal_gate(m).select("stream", "rows", "vectors", "goal_met", "goal_reachable", "reportable")


@query("metric_delta", f"""with {SCORED}, m as (select stream, seq % 2 as half, avg(score) as a, avg(bytes) as b from s group by all)
select c.stream, round(c.a - o.a, 6) as delta_a, round(c.b - o.b, 6) as delta_b from m c join m o on o.stream = c.stream and c.half = 1 and o.half = 0""")
def metric_delta(spark, sf):
    m = scored(spark, sf).withColumn("half", F.pmod("seq", F.lit(2))).groupBy("stream", "half").agg(
        F.avg("score").alias("a"), F.avg("bytes").alias("b"))
    return rounded(evaluate.delta(m.filter("half = 1"), m.filter("half = 0"), ["a", "b"], ["stream"]), "delta_a", "delta_b")


# --- drift: first half of the month against the second ---

MIDDLE = 1705276800000000
HALVES = f"""{FLOW}, l as (
 select ts_us < {MIDDLE} as base, 'bytes' as feature, cast(bytes as double) as v from flow union all
 select ts_us < {MIDDLE}, 'port', port from flow union all
 select ts_us < {MIDDLE}, 'stream', case when ts_us < {MIDDLE} then 1 else 1 end from flow union all
 select ts_us < {MIDDLE}, 'shifted', case when ts_us < {MIDDLE} then value else value * 1.5 + 10 end from flow union all
 select true, 'gone', value from flow where ts_us < {MIDDLE})"""


def halves(spark, sf):
    f = flow(spark, sf)
    first = F.col("ts_us") < MIDDLE
    wide = f.select("ts_us", "bytes", "port", F.lit(1).alias("stream"),
                    F.when(first, F.col("value")).otherwise(F.col("value") * 1.5 + 10).alias("shifted"),
                    F.when(first, F.col("value")).alias("gone"))
    long = evaluate.long_form(wide, ["bytes", "port", "stream", "shifted", "gone"], ["ts_us"]).filter("value is not null")
    return long.filter(first), long.filter(~first)


PSI = f"""{HALVES}, q as (select feature, list_sort(list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) as edges
 from l where base group by feature),
b as (select l.feature, len([e for e in q.edges if e <= l.v]) as bin, count(*) filter (base) as b, count(*) filter (not base) as n
 from l join q on q.feature = l.feature group by all),
t as (select feature, count(*) filter (base) as nb, count(*) filter (not base) as nl from l group by feature),
psi as (select b.feature, coalesce(sum(case when nl > 0 then (greatest(n / nl, 1e-6) - greatest(b / nb, 1e-6))
 * ln(greatest(n / nl, 1e-6) / greatest(b / nb, 1e-6)) end), 0) as psi from b join t on t.feature = b.feature group by b.feature)"""


@query("psi_by_feature", f"with {PSI} select feature, round(psi, 6) + 0.0 as psi from psi")
def psi_by_feature(spark, sf):
    return rounded(drift.psi(*halves(spark, sf)), "psi")


@query("ks_by_feature", f"""with {HALVES}, c as (select feature, v, count(*) filter (base) as b, count(*) filter (not base) as n from l group by all),
u as (select feature, sum(b) over w / sum(b) over (partition by feature) as fb,
 sum(n) over w / nullif(sum(n) over (partition by feature), 0) as fl, sum(b) over (partition by feature) as nb,
 sum(n) over (partition by feature) as nl from c window w as (partition by feature order by v)),
k as (select feature, coalesce(max(abs(fb - fl)), 0)::double as ks, max(nb)::double as nb, max(nl)::double as nl from u group by feature),
z as (select *, ks * sqrt(nb * nl / nullif(nb + nl, 0)) as z from k)
select feature, round(ks, 6) as ks, round(case when coalesce(nl, 0) = 0 or z < 0.2 then 1.0::double else least(1.0, greatest(0.0,
  list_sum(list_transform(range(1, 21), lambda k: (case when k % 2 = 1 then 2.0 else -2.0 end)::double * exp(-2.0::double * k * k * z * z))))) end, 6) + 0.0 as p_value
from z""")
def ks_by_feature(spark, sf):
    """The p-value by its asymptotic series, whatever the sizes; the exact one of small samples has a test of its own."""
    return rounded(drift.ks(*halves(spark, sf), exact_up_to=0), "ks", "p_value")


@query("drift_report", f"""with {PSI} select round(max(psi), 6) as max_psi, bool_or(psi > 0.2) as breached,
 0.9 as precision, 0.8 as recall, round(0.9 - 0.95, 6) as vs_baseline,
 (select count(*) from flow where dst = 'view' and ts_us > {MIDDLE}) as corrections,
 (select count(*) from flow where dst = 'signup' and ts_us > {MIDDLE}) as decoy_sessions,
 case when bool_or(psi > 0.2) then 'retrain_triggered' else 'none' end as action from psi""".replace(
    "0.9 as precision, 0.8 as recall", "cast(0.9 as double) as precision, cast(0.8 as double) as recall").replace(
    "round(0.9 - 0.95, 6)", "round(cast(0.9 as double) - cast(0.95 as double), 6)"))
def drift_report(spark, sf):
    f = flow(spark, sf)
    out = drift.drift_report(drift.psi(*halves(spark, sf)), 0.9, 0.8, 0.95, f.filter("dst = 'view'"),
                             f.filter("dst = 'signup'"), MIDDLE)
    return rounded(out.drop("scores"), "max_psi", "precision", "recall", "vs_baseline")


@query("promote_decision", f"""with {SCORED}, m as (select cast(stream as varchar) as component, seq % 2 as half, avg(score) as f1 from s group by all),
c as (select * from m where half = 0 and component <> '3')
select n.component, round(n.f1, 6) as candidate, round(c.f1, 6) as current, c.f1 is null or n.f1 > c.f1 as promote
from (select * from m where half = 1) n left join c on c.component = n.component""")
def promote_decision(spark, sf):
    m = scored(spark, sf).withColumn("half", F.pmod("seq", F.lit(2))).groupBy(
        F.col("stream").cast("string").alias("component"), "half").agg(F.avg("score").alias("f1"))
    out = drift.promotion(m.filter("half = 0 and component <> '3'"), m.filter("half = 1"))
    return rounded(out, "candidate", "current")


@query("current_versions", f"""with {FLOW}, v as (select cast(stream as varchar) as component, 'v' || seq as version_id, value from flow where dst = 'click'),
p as (select cast(stream as varchar) as component, 'v' || (seq - seq % 5) as version_id, ts_us from flow where dst = 'view'),
k as (select p.* from p where exists (select 1 from v where v.component = p.component and v.version_id = p.version_id)),
l as (select component, arg_max(version_id, ts_us) as version_id from k group by component)
select v.component, v.version_id, round(v.value, 6) as f1 from l join v on v.component = l.component and v.version_id = l.version_id""")
def current_versions(spark, sf):
    f = flow(spark, sf).withColumn("component", F.col("stream").cast("string"))
    versions = f.filter("dst = 'click'").select("component", F.concat(F.lit("v"), "seq").alias("version_id"), F.col("value").alias("f1"))
    moves = f.filter("dst = 'view'").select(
        "component", F.concat(F.lit("v"), F.col("seq") - F.pmod("seq", F.lit(5))).alias("version_id"), F.col("ts_us").alias("promoted_us"))
    return rounded(drift.current_versions(versions, moves).select("component", "version_id", "f1"), "f1")


