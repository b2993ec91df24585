"""The fast lane end to end as one query."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import decide
from flowlens.operators.trailing import trailing_features
from flowlens.plans.decisions import FLAG_STEPS, OUTCOME, WALK, allowlist
from flowlens.plans.registry import DAY, FLOW, HOUR, flow, query
from flowlens.session import cut_lineage

# The features again by self-join, then the decision rules of the decision queries.
LANE = f"""with recursive {FLOW},
w as (select e.seq, e.dst as mine, h.dst, h.port from flow e join flow h on h.src = e.src and h.seq <= e.seq
       and h.ts_us between e.ts_us - {DAY} and e.ts_us),
p as (select seq, -sum(q * log2(q)) as entropy from (
        select seq, count(*) / sum(count(*)) over (partition by seq) as q from w where port is not null group by seq, port) group by seq),
x as (select w.seq, count(*) * 0.6 + coalesce(max(p.entropy), 0) * 0.4
        - avg(case when dst = mine then 1.0 else 0.0 end) * 2.0 - 2.0 as logit from w left join p on p.seq = w.seq group by w.seq),
s as (select f.*, 1 / (1 + exp(-x.logit)) as p from flow f join x on x.seq = f.seq),
b as (select *, case when p >= 0.5 then 'flood' else 'benign' end as raw, case when p >= 0.5 then p else 1 - p end as confidence from s),
v as (select seq, ts_us, stream as shard, 'v' || seq as verdict_id, 'w' || src || '-' || (ts_us // {HOUR}) as window_id, 'bouncer' as tier,
 case when raw = 'flood' and confidence < 0.85 then 'uncertain' else raw end as label, confidence, '10.0.0.' || (src % 50) as target, src from b),
{FLAG_STEPS}, {WALK.format(cap=20, span=HOUR)}"""


@query("fast_lane_actions", LANE + OUTCOME + " select label, coalesce(action, 'rejected') as action, count(*) as n from d group by all")
def flagship(spark, sf):
    """Features of the trailing day, a fixed logistic score, verdict bands, policy, counts per label and action."""
    rows = flow(spark, sf)
    features = trailing_features(rows, DAY, ["src"], bucket_windows=8)
    logit = (F.col("n") * 0.6 + F.col("dest_port_entropy") * 0.4 - F.col("same_dest_ratio") * 2.0 - 2.0)
    scored = features.withColumn("p_flood", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))
    window = F.concat(F.lit("w"), F.col("src").cast("string"), F.lit("-"),
                      F.floor(F.col("ts_us") / HOUR).cast("bigint").cast("string"))
    verdicts = decide.fast_verdicts(scored).select(
        "seq", "ts_us", "tier", "label", "confidence", window.alias("window_id"),
        F.concat(F.lit("v"), "seq").alias("verdict_id"), F.pmod("src", F.lit(4)).alias("shard"),
        F.concat(F.lit("10.0.0."), F.pmod("src", F.lit(50)).cast("string")).alias("target"))
    # The decision steps read the verdicts several times; the features behind them are computed once.
    decided = decide.decide(cut_lineage(verdicts), allowlist(spark, sf), ["shard"], 20, HOUR)
    return decided.groupBy("label", F.coalesce("action", F.lit("rejected")).alias("action")).agg(
        F.count(F.lit(1)).alias("n"))
