"""Queries: verdict bands, policy table, caps, blocks, corrections, audit log, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import audit, decide
from flowlens.plans.registry import DAY, FLOW, HOUR, flow, query, rounded, table

# A verdict per event: confidence value/60 (over 1 is malformed), hourly window per stream, fixed label by type.
VERDICTS = f"""{FLOW}, v as (select seq, ts_us, stream as shard, 'v' || seq as verdict_id,
 'w' || stream || '-' || (ts_us // {HOUR}) as window_id,
 case dst when 'error' then 'bouncer' when 'click' then 'detective' when 'view' then 'decoy' when 'signup' then 'bouncer' else 'spy' end as tier,
 case when dst = 'view' then 'decoy_interaction' when port % 7 = 0 then 'benign' when port % 11 = 0 then 'uncertain'
      when port % 2 = 0 then 'flood' else 'port_scan' end as label,
 case when dst = 'view' then 1.0 else value / 60 end as confidence, '10.0.0.' || (src % 50) as target, src
 from flow)"""


def verdicts(spark, sf):
    f = flow(spark, sf)
    window = F.concat(F.lit("w"), "stream", F.lit("-"), F.floor(F.col("ts_us") / HOUR).cast("bigint").cast("string"))
    tier = (F.when(F.col("dst").isin("error", "signup"), "bouncer").when(F.col("dst") == "click", "detective")
            .when(F.col("dst") == "view", "decoy").otherwise("spy"))
    label = (F.when(F.col("dst") == "view", "decoy_interaction").when(F.pmod("port", F.lit(7)) == 0, "benign")
             .when(F.pmod("port", F.lit(11)) == 0, "uncertain").when(F.pmod("port", F.lit(2)) == 0, "flood").otherwise("port_scan"))
    return f.select(
        "seq", "ts_us", F.col("stream").alias("shard"), F.concat(F.lit("v"), "seq").alias("verdict_id"),
        window.alias("window_id"), tier.alias("tier"), label.alias("label"),
        F.when(F.col("dst") == "view", 1.0).otherwise(F.col("value") / 60).alias("confidence"),
        F.concat(F.lit("10.0.0."), F.pmod("src", F.lit(50)).cast("string")).alias("target"), "src")


def allowlist(spark, sf):
    """Targets of the first five users."""
    f = flow(spark, sf)
    return f.filter(F.col("src") < 5).select(F.concat(F.lit("10.0.0."), F.pmod("src", F.lit(50)).cast("string")).alias("ip")).distinct()


FLAG_STEPS = """al as (select distinct target as ip from v where src < 5),
f as (select v.*, target in (select ip from al) as on_allowlist,
 tier <> 'spy' and confidence between 0 and 1 as valid from v),
a as (select *, valid and label not in ('benign', 'uncertain') and confidence >= 0.85 as acts from f),
r as (select *, coalesce(bool_or(acts) over (partition by window_id order by seq rows between unbounded preceding and 1 preceding), false) as resolved from a)"""
FLAGS = f"{VERDICTS}, {FLAG_STEPS}"

ACTION = """case when not valid then null when resolved then 'dry_run' when label in ('benign', 'uncertain') or confidence < 0.85 then 'dry_run'
 when on_allowlist then 'allowlist_exempt' when {trip} then 'throttled' else 'block' end"""
REASON = """case when not valid then null when resolved then 'window_already_resolved' when label = 'uncertain' then 'gray_zone'
 when label = 'benign' or confidence < 0.5 then 'below_gray_zone' when confidence < 0.85 then 'gray_zone'
 when on_allowlist then 'on_allowlist' when {trip} then 'circuit_breaker_exceeded' else 'confidence_above_threshold' end"""
PLAIN = f"{FLAGS}, d as (select *, {ACTION.format(trip='false')} as action, {REASON.format(trip='false')} as reason from r)"


def flagged(spark, sf):
    return decide.first_action(decide.flag_allowlist(verdicts(spark, sf), allowlist(spark, sf)))


def decided(spark, sf):
    """Without the cap: a pure table."""
    return decide.policy(flagged(spark, sf)).withColumn("reason", F.try_element_at("reason_codes", F.lit(1)))


@query("label_bands", f"""with {FLOW}, p as (select seq, least(value / 60, 1.0::double) as p from flow),
q as (select seq, case when p >= 0.5 then 'flood' else 'benign' end as raw, case when p >= 0.5 then p else 1 - p end as confidence from p)
select seq, case when raw = 'flood' and confidence >= 0.5 and confidence < 0.85 then 'uncertain' else raw end as label,
 round(confidence, 6) as confidence, 'bouncer' as tier from q""")
def label_bands(spark, sf):
    f = flow(spark, sf).select("seq", F.least(F.col("value") / 60, F.lit(1.0)).alias("p_flood"))
    return rounded(decide.fast_verdicts(f).select("seq", "label", "confidence", "tier"), "confidence")


@query("policy_decisions", f"with {PLAIN} select seq, action, reason, case when action = 'block' then 900 end as ttl_seconds from d where action is not null")
def policy_decisions(spark, sf):
    return decided(spark, sf).filter("action is not null").select("seq", "action", "reason", "ttl_seconds")


@query("policy_rejects", f"with {PLAIN} select seq, verdict_id, 'malformed_input' as reason from d where action is null")
def policy_rejects(spark, sf):
    return decide.rejects(decided(spark, sf).drop("reason")).select("seq", "verdict_id", "reason")


@query("first_action_per_window", f"with {PLAIN} select window_id, seq, action from d where acts and not resolved")
def first_action_per_window(spark, sf):
    return decided(spark, sf).filter(F.col("action").isin("block", "throttled", "allowlist_exempt")).select("window_id", "seq", "action")


@query("allowlist_flags", f"with {PLAIN} select seq, target, on_allowlist from d")
def allowlist_flags(spark, sf):
    return decide.flag_allowlist(verdicts(spark, sf), allowlist(spark, sf)).select("seq", "target", "on_allowlist")


@query("review_queue", f"with {PLAIN} select seq, verdict_id from d where reason = 'gray_zone'")
def review_queue(spark, sf):
    return decide.notify(decided(spark, sf)).select("seq", "verdict_id")


# Cap 3 per 12 hours and shard. The state is the list of the times taken so far.
CAP, SPAN = 3, 12 * HOUR
WALK = """c as (select shard, seq, ts_us, row_number() over (partition by shard order by ts_us, seq) as rn from r
      where acts and not resolved and not on_allowlist),
walk(shard, rn, seq, taken, trip) as (
  select shard, rn, seq, [ts_us], false from c where rn = 1
  union all
  select c.shard, c.rn, c.seq,
    case when len([t for t in w.taken if c.ts_us - t <= {span}]) >= {cap} then [t for t in w.taken if c.ts_us - t <= {span}]
         else list_append([t for t in w.taken if c.ts_us - t <= {span}], c.ts_us) end,
    len([t for t in w.taken if c.ts_us - t <= {span}]) >= {cap}
  from walk w join c on c.shard = w.shard and c.rn = w.rn + 1)"""
CAPPED = f"with recursive {FLAGS}, {WALK.format(cap=CAP, span=SPAN)}"


@query("action_cap", CAPPED + " select shard, seq, trip as breaker_tripped from walk")
def action_cap(spark, sf):
    wants = flagged(spark, sf).filter(
        decide.acts() & ~F.col("already_resolved") & ~F.col("on_allowlist")).select("shard", "ts_us", "seq")
    return decide.action_cap(wants, ["shard"], CAP, SPAN).select("shard", "seq", "breaker_tripped")


OUTCOME = f""", t as (select r.*, coalesce(w.trip, false) as trip from r left join walk w on w.seq = r.seq),
d as (select *, {ACTION.format(trip='trip')} as action, {REASON.format(trip='trip')} as reason from t)"""
FULL = CAPPED + OUTCOME


def full(spark, sf):
    return decide.decide(verdicts(spark, sf), allowlist(spark, sf), ["shard"], CAP, SPAN).withColumn(
        "reason", F.try_element_at("reason_codes", F.lit(1)))


@query("decision_pipeline", FULL + " select seq, action, reason from d")
def decision_pipeline(spark, sf):
    return full(spark, sf).select("seq", "action", "reason")


@query("action_counts", FULL + " select coalesce(action, 'rejected') as action, count(*) as n from d group by 1")
def action_counts(spark, sf):
    return full(spark, sf).groupBy(F.coalesce("action", F.lit("rejected")).alias("action")).agg(F.count(F.lit(1)).alias("n"))


# --- blocks; a purchase of the target's first user reverses ---

TTL = 6 * HOUR
BLOCKS = f"""{PLAIN}, ev as (select target, ts_us, seq, 0 as kind from d where action = 'block' union all
 select '10.0.0.' || (src % 50), ts_us, seq, 1 from flow where dst = 'purchase'),
nx as (select *, lead(ts_us) over w as nt, lead(kind) over w as nk from ev window w as (partition by target order by ts_us, kind, seq)),
bl as (select target, seq, ts_us as start_us, least(ts_us + {TTL}, coalesce(nt, ts_us + {TTL})) as end_us,
 coalesce(nk = 1 and nt < ts_us + {TTL}, false) as reversed from nx where kind = 0)"""


def undo(spark, sf):
    return flow(spark, sf).filter("dst = 'purchase'").select(
        F.concat(F.lit("10.0.0."), F.pmod("src", F.lit(50)).cast("string")).alias("target"), "ts_us", "seq")


def intervals(spark, sf):
    return decide.block_intervals(decided(spark, sf).filter("action = 'block'"), undo(spark, sf), TTL)


@query("block_intervals", f"with {BLOCKS} select * from bl")
def block_intervals(spark, sf):
    return intervals(spark, sf)


@query("blocked_asof", f"""with {BLOCKS} select d.seq, d.target, exists (select 1 from bl where bl.target = d.target
 and d.ts_us >= bl.start_us and d.ts_us < bl.end_us) as blocked from d""")
def blocked_asof(spark, sf):
    asks = verdicts(spark, sf).select("seq", "target", "ts_us")
    return decide.blocked_at(asks, intervals(spark, sf), TTL).select("seq", "target", "blocked")


@query("active_blocks", f"with {BLOCKS} select target, seq, start_us, end_us from bl where start_us <= 1705276800000000 and 1705276800000000 < end_us")
def active_blocks(spark, sf):
    return decide.active_blocks(intervals(spark, sf), 1705276800000000).select("target", "seq", "start_us", "end_us")


@query("corrections_applied", f"""with {PLAIN}, co as (select 'c' || seq as correction_id, '10.0.0.' || (src % 50) as target, ts_us, seq,
 port % 2 = 0 as fp from flow where dst = 'purchase'),
x as (select co.*, (select arg_max('d' || d.seq, (d.ts_us, d.seq)) from d where d.target = co.target and d.action is not null and d.ts_us <= co.ts_us) as last_decision from co)
select correction_id, target, last_decision, case when fp then 'false_positive' else 'true_positive' end as verdict_was,
 case when last_decision is null then 'no_decision_for_target' end as error from x""")
def corrections_applied(spark, sf):
    made = decided(spark, sf).filter("action is not null").withColumn("decision_id", F.concat(F.lit("d"), "seq"))
    asked = flow(spark, sf).filter("dst = 'purchase'").select(
        F.concat(F.lit("c"), "seq").alias("correction_id"),
        F.concat(F.lit("10.0.0."), F.pmod("src", F.lit(50)).cast("string")).alias("target"), "ts_us", "seq",
        (F.pmod("port", F.lit(2)) == 0).alias("is_false_positive"))
    return decide.resolve_corrections(asked, made).select("correction_id", "target", "last_decision", "verdict_was", "error")


@query("decoy_path", f"""with {FLOW}, s as (select 's' || seq as window_id, seq, '10.0.0.' || (src % 50) as target from flow where dst = 'view'),
al as (select distinct '10.0.0.' || (src % 50) as ip from flow where src < 5)
select window_id, 'decoy' as tier, 'decoy_interaction' as label, cast(1.0 as double) as confidence,
 case when target in (select ip from al) then 'allowlist_exempt' else 'block' end as action from s""")
def decoy_path(spark, sf):
    sessions = flow(spark, sf).filter("dst = 'view'").select(
        F.concat(F.lit("s"), "seq").alias("session_id"), "seq", "ts_us", F.concat(F.lit("v"), "seq").alias("verdict_id"),
        F.concat(F.lit("10.0.0."), F.pmod("src", F.lit(50)).cast("string")).alias("target"))
    ready = decide.first_action(decide.flag_allowlist(decide.decoy_verdicts(sessions), allowlist(spark, sf)))
    return decide.policy(ready).select("window_id", "tier", "label", "confidence", "action")


# --- audit ---

@query("decision_log", f"""with {PLAIN}, k as (
 select seq, 0 as step, 'detection' as entry_type from d union all
 select seq, 1, 'policy_decision' from d union all
 select seq, 2, 'enforcement' from d where action in ('block', 'throttled') union all
 select seq, 3, 'job' from d where action is not null and label <> 'benign')
select * from k""")
def decision_log(spark, sf):
    rows = decided(spark, sf).withColumn("decision_id", F.concat(F.lit("d"), "seq"))
    return audit.decision_rows(rows).select("seq", "step", "entry_type")


# The log of the conversations: one chain per conversation, one entry per turn; turn 3 of every fifth is altered.
LOG = """with recursive t as (select cast(conv_id as varchar) as chain, turn as seq, conv_id || '-' || turn as entry_id,
  conv_id * 1000 + turn as ts_us, case role when 'user' then 'detection' when 'assistant' then 'explanation' else 'correction' end as entry_type,
  text as payload, 'system' as actor from conversations),
p as (select chain, seq, entry_type, length(entry_id) || ':' || entry_id as head,
  length(cast(ts_us as varchar)) || ':' || ts_us || length(entry_type) || ':' || entry_type || length(payload) || ':' || payload
  || length(actor) || ':' || actor as tail, row_number() over (partition by chain order by seq) as rn from t),
w(chain, rn, seq, entry_type, prev_hash, entry_hash) as (
  select chain, rn, seq, entry_type, repeat('0', 64), sha256(head || '64:' || repeat('0', 64) || tail) from p where rn = 1
  union all select p.chain, p.rn, p.seq, p.entry_type, w.entry_hash, sha256(p.head || '64:' || w.entry_hash || p.tail)
  from w join p on p.chain = w.chain and p.rn = w.rn + 1)"""


def entries(spark, sf):

    c = table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "user", "detection").when(F.col("role") == "assistant", "explanation").otherwise("correction")
    return c.select(
        F.col("conv_id").cast("string").alias("chain"), F.col("turn").alias("seq"),
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("entry_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ts_us"), kind.alias("entry_type"), F.col("text").alias("payload"),
        F.lit("system").alias("actor"))


@query("audit_chain", LOG + " select chain, seq, prev_hash, entry_hash from w")
def audit_chain(spark, sf):
    return audit.append_chain(entries(spark, sf)).select("chain", "seq", "prev_hash", "entry_hash")


@query("audit_chain_verify", LOG + """ select chain, count(*) as entries,
 case when cast(chain as bigint) % 5 = 0 and max(seq) >= 3 then 3 end as first_broken,
 not (cast(chain as bigint) % 5 = 0 and max(seq) >= 3) as intact from w group by chain""")
def audit_chain_verify(spark, sf):
    log = audit.append_chain(entries(spark, sf))
    hit = (F.pmod(F.col("chain").cast("bigint"), F.lit(5)) == 0) & (F.col("seq") == 3)
    return audit.verify_chains(log.withColumn("payload", F.when(hit, "altered").otherwise(F.col("payload"))))


@query("audit_latest", LOG + """, l as (select * from w where entry_type = 'detection' order by cast(chain as bigint) * 1000 + seq desc limit 20)
 select chain, seq, entry_hash from l""")
def audit_latest(spark, sf):
    log = audit.append_chain(entries(spark, sf))
    return audit.latest_entries(log, "detection", 20, "ts_us").select("chain", "seq", "entry_hash")


@query("audit_type_counts", LOG + """ select k.entry_type, count(w.chain) as n from
 (select unnest(['detection', 'explanation', 'policy_decision', 'enforcement', 'correction']) as entry_type) k
 left join w on w.entry_type = k.entry_type group by 1""")
def audit_type_counts(spark, sf):
    return audit.entry_counts(entries(spark, sf))


_names = " ".join(f"when '{k}' then '{v[0]}'" for k, v in audit.TECHNIQUES.items())
_quote = lambda s: s.replace("'", "''")
_full = " ".join(f"when '{k}' then '. {v[0]} {v[1]} / {v[2]}. {_quote(v[3])} '" for k, v in audit.TECHNIQUES.items())
NOTES = f"""n as (select seq, verdict_id, label, case label {_names} end as technique_id,
 '[' || window_id || '] ' || label || ' by ' || tier || ' (' || cast(round_even(confidence * 100, 0) as bigint) || '% sure)'
 || case when label in ('benign', 'uncertain') then '. No technique.'
    else case label {_full} end || case when tier = 'detective' then 'Seen on 1 edge(s) between 2 node(s).'
    else 'Seen in the flow itself.' end end as narrative from d)"""


def explained(spark, sf):
    graph = F.col("tier") == "detective"
    empty = F.array().cast("array<string>")
    return verdicts(spark, sf).withColumn("node_ids", F.when(graph, F.array("target", F.lit("b"))).otherwise(empty)).withColumn(
        "edge_ids", F.when(graph, F.array(F.lit("a->b"))).otherwise(empty))


@query("incident_narratives", f"with {PLAIN}, {NOTES} select seq, technique_id, narrative from n")
def incident_narratives(spark, sf):
    return audit.narratives(explained(spark, sf)).select("seq", "technique_id", "narrative")


@query("job_drain", f"""with {PLAIN}, {NOTES}, j as (select 'j' || seq as job_id, 'v' || (seq * 2) as verdict_id from flow where dst = 'click')
select j.job_id, n.verdict_id, n.technique_id, n.narrative from j join n on n.verdict_id = j.verdict_id""")
def job_drain(spark, sf):
    jobs = flow(spark, sf).filter("dst = 'click'").select(
        F.concat(F.lit("j"), "seq").alias("job_id"), F.concat(F.lit("v"), F.col("seq") * 2).alias("verdict_id"))
    seen = explained(spark, sf).select("verdict_id", "seq", "window_id", "tier", "label", "confidence", "node_ids", "edge_ids")
    return audit.drain_jobs(jobs, seen).select("job_id", "verdict_id", "technique_id", "narrative")


@query("feedback_counts", f"""with {FLOW} select count(*) filter (dst = 'view' and ts_us > 1705276800000000) as decoy_sessions,
 count(*) filter (dst = 'purchase' and ts_us > 1705276800000000) as corrections, count(distinct ts_us // {DAY}) as days from flow""")
def feedback_counts(spark, sf):
    f = flow(spark, sf)
    late = F.col("ts_us") > 1705276800000000
    return f.agg(F.count_if((F.col("dst") == "view") & late).alias("decoy_sessions"),
                 F.count_if((F.col("dst") == "purchase") & late).alias("corrections"),
                 F.countDistinct(F.floor(F.col("ts_us") / DAY)).alias("days"))
