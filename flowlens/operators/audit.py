"""Hash-chained audit log, decision fan-out, incident narratives and the explanation queue."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.scan import neighbours
from flowlens.schemas import ENTRY_TYPES, GENESIS_HASH

# Label -> technique id, name, tactic, summary.
TECHNIQUES = {
    "flood": (
        "T1498", "Network Denial of Service", "Impact",
        "So much traffic reaches one target that its link is full and regular users are shut out."),
    "port_scan": (
        "T1046", "Network Service Discovery", "Discovery",
        "Many ports or hosts are tried in turn to learn which of them answer."),
    "lateral_movement": (
        "T1021", "Remote Services", "Lateral Movement",
        "A host inside the network signs in to its neighbours, one after another."),
    "decoy_interaction": (
        "T1110", "Brute Force", "Credential Access",
        "Logins are attempted on a decoy, which nobody has a reason to use."),
}


# --- hash chain ---------------------------------------------------------------------------------


def hash_input(previous: Column) -> Column:
    """Canonical text of an entry: its fields in fixed order, each length-prefixed so none can shift."""
    fields = [F.col("entry_id"), previous, F.col("ts_us").cast("string"), F.col("entry_type"), F.col("payload"),
              F.col("actor")]
    return F.concat(*[F.concat(F.length(f).cast("string"), F.lit(":"), f) for f in fields])


def _chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links entries in chain order; only the running tip is held."""
    chain, tip = None, GENESIS_HASH
    for frame in frames:
        previous, hashes = [], []
        for name, start, head, tail in zip(frame["chain"], frame["_tip"], frame["_head"], frame["_tail"]):
            if name != chain:
                chain, tip = name, start
            previous.append(tip)
            tip = hashlib.sha256(f"{head}{len(tip)}:{tip}{tail}".encode()).hexdigest()
            hashes.append(tip)
        yield pd.DataFrame({"chain": frame["chain"], "seq": frame["seq"], "prev_hash": previous, "entry_hash": hashes})


def append_chain(entries: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """Adds ``prev_hash`` and ``entry_hash`` to (chain, seq, entry_id, ts_us, entry_type, payload, actor).

    ``tips`` (chain, entry_hash) continues existing chains. A chain is sequential by definition; chains
    are the unit of parallelism, so writers shard the log by chain.
    """
    sized = lambda f: F.concat(F.length(f).cast("string"), F.lit(":"), f)
    head = sized(F.col("entry_id"))
    tail = F.concat(*[sized(c) for c in (F.col("ts_us").cast("string"), F.col("entry_type"), F.col("payload"),
                                         F.col("actor"))])
    narrow = entries.select("chain", "seq", head.alias("_head"), tail.alias("_tail"))
    if tips is not None:
        narrow = narrow.join(tips.select("chain", F.col("entry_hash").alias("_tip")), "chain", "left")
    else:
        narrow = narrow.withColumn("_tip", F.lit(None).cast("string"))
    linked = (narrow.withColumn("_tip", F.coalesce("_tip", F.lit(GENESIS_HASH)))
              .repartition("chain").sortWithinPartitions("chain", "seq")
              .mapInPandas(_chain, "chain string, seq bigint, prev_hash string, entry_hash string"))
    return entries.join(linked, ["chain", "seq"])


def chain_tips(log: DataFrame) -> DataFrame:
    """Last hash and sequence number of every chain."""
    return log.groupBy("chain").agg(F.max_by("entry_hash", "seq").alias("entry_hash"), F.max("seq").alias("seq"))


def check_links(log: DataFrame, cell_rows: int = 100_000) -> DataFrame:
    """Per entry: does it link to the entry before it, and does its own hash recompute."""
    near = neighbours(log, ["seq"], {"_before": "entry_hash"}, ["chain"],
                      cell=(F.col("seq") - F.pmod("seq", F.lit(cell_rows))))
    return near.withColumn("link_ok", F.col("prev_hash") == F.coalesce("_before", F.lit(GENESIS_HASH))).withColumn(
        "hash_ok", F.sha2(hash_input(F.col("prev_hash")), 256) == F.col("entry_hash")).drop("_before")


def verify_chains(log: DataFrame) -> DataFrame:
    """Per chain: intact or not, and the sequence number of the first broken entry."""
    broken = ~(F.col("link_ok") & F.col("hash_ok"))
    return check_links(log).groupBy("chain").agg(
        F.count(F.lit(1)).alias("entries"),
        F.min(F.when(broken, F.col("seq"))).alias("first_broken"),
    ).withColumn("intact", F.col("first_broken").isNull())


# --- log rows -----------------------------------------------------------------------------------


def payload(*columns: str) -> Column:
    """JSON payload with its fields in name order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def decision_rows(decided: DataFrame) -> DataFrame:
    """Log rows of every verdict: detection, decision (or reject), enforcement, explanation job.

    Input: decided verdicts with ``verdict_id, tier, label, confidence, window_id, decision_id, action,
    reason_codes, ttl_seconds, target, ts_us, seq``.
    """
    row = lambda step, kind, body, when: F.when(when, F.struct(
        F.lit(step).alias("step"), F.lit(kind).alias("entry_type"), body.alias("payload")))
    always, decided_ok = F.lit(True), F.col("action").isNotNull()
    reject = F.to_json(F.struct(F.lit("malformed_input").alias("reason"), F.lit(True).alias("rejected"),
                                F.col("verdict_id")))
    rows = F.array_compact(F.array(
        row(0, "detection", payload("verdict_id", "tier", "label", "confidence", "window_id"), always),
        row(1, "policy_decision", payload("decision_id", "verdict_id", "action", "reason_codes", "target"), decided_ok),
        row(1, "policy_decision", reject, ~decided_ok),
        row(2, "enforcement", payload("decision_id", "target", "action", "ttl_seconds"),
            decided_ok & F.col("action").isin("block", "throttled")),
        row(3, "job", payload("verdict_id"), decided_ok & (F.col("label") != "benign"))))
    return decided.select("verdict_id", "seq", "ts_us", F.explode(rows).alias("r")).select(
        "verdict_id", "seq", "ts_us", "r.step", "r.entry_type", "r.payload")


def latest_entries(log: DataFrame, entry_type: str, count: int, order: str = "seq") -> DataFrame:
    """The newest ``count`` entries of a type, oldest first."""
    newest = log.filter(F.col("entry_type") == entry_type).orderBy(F.desc(order)).limit(count)
    return newest.orderBy(order)


def entry_counts(log: DataFrame) -> DataFrame:
    """Rows per entry type, absent types as 0."""
    types = log.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(t) for t in ENTRY_TYPES])).alias("entry_type"), F.lit(0).cast("bigint").alias("n"))
    counted = log.groupBy("entry_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.unionByName(types).groupBy("entry_type").agg(F.sum("n").alias("n"))


# --- explanations -------------------------------------------------------------------------------


def techniques(spark) -> DataFrame:
    """The fixed technique table (four rows)."""
    return spark.createDataFrame(
        [(label, *values) for label, values in TECHNIQUES.items()],
        "label string, technique_id string, technique string, tactic string, summary string")


def narratives(verdicts: DataFrame) -> DataFrame:
    """Adds the technique and an offline incident note to each verdict."""
    known = verdicts.join(F.broadcast(techniques(verdicts.sparkSession)), "label", "left")
    share = F.concat(F.bround(F.col("confidence") * 100).cast("bigint").cast("string"), F.lit("%"))
    opening = F.concat(F.lit("["), F.col("window_id"), F.lit("] "), F.col("label"), F.lit(" by "), F.col("tier"),
                       F.lit(" ("), share, F.lit(" sure)"))
    hosts, links = F.size("node_ids"), F.size("edge_ids")
    evidence = F.when((hosts > 0) | (links > 0), F.concat(
        F.lit("Seen on "), links.cast("string"), F.lit(" edge(s) between "), hosts.cast("string"), F.lit(" node(s)."))
    ).otherwise(F.lit("Seen in the flow itself."))
    plain = F.concat(opening, F.lit(". No technique."))
    full = F.concat(opening, F.lit(". "), F.col("technique_id"), F.lit(" "), F.col("technique"), F.lit(" / "), F.col("tactic"),
                    F.lit(". "), F.col("summary"), F.lit(" "), evidence)
    return known.withColumn("narrative", F.when(F.col("technique_id").isNull(), plain).otherwise(full)).drop("summary")


def drain_jobs(jobs: DataFrame, detections: DataFrame) -> DataFrame:
    """Jobs with their verdict's latest detection, explained; a job without a detection is dropped."""
    columns = [c for c in detections.columns if c not in ("verdict_id", "seq")]
    latest = detections.groupBy("verdict_id").agg(F.max_by(F.struct(*columns), F.col("seq")).alias("d"))
    joined = jobs.join(latest, "verdict_id").select("job_id", "verdict_id", "d.*")
    return narratives(joined)
