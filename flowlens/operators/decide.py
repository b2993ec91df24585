"""Verdicts to bounded decisions: label bands, policy table, one action per window, action cap, blocks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.scan import carry_forward, neighbours
from flowlens.operators.windows import in_intervals, packed_key
from flowlens.schemas import (BLOCK_AT, BLOCK_TTL_SECONDS, BREAKER_CAP, BREAKER_WINDOW_SECONDS, GRAY_FROM,
                              LABELS, MICROS, TIERS)


def raw_prediction(p: Column) -> tuple[Column, Column]:
    """(label, confidence) of a flood probability."""
    return (F.when(p >= 0.5, "flood").otherwise("benign"), F.when(p >= 0.5, p).otherwise(F.lit(1.0) - p))


def derive_label(predicted: Column, confidence: Column) -> Column:
    """An attack label inside the gray band becomes 'uncertain'."""
    return F.when((predicted != "benign") & (confidence >= GRAY_FROM) & (confidence < BLOCK_AT),
                  F.lit("uncertain")).otherwise(predicted)


def fast_verdicts(scored: DataFrame, probability: str = "p_flood") -> DataFrame:
    """Verdict columns of the fast lane."""
    label, confidence = raw_prediction(F.col(probability))
    return (scored.withColumn("tier", F.lit("bouncer")).withColumn("_raw", label)
            .withColumn("confidence", confidence)
            .withColumn("label", derive_label(F.col("_raw"), F.col("confidence")))
            .withColumn("attribution_method", F.lit("rate_threshold")).drop("_raw"))


def decoy_verdicts(sessions: DataFrame, session_id: str = "session_id") -> DataFrame:
    """A decoy session is certain: confidence 1.0, its own window."""
    return sessions.select(
        "*", F.col(session_id).alias("window_id"), F.lit("decoy").alias("tier"),
        F.lit("decoy_interaction").alias("label"), F.lit(1.0).alias("confidence"),
        F.lit("honeypot_interaction").alias("attribution_method"))


def target_of(evidence: str, source: str) -> Column:
    """First evidence host, or the event's source."""
    return F.coalesce(F.try_element_at(F.col(evidence), F.lit(1)), F.col(source))


def valid_input() -> Column:
    """The gate of the policy table; anything else gets no decision."""
    c = F.col("confidence")
    ok = (F.col("tier").isin(*TIERS) & F.col("label").isin(*LABELS) & c.isNotNull() & ~F.isnan(c)
          & c.between(0.0, 1.0) & (F.col("window_id") != "") & (F.col("verdict_id") != "")
          & F.col("on_allowlist").isNotNull() & F.col("breaker_tripped").isNotNull())
    return F.coalesce(ok, F.lit(False))


def _outcome(action: str, reason: str, ttl: int | None = None) -> Column:
    return F.struct(F.lit(action).alias("action"), F.array(F.lit(reason)).alias("reason_codes"),
                    F.lit(ttl).cast("int").alias("ttl_seconds"))


def policy(verdicts: DataFrame) -> DataFrame:
    """Adds ``action``, ``reason_codes`` and ``ttl_seconds``; all NULL when the input is malformed."""
    label, c = F.col("label"), F.col("confidence")
    decision = (
        F.when(~valid_input(), F.lit(None))
        .when(F.col("already_resolved"), _outcome("dry_run", "window_already_resolved"))
        .when(label == "uncertain", _outcome("dry_run", "gray_zone"))
        .when(label == "benign", _outcome("dry_run", "below_gray_zone"))
        .when(c < GRAY_FROM, _outcome("dry_run", "below_gray_zone"))
        .when(c < BLOCK_AT, _outcome("dry_run", "gray_zone"))
        .when(F.col("on_allowlist"), _outcome("allowlist_exempt", "on_allowlist"))
        .when(F.col("breaker_tripped"), _outcome("throttled", "circuit_breaker_exceeded"))
        .otherwise(_outcome("block", "confidence_above_threshold", BLOCK_TTL_SECONDS)))
    return verdicts.withColumn("_d", decision).select("*", "_d.*").drop("_d")


def rejects(decided: DataFrame) -> DataFrame:
    """Verdicts the policy refused, with the reason the log records."""
    return decided.filter(F.col("action").isNull()).withColumn("reason", F.lit("malformed_input"))


def notify(decided: DataFrame) -> DataFrame:
    """Decisions a person should review."""
    return decided.filter(F.array_contains("reason_codes", "gray_zone"))


def flag_allowlist(verdicts: DataFrame, allowlist: DataFrame, target: str = "target") -> DataFrame:
    """Adds ``on_allowlist``."""
    listed = allowlist.select(F.col("ip").alias(target)).distinct().withColumn("_on", F.lit(True))
    return verdicts.join(listed, target, "left").withColumn("on_allowlist", F.coalesce("_on", F.lit(False))).drop("_on")


def acts() -> Column:
    """Strong enough to act on: a valid verdict with an attack label at or over the block threshold."""
    return (valid_input() & ~F.col("label").isin("benign", "uncertain") & (F.col("confidence") >= BLOCK_AT))


def first_action(verdicts: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds ``already_resolved``: an earlier verdict of the window acts.

    Which verdict acts first does not depend on the cap (a throttled one uses the window up just as a block
    does), so a window is resolved by one minimum per window and a join back.
    """
    if "breaker_tripped" not in verdicts.columns:
        verdicts = verdicts.withColumn("breaker_tripped", F.lit(False))
    acting = verdicts.filter(acts()).groupBy("window_id").agg(F.min(seq).alias("_first"))
    return verdicts.join(acting, "window_id", "left").withColumn(
        "already_resolved", F.coalesce(F.col("_first") < F.col(seq), F.lit(False))).drop("_first")


class _Breaker:
    """Trailing cap over its own output; state is at most ``cap`` times, whatever the run's length."""

    def __init__(self, cap: int, window: int) -> None:
        self.cap = cap
        self.window = window

    def __call__(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, taken = None, deque()
        for frame in frames:
            kept = []
            for key, start, ts in zip(frame["_key"], frame["_run"], frame["ts_us"]):
                if (key, start) != run:
                    run = (key, start)
                    taken.clear()
                while taken and ts - taken[0] > self.window:
                    taken.popleft()
                admit = len(taken) < self.cap
                if admit:
                    taken.append(ts)
                kept.append(admit)
            yield frame.loc[kept, ["_key", "ts_us", "seq"]]


def action_cap(
    candidates: DataFrame,
    shard: Sequence[str],
    cap: int = BREAKER_CAP,
    window_us: int = BREAKER_WINDOW_SECONDS * MICROS,
) -> DataFrame:
    """Adds ``breaker_tripped``: ``cap`` blocks were already taken in the inclusive trailing window.

    A throttled candidate does not count, so the rule feeds on its own output and is sequential inside a
    shard. Only the parts that can trip are walked: time is cut into cells of one window, and a cell that
    holds no more than ``cap`` candidates together with the cell before it cannot trip. Runs of the other
    cells are walked separately, each with the quiet cell before it as history, and of the candidates of
    one instant only the first ``cap`` can be taken.
    """
    keyed = candidates.withColumn("_key", packed_key(shard)).withColumn(
        "_cell", F.col("ts_us") - F.pmod("ts_us", F.lit(window_us)))
    cells = keyed.groupBy("_key", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_key").orderBy("_cell")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    follows = F.coalesce(F.lag("_cell").over(order) == F.col("_cell") - window_us, F.lit(False))
    leads = F.coalesce(F.lead("_cell").over(order) == F.col("_cell") + window_us, F.lit(False))
    cells = (cells.withColumn("_follows", follows).withColumn("_leads", leads)
             .withColumn("_busy", F.col("_n") + F.when(F.col("_follows"), F.lag("_n").over(order)).otherwise(0) > cap)
             .withColumn("_seed", ~F.col("_busy") & F.col("_leads") & F.coalesce(F.lead("_busy").over(order), F.lit(False))))
    opens = F.col("_seed") | (F.col("_busy") & ~F.col("_follows"))
    cells = cells.withColumn("_run", F.last(F.when(opens, F.col("_cell")), ignorenulls=True).over(sofar)).select(
        "_key", "_cell", "_busy", F.when(F.col("_busy") | F.col("_seed"), F.col("_run")).alias("_run"))
    placed = keyed.join(cells, ["_key", "_cell"])
    instant = Window.partitionBy("_key", "ts_us").orderBy("seq")
    walked = (placed.filter(F.col("_run").isNotNull())
              .select("_key", "_run", "ts_us", F.col("seq").cast("bigint").alias("seq"))
              .withColumn("_i", F.row_number().over(instant)).filter(F.col("_i") <= cap).drop("_i")
              .repartition("_key", "_run").sortWithinPartitions("_key", "_run", "ts_us", "seq")
              .mapInPandas(_Breaker(cap, window_us), "_key string, ts_us bigint, seq bigint")
              .withColumn("_taken", F.lit(True)))
    out = placed.join(walked, ["_key", "ts_us", "seq"], "left")
    return out.withColumn("breaker_tripped", F.col("_busy") & F.col("_taken").isNull()).select(
        *[c for c in candidates.columns if c != "breaker_tripped"], "breaker_tripped")


def decide(
    verdicts: DataFrame,
    allowlist: DataFrame,
    shard: Sequence[str] = ("shard",),
    cap: int = BREAKER_CAP,
    cap_window_us: int = BREAKER_WINDOW_SECONDS * MICROS,
) -> DataFrame:
    """The whole decision path in verdict order: allowlist, first action per window, cap, policy table."""
    flagged = first_action(flag_allowlist(verdicts, allowlist).withColumn("breaker_tripped", F.lit(False)))
    wants = acts() & ~F.col("already_resolved") & ~F.col("on_allowlist")
    capped = action_cap(flagged.filter(wants).select(*shard, "ts_us", "seq", "breaker_tripped"), shard, cap, cap_window_us)
    joined = flagged.drop("breaker_tripped").join(
        capped.select("seq", F.col("breaker_tripped").alias("_t")), "seq", "left")
    return policy(joined.withColumn("breaker_tripped", F.coalesce("_t", F.lit(False))).drop("_t"))


def _hour(ts: str = "ts_us") -> Column:
    """Time cell of the ordered steps below: a hot target is one group per hour, not one group."""
    return F.col(ts) - F.pmod(ts, F.lit(3600 * MICROS))


def block_intervals(blocks: DataFrame, reversals: DataFrame | None = None, ttl_us: int = BLOCK_TTL_SECONDS * MICROS,
                    target: str = "target") -> DataFrame:
    """Half-open ``[start_us, end_us)`` per block: until expiry, the target's next block, or a reversal."""
    rows = blocks.select(F.col(target).alias("target"), "ts_us", F.col("seq").cast("bigint").alias("seq"),
                         F.lit(0).alias("kind"))
    if reversals is not None:
        rows = rows.unionByName(reversals.select(
            F.col(target).alias("target"), "ts_us", F.col("seq").cast("bigint").alias("seq"), F.lit(1).alias("kind")))
    near = neighbours(rows, ["ts_us", "kind", "seq"], {"_next": "ts_us", "_kind": "kind"}, ["target"], forward=True,
                      cell=_hour())
    expiry = F.col("ts_us") + ttl_us
    return near.filter(F.col("kind") == 0).select(
        "target", "seq", F.col("ts_us").alias("start_us"),
        F.least(expiry, F.coalesce("_next", expiry)).alias("end_us"),
        F.coalesce((F.col("_kind") == 1) & (F.col("_next") < expiry), F.lit(False)).alias("reversed"))


def blocked_at(lookups: DataFrame, intervals: DataFrame, ttl_us: int = BLOCK_TTL_SECONDS * MICROS) -> DataFrame:
    """Adds ``blocked`` to (target, ts_us) rows."""
    spans = intervals.filter(F.col("end_us") > F.col("start_us")).select(
        "target", F.col("start_us").alias("span_start"), (F.col("end_us") - 1).alias("span_end"))
    return in_intervals(lookups, spans, ["target"], "ts_us", max(ttl_us, 1), "blocked")


def active_blocks(intervals: DataFrame, at_us: int) -> DataFrame:
    """Blocks in force at one instant."""
    return intervals.filter((F.col("start_us") <= at_us) & (F.lit(at_us) < F.col("end_us")))


def resolve_corrections(corrections: DataFrame, decisions: DataFrame, target: str = "target") -> DataFrame:
    """Each correction with the target's last decision at that time; without one it is an error row."""
    d = decisions.select(F.col(target).alias("target"), "ts_us", F.col("seq").cast("bigint").alias("seq"),
                         F.lit(0).alias("kind"), F.col("decision_id").cast("string").alias("decision_id"),
                         F.lit(None).cast("string").alias("correction_id"),
                         F.lit(None).cast("boolean").alias("is_false_positive"))
    c = corrections.select(F.col(target).alias("target"), "ts_us", F.col("seq").cast("bigint").alias("seq"),
                           F.lit(1).alias("kind"), F.lit(None).cast("string").alias("decision_id"),
                           F.col("correction_id").cast("string").alias("correction_id"), "is_false_positive")
    found = carry_forward(d.unionByName(c), ["ts_us", "kind", "seq"], {"last_decision": "decision_id"},
                          F.col("kind") == 0, ["target"], cell=_hour())
    return found.filter(F.col("kind") == 1).select(
        "correction_id", "target", "ts_us", "seq", "last_decision",
        F.when(F.col("is_false_positive"), "false_positive").otherwise("true_positive").alias("verdict_was"),
        F.when(F.col("last_decision").isNull(), "no_decision_for_target").alias("error"))
