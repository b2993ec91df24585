import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from flowlens.operators.decide import (action_cap, active_blocks, block_intervals, blocked_at, decide, derive_label,
                                       policy, resolve_corrections)

VERDICT = ("tier string, label string, confidence double, window_id string, verdict_id string, "
           "on_allowlist boolean, breaker_tripped boolean, already_resolved boolean")
CASES = [
    (("bouncer", "flood", 0.85, "w", "v", False, False, False), ("block", "confidence_above_threshold", 900)),
    (("bouncer", "flood", 0.849999, "w", "v", False, False, False), ("dry_run", "gray_zone", None)),
    (("bouncer", "flood", 0.5, "w", "v", False, False, False), ("dry_run", "gray_zone", None)),
    (("bouncer", "flood", 0.4999, "w", "v", False, False, False), ("dry_run", "below_gray_zone", None)),
    (("detective", "port_scan", 0.9, "w", "v", True, True, False), ("allowlist_exempt", "on_allowlist", None)),
    (("detective", "uncertain", 0.99, "w", "v", False, False, False), ("dry_run", "gray_zone", None)),
    (("bouncer", "benign", 0.99, "w", "v", False, False, False), ("dry_run", "below_gray_zone", None)),
    (("decoy", "decoy_interaction", 1.0, "w", "v", False, True, False), ("throttled", "circuit_breaker_exceeded", None)),
    (("decoy", "decoy_interaction", 1.0, "w", "v", False, False, False), ("block", "confidence_above_threshold", 900)),
    (("bouncer", "flood", 0.99, "w", "v", False, False, True), ("dry_run", "window_already_resolved", None)),
    (("bouncer", "flood", 1.01, "w", "v", False, False, False), None),
    (("bouncer", "flood", None, "w", "v", False, False, False), None),
    (("bouncer", "flood", float("nan"), "w", "v", False, False, False), None),
    (("spy", "flood", 0.9, "w", "v", False, False, False), None),
    (("bouncer", "worm", 0.9, "w", "v", False, False, False), None),
    (("bouncer", "flood", 0.9, "", "v", False, False, False), None),
    (("bouncer", "flood", 0.9, "w", None, False, False, False), None),
    (("bouncer", "flood", 0.9, "w", "v", None, False, False), None),
]


def test_policy_cases(spark):
    df = spark.createDataFrame([c[0] for c in CASES], VERDICT).coalesce(1).withColumn("i", F.monotonically_increasing_id())
    got = policy(df).orderBy("i").collect()
    for row, (given, want) in zip(got, CASES):
        if want is None:
            assert row.action is None and row.reason_codes is None, given
        else:
            assert (row.action, row.reason_codes, row.ttl_seconds) == (want[0], [want[1]], want[2]), given


def test_label_bands(spark):
    df = spark.createDataFrame([("flood", 0.85), ("flood", 0.84), ("flood", 0.4), ("benign", 0.6)], "l string, c double")
    assert [r[0] for r in df.select(derive_label(F.col("l"), F.col("c"))).collect()] == [
        "flood", "uncertain", "flood", "benign"]


def walk(rows, cap, window):
    """(shard, ts, seq) in order -> seqs that trip."""
    taken, tripped = {}, set()
    for shard, ts, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        mine = taken.setdefault(shard, deque())
        while mine and ts - mine[0] > window:
            mine.popleft()
        if len(mine) >= cap:
            tripped.add(seq)
        else:
            mine.append(ts)
    return tripped


@pytest.mark.parametrize("cap,gap", [(3, 4), (1, 9), (5, 2), (2, 30)])
def test_cap_equals_the_sequential_walk(spark, cap, gap):
    rng = random.Random(cap * 100 + gap)
    rows, at = [], 0
    for seq in range(500):
        at += rng.choice([0, 0, 1, gap, 70 if rng.random() < 0.1 else 1])
        rows.append((rng.choice("ab"), at, seq))
    df = spark.createDataFrame(rows, "shard string, ts_us bigint, seq bigint")
    got = {r.seq for r in action_cap(df, ["shard"], cap, 60).collect() if r.breaker_tripped}
    assert got == walk(rows, cap, 60)


def test_decide_one_action_per_window_and_dry_run_keeps_the_slot(spark):
    rows = [
        (1, 1, "w1", "bouncer", "flood", 0.6, "10.0.0.1"), (2, 2, "w1", "detective", "port_scan", 0.9, "10.0.0.1"),
        (3, 3, "w1", "bouncer", "flood", 0.99, "10.0.0.1"), (4, 4, "w2", "bouncer", "flood", 0.95, "10.0.0.9"),
        (5, 5, "w3", "bouncer", "flood", 0.95, "10.0.0.2"), (6, 6, "w4", "bouncer", "flood", 2.0, "10.0.0.2"),
    ]
    df = spark.createDataFrame(rows, "seq bigint, ts_us bigint, window_id string, tier string, label string, confidence double, target string")
    df = df.withColumn("verdict_id", F.concat(F.lit("v"), "seq")).withColumn("shard", F.lit("s"))
    allow = spark.createDataFrame([("10.0.0.9",)], "ip string")
    got = {r.seq: (r.action, r.reason_codes) for r in decide(df, allow, cap=1).collect()}
    assert got == {
        1: ("dry_run", ["gray_zone"]), 2: ("block", ["confidence_above_threshold"]),
        3: ("dry_run", ["window_already_resolved"]), 4: ("allowlist_exempt", ["on_allowlist"]),
        5: ("throttled", ["circuit_breaker_exceeded"]), 6: (None, None)}


def test_blocks_expire_are_overwritten_and_reversed(spark):
    blocks = spark.createDataFrame([("a", 0, 1), ("a", 50, 2), ("b", 10, 3)], "target string, ts_us bigint, seq bigint")
    undo = spark.createDataFrame([("a", 60, 4), ("c", 5, 5)], "target string, ts_us bigint, seq bigint")
    spans = block_intervals(blocks, undo, ttl_us=100)
    assert {(r.seq, r.start_us, r.end_us, r.reversed) for r in spans.collect()} == {
        (1, 0, 50, False), (2, 50, 60, True), (3, 10, 110, False)}
    asks = spark.createDataFrame([("a", 0), ("a", 59), ("a", 60), ("b", 109), ("b", 110), ("z", 1)], "target string, ts_us bigint")
    assert [(r.target, r.ts_us) for r in blocked_at(asks, spans, 100).filter("blocked").orderBy("target", "ts_us").collect()] == [
        ("a", 0), ("a", 59), ("b", 109)]
    assert active_blocks(spans, 55).count() == 2


def test_corrections_find_the_last_decision(spark):
    decisions = spark.createDataFrame([("a", 1, 1, "d1"), ("a", 5, 2, "d2"), ("b", 9, 3, "d3")],
                                      "target string, ts_us bigint, seq bigint, decision_id string")
    corrections = spark.createDataFrame([("c1", "a", 4, 4, True), ("c2", "a", 7, 5, False), ("c3", "a", 8, 6, True), ("c4", "b", 2, 7, True)],
                                        "correction_id string, target string, ts_us bigint, seq bigint, is_false_positive boolean")
    got = {r.correction_id: (r.last_decision, r.verdict_was, r.error) for r in resolve_corrections(corrections, decisions).collect()}
    assert got == {"c1": ("d1", "false_positive", None), "c2": ("d2", "true_positive", None),
                   "c3": ("d2", "false_positive", None), "c4": (None, "false_positive", "no_decision_for_target")}
