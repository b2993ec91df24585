"""Unit and seeded property tests of the set-based operators, each against a plain definition."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions import fields, labels
from flowlens.operators import contract, drift, evaluate, graph, quality, sampling
from flowlens.operators.scan import carry_forward, cell_of, exact_quantiles, neighbours, row_positions, running_sums
from flowlens.operators.windows import aligned_windows


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- scans ---


def test_scans_equal_the_sequential_definition_whatever_the_cuts(spark):
    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), rng.randrange(40), i, rng.randrange(-5, 9), rng.random() < 0.2) for i in range(400)]
    df = frame(spark, rows, "k string, t int, seq int, x int, p boolean")
    total, last, seen, count = defaultdict(int), {}, {}, Counter()
    want = {}
    for k, t, seq, x, p in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        total[k] += x
        if p:
            seen[k] = seq
        want[seq] = (total[k], last.get(k), seen.get(k), count[k])
        last[k] = seq
        count[k] += 1
    after = {}
    for seq, (_, before, _, _) in want.items():
        if before is not None:
            after[before] = seq
    for points in ([], [3, 9, 10, 31], list(range(40)), None):
        order = ["t", "seq"]
        a = {r.seq: r.s for r in running_sums(df, order, {"s": F.col("x")}, ["k"], points).collect()}
        b = {r.seq: r.b for r in neighbours(df, order, {"b": "seq"}, ["k"], points=points).collect()}
        n = {r.seq: r.n for r in neighbours(df, order, {"n": "seq"}, ["k"], True, points).collect()}
        c = {r.seq: r.c for r in carry_forward(df, order, {"c": "seq"}, F.col("p"), ["k"], points).collect()}
        d = {r.seq: r.position for r in row_positions(df, order, ["k"], points=points).collect()}
        assert all((a[s], b[s], c[s], d[s]) == want[s] and n[s] == after.get(s) for s in want)


def test_cells_are_monotone(spark):
    points = [2, 5, 5.5, 9]
    got = [r.c for r in spark.range(12).select(cell_of(F.col("id"), points).alias("c")).orderBy("c").collect()]
    assert got == sorted(sum(p <= v for p in points) for v in range(12))


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(0, 1, 333), "b": np.repeat([1.0, 2.0, 7.0], [200, 3, 50]), "c": np.array([4.0])}
    df = frame(spark, [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None)], "k string, v double")
    probs = {"m": 0.5, "lo": 0.05, "hi": 0.95, "min": 0.0, "max": 1.0}
    for points in (None, [0.0, 1.0, 2.0]):
        for r in exact_quantiles(df, "v", probs, ["k"], points).collect():
            assert r.n == len(values[r.k])
            assert all(abs(r[n] - np.quantile(values[r.k], p)) < 1e-12 for n, p in probs.items())


# --- graph ---


def test_graph_fixtures(spark):
    schema = "ts_us bigint, src string, dst string, port int, bytes bigint, duration_ms bigint"
    rows = [(i, "a", "b", 80, 100, 10) for i in range(5)] + [(9, "c", f"d{i}", 100 + i, 1, 1) for i in range(6)] + [(9, "s", "s", None, 7, 3)]
    counted = graph.port_counts(aligned_windows(frame(spark, rows, schema), 1000), ["window_start"])
    edge = {(e.src, e.dst): e for e in graph.edges(counted, ["window_start"]).collect()}
    assert (edge["a", "b"].flow_count, edge["a", "b"].bytes, edge["a", "b"].port_entropy) == (5, 500.0, 0.0)
    node = {n.node: n for n in graph.nodes(counted, ["window_start"]).collect()}
    assert (node["c"].degree_out, node["c"].unique_ports_contacted) == (6.0, 6)
    assert (node["s"].bytes_total, node["s"].degree_in, node["s"].degree_out, node["s"].unique_ports_contacted) == (14.0, 1.0, 1.0, 0)
    total = len(rows)
    assert sum(e.flow_count for e in edge.values()) == total == sum(n.degree_in for n in node.values()) == sum(n.degree_out for n in node.values())
    vector = graph.window_vectors(counted, ["window_start"]).first()
    assert (vector.n_edges, vector.n_nodes, vector.max_unique_ports, vector.max_degree_out) == (8.0, 10.0, 6.0, 6.0)


def test_entropy_bounds(spark):
    rng = random.Random(1)
    df = frame(spark, [(rng.randrange(6), rng.choice([None, 1, 2, 3, 4])) for _ in range(300)], "k int, v int")
    sizes = {r.k: r.n for r in df.groupBy("k").agg(F.count("v").alias("n")).collect()}
    for r in graph.entropy(df, "v", ["k"]).collect():
        assert 0.0 <= r.entropy <= math.log2(sizes[r.k]) + 1e-9


# --- samples ---


@pytest.mark.parametrize("n,k", [(10, 3), (100, 7), (97, 96), (5, 9), (1000, 333)])
def test_even_samples_equal_their_formulas(spark, n, k):
    df = spark.range(n).withColumn("g", F.lit("g"))
    floor = sorted(r.id for r in sampling.even_sample(df, ["id"], k, ["g"]).collect())
    space = sorted(r.id for r in sampling.even_sample(df, ["id"], k, ["g"], linspace=True).collect())
    assert floor == (list(range(n)) if k >= n else [min(n - 1, int(i * (n / k))) for i in range(k)])
    assert space == (list(range(n)) if k >= n else sorted(set(np.linspace(0, n - 1, k).astype(int).tolist())))


def test_splits_are_disjoint_stable_and_sized(spark):
    df = spark.range(1000).withColumn("c", F.pmod("id", F.lit(3)))
    first = {r.id: r.side for r in sampling.class_split(df, ["c"], "id").collect()}
    again = {r.id: r.side for r in sampling.class_split(df.repartition(5), ["c"], "id").collect()}
    assert first == again and Counter((i % 3, s) for i, s in first.items())[0, "train"] == int(334 * 0.67)
    whole = sampling.group_holdout(df.withColumn("g", F.concat(F.lit("g"), F.pmod("id", F.lit(12)))), "c", "g", ["id"])
    sides = {(r.g, r.side) for r in whole.collect()}
    assert len(sides) == 12  # no group on both sides


def test_stride_and_budget(spark):
    df = spark.range(50).withColumn("f", F.lit("x"))
    assert sorted(r.id for r in sampling.stride(df, ["id"], 7, ["f"]).collect()) == list(range(0, 50, 7))
    assert sorted(r.id for r in sampling.budget_stride(df, ["id"], 4, ["f"]).collect()) == [0, 12, 24, 36]
    assert sampling.balance_down(df.withColumn("c", F.col("id") < 10), "c", ["id"], cap=6).groupBy("c").count().filter("count = 6").count() == 2
    with pytest.raises(ValueError):
        sampling.stride(df, ["id"], 0)


# --- label quality ---


def test_label_quality_cases(spark):
    rows = [("v1", "a"), ("v1", "b"), ("v1", "a"), ("v2", "a"), ("v3", "b")]
    df = frame(spark, [(i, *r) for i, r in enumerate(rows)], "seq int, key string, category string")
    q = quality.label_quality(df).first()
    assert (q.rows, q.distinct_vectors, q.ambiguous_vectors, q.rows_in_ambiguous_vectors) == (5, 3, 1, 3)
    assert q.deterministic_ceiling == 0.8 and q.ambiguous_row_fraction == 0.6
    by = {r.category: r for r in quality.label_quality_by_class(df).collect()}
    assert (by["a"].rows_after_guard, by["b"].vectors_after_guard) == (1, 1)
    assert quality.drop_ambiguous(df).count() == 2 and sorted(r.seq for r in quality.dedupe_first(df).collect()) == [0, 3, 4]
    assert quality.label_ceiling(df.limit(0)).first().rows == 0
    maps = frame(spark, [({"a": 1.0, "b": 2.0},), ({"b": 2.0, "a": 1.0},)], "features map<string,double>")
    assert maps.select(quality.map_key().alias("k")).distinct().count() == 1


def test_host_overlap(spark):
    rows = [("v", "flood"), ("v", "benign"), ("a", "flood"), ("b", "benign"), ("b", "benign")]
    df = frame(spark, [("d", *r) for r in rows], "day string, source_ip string, label string")
    r = quality.host_overlap(df).first()
    assert (r.attack_hosts, r.benign_hosts, r.shared_hosts, r.first_shared) == (2, 2, 1, "v")
    assert quality.drop_contaminated(df, ["day"]).count() == 4


# --- metrics ---


def test_auc_and_thresholds_on_hand_made_ties(spark):
    rows = [(0.9, 1), (0.5, 1), (0.5, 0), (0.5, 0), (0.1, 0), (0.1, 1)]
    df = frame(spark, rows, "s double, y int")
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a, ya in rows for b, yb in rows if ya == 1 and yb == 0]
    assert abs(evaluate.auc(df, "s", "y").first().auc - sum(pairs) / len(pairs)) < 1e-12
    assert evaluate.auc(df.filter("y = 1"), "s", "y").first().auc is None

    def f1(t):
        tp = sum(y for s, y in rows if s >= t)
        return 2 * tp / (sum(1 for s, _ in rows if s >= t) + sum(y for _, y in rows))
    top, at = max((f1(t), -t) for t, _ in rows)
    best = evaluate.best_threshold(df, "s", "y").first()
    assert (best.best_f1, best.best_threshold) == (top, -at)
    none = evaluate.best_threshold(frame(spark, [(0.5, 0)], "s double, y int"), "s", "y").first()
    assert none.best_f1 == 0.0 and none.best_threshold is None
    rng = random.Random(6)
    big = [(rng.choice([0.1, 0.25, 0.3, rng.random()]), int(rng.random() < 0.3)) for _ in range(300)]
    score = evaluate.threshold_report(frame(spark, big, "s double, y int"), "s", "y", 0.3).first()
    tp, fp = sum(y for s, y in big if s >= 0.3), sum(1 - y for s, y in big if s >= 0.3)
    assert abs(score.precision - tp / (tp + fp)) < 1e-12 and abs(score.recall - tp / sum(y for _, y in big)) < 1e-12


def test_zero_division_and_unknown_predictions(spark):
    df = frame(spark, [("a", "x"), ("a", "a"), ("b", "a")], "t string, p string")
    by = {r.label: r for r in evaluate.class_metrics(df, "t", "p", ["a", "b"]).collect()}
    assert (by["a"].precision, by["a"].recall, by["b"].precision, by["b"].f1) == (0.5, 0.5, 0.0, 0.0)
    grid = {(r.truth, r.predicted): r.n for r in evaluate.confusion(df, "t", "p", ["a", "b"]).collect()}
    assert grid == {("a", "a"): 1, ("a", "b"): 0, ("b", "a"): 1, ("b", "b"): 0, ("a", "x"): 1}


# --- drift ---


def test_psi_and_ks(spark):
    rng = np.random.default_rng(4)
    base = {"same": rng.normal(0, 1, 3000), "shift": rng.normal(0, 1, 3000), "flat": np.ones(50), "gone": np.ones(5) * 3}
    live = {"same": rng.normal(0, 1, 3000), "shift": rng.normal(2.5, 1, 3000), "flat": np.ones(80)}
    long = lambda d: frame(spark, [(k, float(v)) for k, vs in d.items() for v in vs], "feature string, value double")
    p = {r.feature: r.psi for r in drift.psi(long(base), long(live)).collect()}
    assert p["same"] < 0.05 and p["shift"] > 0.2 and p["flat"] == 0.0 and p["gone"] == 0.0

    def numpy_psi(e, a):
        edges = np.quantile(e, np.linspace(0, 1, 11))
        edges[0], edges[-1] = -np.inf, np.inf
        edges = np.unique(edges)
        share = lambda x: np.maximum(np.histogram(x, edges)[0] / len(x), 1e-6)
        return float(np.sum((share(a) - share(e)) * np.log(share(a) / share(e))))
    assert all(abs(p[k] - numpy_psi(base[k], live[k])) < 1e-9 for k in live)
    k = {r.feature: r for r in drift.ks(long(base), long(live)).collect()}
    grid = np.sort(np.concatenate([base["shift"], live["shift"]]))
    cdf = lambda x: np.searchsorted(np.sort(x), grid, side="right") / len(x)
    assert abs(k["shift"].ks - np.abs(cdf(base["shift"]) - cdf(live["shift"])).max()) < 1e-12
    assert k["shift"].p_value < 0.05 < k["same"].p_value and k["gone"].ks == 0.0 and k["gone"].p_value == 1.0


def test_drift_report_counts_since_the_last_cycle(spark):
    scores = frame(spark, [("a", 0.3), ("b", 0.1)], "feature string, psi double")
    marks = frame(spark, [(1,), (5,), (9,)], "ts_us bigint")
    r = drift.drift_report(scores, 0.9, 0.8, 0.95, marks, marks.limit(0), 4).first()
    assert r.action == "retrain_triggered" and r.corrections == 2 and r.decoy_sessions == 0 and r.scores == {"a": 0.3, "b": 0.1}


# --- fields and contract ---


def test_fields(spark):
    df = frame(spark, [("Infinity", 443), ("x", 5), (" 1e3 ", None)], "v string, p int")
    got = df.select(fields.number_or_zero(F.col("v")).alias("n"), fields.int_or_null(F.col("v")).alias("i"),
                    fields.port_host("10.60", F.col("p")).alias("h"), fields.protocol_by_port(F.col("p"), F.lit(53)).alias("pr")).collect()
    assert [tuple(r) for r in got] == [(0.0, None, "10.60.1.187", "tcp"), (0.0, None, "10.60.0.5", "udp"), (1000.0, 1000, "10.60.0.0", "udp")]


def test_labels(spark):
    df = frame(spark, [("Web Attack – XSS", "DDOS attack-HOIC", "DrDoS_LDAP", "Recon-PortScan"), ("nope", "Bot", "Label", "Spoofing")], "a string, b string, c string, d string")
    got = df.select(labels.category_2017(F.col("a")), labels.category_2018(F.col("b")), labels.category_2019(F.col("c")), labels.category_capture(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [("r2l", "dos", "dos", "probe"), (None, None, None, None)]
    paths = frame(spark, [("benign_labeled", "features-light_benign"), ("other", "features-light_benign"), ("other", "heavy_1")], "d string, f string")
    got = paths.select(labels.path_class([F.col("d"), F.col("f")], labels.DNS_CATEGORY).alias("c")).collect()
    assert [r.c for r in got] == ["normal", None, "lateral_movement"]


def test_contract_rules(spark):
    entries = frame(spark, [("detection", "system"), ("gossip", "system"), ("correction", "operator:7"), ("correction", "bob")], "entry_type string, actor string")
    assert [r.reject_reason for r in contract.check_audit(entries).collect()] == [None, "unknown_entry_type", None, "bad_actor"]
    made = frame(spark, [("block", ["on_allowlist"], 900), ("dry_run", ["gray_zone"], 900), ("dry_run", ["whim"], None)], "action string, reason_codes array<string>, ttl_seconds int")
    assert [r.reject_reason for r in contract.check_decisions(made).collect()] == [None, "ttl_without_block", "unknown_reason"]
    sessions = frame(spark, [("s", "1.1.1.1", 22, "ssh", "2026-01-01 00:00:00", "2026-01-01 00:00:02.5", ["root"], ["ls"])],
                     "session_id string, source_ip string, dest_port int, decoy_service string, started_at string, ended_at string, credentials_tried array<string>, commands_typed array<string>")
    timed = sessions.withColumn("started_at", F.to_timestamp("started_at")).withColumn("ended_at", F.to_timestamp("ended_at"))
    event = contract.check_events(fields.sessions_to_events(timed)).first()
    assert event.duration_ms == 2500 and event.honeypot_detail.session_duration_ms == 2500 and event.reject_reason is None


def test_exact_ks_tail_counts_all_orders(spark):
    from itertools import combinations
    from math import comb

    from flowlens.operators.drift import exact_ks_tail

    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3), (6, 4)):
        gaps = []
        for own in combinations(range(n + m), n):
            i = j = worst = 0
            for place in range(n + m):
                i, j = (i + 1, j) if place in own else (i, j + 1)
                worst = max(worst, abs(i * m - j * n))
            gaps.append(worst)
        for gap in range(n * m + 2):
            assert exact_ks_tail(n, m, gap) == pytest.approx(sum(g >= gap for g in gaps) / comb(n + m, n), abs=1e-12)
    # Where samples are large the count and the series agree.
    assert abs(exact_ks_tail(3000, 2500, round(0.035 * 3000 * 2500)) - 0.0695) < 0.004
    rows = lambda values: spark.createDataFrame([("f", float(v)) for v in values], "feature string, value double")
    got = drift.ks(rows([1, 2, 3, 4, 5]), rows([3.5, 6, 7])).first()
    assert got.ks == pytest.approx(2 / 3 + 0.0, abs=0.14) and got.p_value == pytest.approx(exact_ks_tail(5, 3, round(got.ks * 15)))
