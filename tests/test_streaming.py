import math
import random
import types
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.operators import audit, decide, flows
from flowlens.operators.trailing import FEATURES, trailing_features
from flowlens.operators.windows import anchored_windows, window_bounds
from flowlens.sources.streams import file_events, keyed_messages
from flowlens.streaming import lanes, state

EVENT = "seq bigint, ts_us bigint, stream string, src string, dst string, port int, bytes bigint, duration_ms bigint"
S = 1_000_000


@pytest.fixture(autouse=True)
def narrow(spark):
    """Two state partitions: every one costs a Python worker per micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture()
def feed(spark, tmp_path):
    """Writes rows in batches (each shuffled inside) and returns them as a stream."""
    def build(rows, schema, parts):
        rng, size = random.Random(1), -(-len(rows) // parts)
        for i in range(parts):
            part = rows[i * size:(i + 1) * size]
            rng.shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return file_events(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_batch=1)
    return build


def run(stream, tmp_path, name, handle=None):
    out = str(tmp_path / name)
    lanes.start(stream, handle or lanes.to_table(out), str(tmp_path / f"{name}-state"), once=True).awaitTermination(300)
    return stream.sparkSession.read.parquet(out)


def events(n=160):
    rng, at, rows = random.Random(3), 1_700_000_000 * S, []
    for seq in range(n):
        at += rng.choice([0, 100_000, 400_000, 900_000, 5 * S if rng.random() < 0.1 else 50_000])
        rows.append((seq, at, rng.choice("pq"), rng.choice("abc"), rng.choice("xyz"), rng.choice([None, 80, 53]), rng.randrange(900), rng.randrange(40)))
    return rows


def test_features_equal_the_batch_operator(spark, feed, tmp_path):
    rows = events()
    got = run(lanes.stream_features(feed(list(rows), EVENT, 3)), tmp_path, "features")
    want = trailing_features(spark.createDataFrame(rows, EVENT))
    pick = lambda df: [tuple(round(float(v), 9) for v in r) for r in df.select("seq", *FEATURES).orderBy("seq").collect()]
    assert pick(got) == pick(want)


def test_windows_equal_the_batch_operator(spark, feed, tmp_path):
    rows = events()
    got = run(lanes.stream_windows(feed(list(rows), EVENT, 3), delay="0 seconds"), tmp_path, "windows")
    assert got.filter("late").count() == 0
    sizes = {(r.stream, r.window_start): r.n for r in got.groupBy("stream", "window_start").agg(F.sum("flows").alias("n")).collect()}
    bounds = window_bounds(anchored_windows(spark.createDataFrame(rows, EVENT), 2 * S, ["stream"]), ["stream"]).collect()
    want = {(b.stream, b.window_start): b.n_events for b in bounds}
    assert {k: v for k, v in want.items() if k in sizes} == sizes
    assert {(b.stream, b.window_start) for b in bounds if b.closed} <= set(sizes)
    edges, nodes = lanes.finished_graphs(got)
    assert edges.agg(F.sum("flow_count")).first()[0] == sum(sizes.values()) == nodes.agg(F.sum("degree_in")).first()[0]


def test_aligned_edges_and_lane_independence(spark, feed, tmp_path):
    rows = events()
    stream = feed(list(rows), EVENT, 2)
    fast = run(lanes.stream_features(stream), tmp_path, "fast")
    edges = run(lanes.stream_aligned_edges(stream, delay="0 seconds"), tmp_path, "edges")
    assert fast.count() == len(rows)
    frame = spark.createDataFrame(rows, EVENT).withColumn("w", F.col("ts_us") - F.pmod("ts_us", F.lit(2 * S)))
    want = {(r.w, r.src, r.dst): r.n for r in frame.groupBy("w", "src", "dst").agg(F.count("*").alias("n")).collect()}
    got = {(r.window_start, r.src, r.dst): r.flow_count for r in edges.collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(want) - len(got) <= 6


def test_flows_equal_the_batch_operator(spark, feed, tmp_path):
    rng, at, rows = random.Random(9), 1_700_000_000 * S, []
    for seq in range(200):
        at += rng.choice([S, 2 * S, 8 * S, 45 * S if rng.random() < 0.2 else S])
        a, b = rng.sample(["1.1.1.1", "2.2.2.2", "3.3.3.3"], 2)
        rows.append((seq, at, "c", a, b, 10, 10, "tcp", rng.randrange(40, 900)))
    schema = "seq bigint, ts_us bigint, capture string, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, length int"
    got = run(lanes.stream_flows(feed(list(rows), schema, 4), delay="0 seconds"), tmp_path, "flows")
    want = flows.assemble_flows(spark.createDataFrame(rows, schema))
    pick = lambda df: {(r.start_us, r.source_ip, r.end_us, r.packets, r.total_bytes, r.packets_fwd, r.bytes_fwd) for r in df.collect()}
    assert pick(got) <= pick(want) and len(pick(want) - pick(got)) <= 3


def test_gate_log_tail_and_explanations(spark, feed, tmp_path):
    rng, rows = random.Random(4), []
    for seq in range(120):
        rows.append((seq, (10_000 + seq * 9) * S, rng.choice("st"), f"v{seq}", f"w{rng.randrange(50)}", "bouncer",
                     rng.choice(["flood", "benign", "uncertain"]), rng.choice([0.4, 0.9, 0.95]), rng.choice(["h1", "h2"])))
    schema = ("seq bigint, ts_us bigint, shard string, verdict_id string, window_id string, tier string, label string, "
              "confidence double, target string")
    allow = spark.createDataFrame([("h2",)], "ip string")
    stream = decide.flag_allowlist(feed(list(rows), schema, 3), allow)
    flags = run(lanes.stream_gate(stream, cap=2), tmp_path, "flags")
    frame = spark.createDataFrame(rows, schema)
    # Windows resolve per shard in the stream, so the batch side scopes them the same way.
    scoped = frame.withColumn("window_id", F.concat_ws("/", "shard", "window_id"))
    want = {r.seq: (r.already_resolved, r.breaker_tripped) for r in decide.decide(scoped, allow, ["shard"], 2).collect()}
    assert {r.seq: (r.already_resolved, r.breaker_tripped) for r in flags.collect()} == want
    decided = decide.policy(decide.flag_allowlist(frame, allow).join(flags.drop("shard"), "seq")).withColumn(
        "decision_id", F.concat(F.lit("d"), "seq"))
    log = str(tmp_path / "log")
    for number, low in enumerate((0, 60)):
        lanes.log_decisions(log)(decided.filter(F.col("seq").between(low, low + 59)), number)
    stored = spark.read.parquet(log)
    assert all(r.intact for r in audit.verify_chains(stored).collect())
    notes = run(lanes.tail_log(spark, log), tmp_path, "notes", lanes.explain_batch(log, str(tmp_path / "notes")))
    assert notes.count() == frame.filter("label <> 'benign'").count()
    assert spark.read.parquet(f"{log}-tips/batch=1").count() == 2
    lanes.explain_batch(log, str(tmp_path / "refused"))(spark.createDataFrame(
        [("detection", '{"verdict_id":"a","label":"flood"}'), ("policy_decision", '{"verdict_id":"a","rejected":true}'),
         ("detection", '{"verdict_id":"b","label":"flood"}')], "entry_type string, payload string"), 0)
    assert [r.verdict_id for r in spark.read.parquet(str(tmp_path / "refused")).collect()] == ["b"]
    decided.select("target", "ts_us", "seq", "decision_id").write.parquet(str(tmp_path / "decisions"))
    asks = spark.createDataFrame([("c", "h1", 10**12, 999, True), ("d", "nobody", 10**12, 1000, True)],
                                 "correction_id string, target string, ts_us bigint, seq bigint, is_false_positive boolean")
    lanes.correct_batch(str(tmp_path / "decisions"), str(tmp_path / "fixes"))(asks, 0)
    assert {(r.correction_id, r.reverses) for r in spark.read.parquet(str(tmp_path / "fixes")).collect()} == {("c", True), ("d", False)}


def test_messages_are_keyed_by_source(spark):
    row = spark.createDataFrame([("e", "1.1.1.1", 5)], "event_id string, source_ip string, bytes bigint")
    assert keyed_messages(row).first()["key"] == "1.1.1.1"


# --- state layout, late rows and the whole lane -------------------------------------------------


class Kept:
    """State handle of one key that counts what is written."""

    def __init__(self):
        self.data, self.written, self.timers = {}, 0, []

    def cell(self, name):
        kept = self

        def put(rows):
            kept.data[name] = list(rows)
            kept.written += len(kept.data[name])

        def append(rows):
            kept.data.setdefault(name, []).extend(rows)
            kept.written += len(rows)

        def update(value):
            kept.data[name] = value
            kept.written += 1

        def update_value(key, value):
            kept.data.setdefault(name, {})[key] = value
            kept.written += 1
        return types.SimpleNamespace(
            put=put, appendList=append, update=update, updateValue=update_value, clear=lambda: kept.data.pop(name, None),
            exists=lambda: name in kept.data, get=lambda: kept.data.get(name, []), iterator=lambda: list(kept.data.get(name, {}).items()))

    def getListState(self, name, schema):
        return self.cell(name)

    getValueState = getMapState = lambda self, name, *schema: self.cell(name)

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


def clock(ms=0):
    return types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)


def frame_of(rows):
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in EVENT.split(", ")]).drop(columns="stream")
    return out.assign(event_time=pd.to_datetime(out["ts_us"], unit="us"))


def test_a_batch_writes_its_own_events_only():
    rows = [(i, 1_700_000_000 * S + i * 10_000, "p", "a", "xyz"[i % 3], 80, 5, 1) for i in range(1200)]
    store, lane = Kept(), state.TrailingFeatures(2 * S)
    lane.init(store)
    got, writes = [], []
    for low in range(0, len(rows), 40):
        before = store.written
        got += [f for f in lane.handleInputRows(("a",), iter([frame_of(rows[low:low + 40])]), clock())]
        writes.append(store.written - before)
    assert max(writes) <= 41 and sum(len(v) for k, v in store.data.items() if k.startswith("bucket")) <= 2 * 200
    assert pd.concat(got)["n"].tolist() == [min(i + 1, 201) for i in range(1200)]
    store, lane = Kept(), state.AnchoredWindows(10 * S)
    lane.init(store)
    for low in range(0, 900, 30):
        before = store.written
        list(lane.handleInputRows(("p",), iter([frame_of(rows[low:low + 30])]), clock()))
        assert store.written - before <= 4


def test_gate_state_is_one_time_per_window_and_a_capped_list_per_shard():
    stores = {}
    columns = {c: None for c in state.names(state.VERDICT_ROWS)}
    for i in range(500):
        store = stores.setdefault(i % 250, Kept())
        gate = state.FirstAction()
        gate.init(store)
        frame = pd.DataFrame([{**columns, "seq": i, "ts_us": i, "acts": True}])
        assert next(gate.handleInputRows(("s", f"w{i % 250}"), iter([frame]), clock()))["already_resolved"].tolist() == [i >= 250]
    assert all(s.data == {"first": (i,)} for i, s in stores.items())
    store, cap = Kept(), state.ActionCap(5, 100)
    cap.init(store)
    for i in range(300):
        next(cap.handleInputRows(("cap/s",), iter([pd.DataFrame([{**columns, "seq": i, "ts_us": i, "acts": True, "asks": True, "already_resolved": False}])]), clock()))
        assert len(store.data["taken"]) <= 5
    store = Kept()
    cap.init(store)
    list(cap.handleInputRows(("pass/w",), iter([pd.DataFrame([{**columns, "seq": 1, "ts_us": 1, "acts": False, "asks": False, "already_resolved": False}])]), clock()))
    assert store.data == {}


def test_on_time_and_late_rows_are_the_input(spark, feed, tmp_path):
    rows = events(120)
    late = [(1000 + i, rows[10][1] + i, "p", "a", "x", 80, 5, 1) for i in range(7)]
    given = rows[:80] + rows[80:100] + late[:4] + rows[100:] + late[4:]
    got = run(lanes.stream_features(feed(given, EVENT, 3), delay="1 seconds"), tmp_path, "features")
    assert sorted(r.seq for r in got.collect()) == sorted(r[0] for r in given)
    marked = {r.seq for r in got.filter("late").collect()}
    assert {r[0] for r in late} <= marked and got.filter("late and n is not null").count() == 0
    # The rule: behind the newest event of the batches before, less the delay.
    size, newest, want = -(-len(given) // 3), None, set()
    for low in range(0, len(given), size):
        want |= {r[0] for r in given[low:low + size] if newest is not None and r[1] < (newest // 1000) * 1000 - S}
        newest = max([r[1] for r in given[low:low + size]] + [newest or 0])
    assert marked == want
    windows = run(lanes.stream_windows(feed(given, EVENT, 3), delay="1 seconds"), tmp_path, "windows")
    counts = {r.late: r.n for r in windows.groupBy("late").agg(F.sum("flows").alias("n")).collect()}
    assert counts.get(True, 0) >= len(late)


def judged(features):
    return decide.fast_verdicts(features.withColumn("p_flood", F.least(F.col("n") / 4, F.lit(1.0)))).select(
        "seq", "ts_us", "event_time", "late", "tier", "label", "confidence", F.concat(F.lit("v"), "seq").alias("verdict_id"),
        F.concat_ws("-", "src", F.floor(F.col("ts_us") / (3 * S)).cast("string")).alias("window_id"),
        F.when(F.col("src") == "a", "left").otherwise("right").alias("shard"), F.concat(F.lit("t"), "src").alias("target"))


def test_the_online_lane_equals_the_batch_path(spark, feed, tmp_path):
    rows, out = events(240), str(tmp_path / "lane")
    late = [(5000, rows[5][1], "p", "a", "x", 80, 5, 1)]
    allow = spark.createDataFrame([("tc",)], "ip string")
    lane = lanes.online(feed(rows + late, EVENT, 5), judged, allow, 2 * S, 2, 20 * S, delay="1 seconds")
    lanes.start(lane, lanes.fan_out(out), str(tmp_path / "lane-state"), once=True).awaitTermination(300)
    features = trailing_features(spark.createDataFrame(rows, EVENT), keys=["src"], window_us=2 * S).withColumn(
        "event_time", F.timestamp_micros("ts_us")).withColumn("late", F.lit(False))
    want = decide.decide(judged(features), allow, ["shard"], 2, 20 * S)
    pick = lambda df: {r.seq: (r.label, round(r.confidence, 9), r.already_resolved, r.breaker_tripped, r.action) for r in df.collect()}
    got = spark.read.parquet(f"{out}/decisions")
    assert got.select("batch").distinct().count() >= 4 and {v[4] for v in pick(want).values()} >= {"block", "dry_run"}
    assert pick(got) == pick(want)
    assert [r.seq for r in spark.read.parquet(f"{out}/late").collect()] == [5000]
    log = spark.read.parquet(f"{out}/log")
    assert all(r.intact for r in audit.verify_chains(log).collect())
    assert log.filter("entry_type = 'detection'").count() == len(rows)
    acted = want.filter(F.col("action").isin("block", "throttled")).count()
    assert log.filter("entry_type = 'enforcement'").count() == acted > 0
    # Cold path and corrections, each with audit rows of its own.
    run(lanes.tail_log(spark, f"{out}/log"), tmp_path, "notes", lanes.log_explanations(f"{out}/log", str(tmp_path / "notes")))
    told = spark.read.parquet(str(tmp_path / "notes-log"))
    assert told.count() == want.filter("label <> 'benign' and action is not null").count()
    assert all(r.intact for r in audit.verify_chains(told).collect()) and {r.entry_type for r in told.collect()} == {"explanation"}
    asks = spark.createDataFrame([("c1", "ta", "kim", True, 10**16, 1), ("c2", "ta", "kim", False, 10**16, 2), ("c3", "nobody", "kim", True, 10**16, 3)],
                                 "correction_id string, target string, operator string, is_false_positive boolean, ts_us bigint, seq bigint")
    fixes = str(tmp_path / "fixes")
    lanes.record_corrections(f"{out}/last", fixes)(asks, 0)
    rows_ = {r.entry_id: r for r in spark.read.parquet(f"{fixes}/log").collect()}
    last = want.filter("target = 'ta' and action is not null").agg(F.max_by("verdict_id", F.struct("ts_us", "seq"))).first()[0]
    assert set(rows_) == {"c1", "c2"} and rows_["c1"].actor == "operator:kim" and f'"decision_id":"d-{last}"' in rows_["c1"].payload
    assert '"verdict_was":"true_positive"' in rows_["c2"].payload
    assert {r.target for r in spark.read.parquet(f"{fixes}/reversals").collect()} == {"ta", "nobody"}
    assert [r.correction_id for r in spark.read.parquet(f"{fixes}/errors").collect()] == ["c3"]
    drift = spark.read.parquet(f"{fixes}/drift").first()
    assert (drift.corrections, drift.false_positives) == (2, 1)


def test_windows_share_a_key_and_keep_a_row_of_state_each():
    """One call takes all windows of a slot; a window resolves as it does with a key of its own."""
    rng, columns, rows = random.Random(6), {c: None for c in state.names(state.VERDICT_ROWS)}, []
    for i in range(600):
        rows.append({**columns, "seq": i, "ts_us": i, "window_id": rng.choice([None, *[f"w{k}" for k in range(90)]]), "acts": rng.random() < 0.3})
    want, done = [], set()
    for r in rows:
        want.append(r["window_id"] in done)
        if r["acts"]:
            done.add(r["window_id"])
    store = Kept()
    store.getMapState = lambda name, *schema: types.SimpleNamespace(
        **vars(store.cell(name)), containsKey=lambda k: k in store.data.get(name, {}), keys=lambda: list(store.data.get(name, {})))
    gate = state.FirstActions()
    gate.init(store)
    got = []
    for low, high in ((0, 200), (200, 210), (210, 600)):
        mixed = pd.DataFrame(rows[low:high]).sample(frac=1, random_state=1)
        got += [v for f in gate.handleInputRows(("s", 3), iter([mixed]), clock()) for v in f["already_resolved"]]
    assert got == want
    assert store.data["held"] == (len(done),) == (len(store.data["first"]),)


def test_closed_windows_leave_in_frames_of_bounded_size():
    rows = [(i, 1_700_000_000 * S + i * 10_000, "p", f"h{i % 7}", "xyz"[i % 3], [80, None][i % 2], 5, 1) for i in range(60_000)]
    store, lane = Kept(), state.AnchoredWindows(S)
    lane.init(store)
    mixed = frame_of(rows).sample(frac=1, random_state=2)
    got = list(lane.handleInputRows(("p",), iter([mixed.iloc[:25_000], mixed.iloc[25_000:]]), clock()))
    assert len(got) > 1 and max(len(f) for f in got) <= 2 * lane.FRAME
    made = pd.concat(got)
    assert made["flows"].sum() == 60_000 - 100 and made.groupby("window_start")["flows"].sum().eq(100).all()
    assert made["port"].isna().sum() > 0 and set(made["port"].dropna()) == {80}


def test_micro_batches_grow_with_the_events(spark, monkeypatch):
    from flowlens.plans import online

    assert online.batches(spark, "/root/testdata/sf0.001") == online.PARTS
    monkeypatch.setattr(online, "BATCH_ROWS", 100)
    assert online.batches(spark, "/root/testdata/sf0.001") == -(-spark.read.parquet("/root/testdata/sf0.001/events.parquet").count() // 100)


def in_the_window(e, seen, window_us):
    """The features of an event by their definition, from all events of its source."""
    held = [h for h in seen if h[3] == e[3] and e[1] - window_us <= h[1] and (h[1], h[0]) <= (e[1], e[0])]
    ports = Counter(h[5] for h in held if h[5] is not None)
    known, span, n = sum(ports.values()), window_us / S, len(held)
    return (n, n / span, sum(h[6] for h in held) / span, -sum(c / known * math.log2(c / known) for c in ports.values()),
            len({h[4] for h in held}), sum(h[7] for h in held) / n, sum(h[4] == e[4] for h in held) / n)


@pytest.mark.parametrize("unit", [1, 1 << 53])
def test_sources_share_a_key_and_have_windows_of_their_own(unit):
    """One call takes all sources of a slot; rows that come late within the delay still find their whole window."""
    rng, rows = random.Random(8), []
    for seq in range(900):
        at = 1_700_000_000 * S + seq // 3 * 60_000 - rng.choice([0, 0, 1_500_000])
        rows.append((seq, at, "p", rng.choice([None, *"abcdefghij"]), rng.choice("xyz"), rng.choice([None, 80, 53, 22]), rng.randrange(900) * unit, rng.randrange(40)))
    store, lane = Kept(), state.TrailingFeatures(2 * S, 2 * S)
    lane.init(store)
    got, writes = {}, []
    for low, high in ((0, 400), (400, 410), (410, 700), (700, 900)):
        before, mixed = store.written, frame_of(rows[low:high]).sample(frac=1, random_state=1)
        for f in lane.handleInputRows((3,), iter([mixed.iloc[:7], mixed.iloc[7:]]), clock()):
            assert not f["late"].any() and (f["event_time"] == pd.to_datetime(f["ts_us"], unit="us")).all()
            got.update({r.seq: (r.src, tuple(r)[3:10]) for r in f.itertuples(index=False)})
        writes.append(store.written - before)
        for e in rows[low:high]:
            src, features = got[e[0]]
            assert src == e[3] and features == pytest.approx(in_the_window(e, rows[:high], 2 * S), abs=1e-9)
    assert len(got) == 900 and max(writes) <= state.TrailingFeatures.SLOTS + 1
    list(lane.handleExpiredTimer((3,), clock(), None))
    assert store.data == {}


def test_a_feature_stream_has_a_bounded_number_of_keys(spark, feed, tmp_path):
    rows = [(i, 1_700_000_000 * S + i, "p", f"h{i}", "x", 80, 5, 1) for i in range(1500)]
    out, seen = lanes.stream_features(feed(rows, EVENT, 1)), []

    def keep(batch, number):
        seen.append(batch.count())
    query = lanes.start(out, keep, str(tmp_path / "state"), once=True)
    query.awaitTermination(300)
    assert seen[0] == 1500
    # One row of ring slots, one block and the timer rows of each key.
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) < 1500 * 2
