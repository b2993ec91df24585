import math
import random
from collections import Counter

from flowlens.operators.trailing import trailing_features


def entropy(values):
    n = len(values)
    return -sum(c / n * math.log2(c / n) for c in Counter(values).values()) if n else 0.0


def brute(rows, window):
    out = {}
    for i, (seq, ts, src, dst, port, size, duration) in enumerate(rows):
        past = [r for r in rows if r[2] == src and r[0] <= seq and ts - r[1] <= window]
        n = len(past)
        out[seq] = (
            n / (window / 1e6), sum(r[5] for r in past) / (window / 1e6),
            entropy([r[4] for r in past if r[4] is not None]), len({r[3] for r in past}),
            sum(r[6] for r in past) / n, sum(r[3] == dst for r in past) / n)
    return out


def check(spark, rows, window, buckets, hot=4_000_000):
    df = spark.createDataFrame(rows, "seq bigint, ts_us bigint, src string, dst string, port int, bytes bigint, duration_ms bigint")
    got = trailing_features(df, window, bucket_windows=buckets, hot_rows=hot).collect()
    want = brute(rows, window)
    assert len(got) == len(rows)
    for r in got:
        pairs = zip((r.event_rate, r.byte_rate, r.dest_port_entropy, r.unique_dest_count,
                     r.avg_duration_ms, r.same_dest_ratio), want[r.seq])
        assert all(abs(a - b) < 1e-9 for a, b in pairs), (r, want[r.seq])


def test_equals_brute_force_across_bucket_edges(spark):
    rng = random.Random(5)
    rows, at = [], 0
    for seq in range(300):
        at += rng.choice([0, 0, 1, 2, 5, 30])
        rows.append((seq, at, rng.choice("aab"), rng.choice("xyz"),
                     rng.choice([None, 80, 443, 53]), rng.randrange(1000), rng.randrange(50)))
    check(spark, rows, 10, 1)
    check(spark, rows, 10, 7)


def test_hot_groups_and_equal_times_are_spread_without_changing_results(spark):
    rng = random.Random(8)
    times = sorted(1_000_000 + (50 if i % 3 else rng.randrange(200)) for i in range(240))
    rows = [(seq, times[seq], "hot" if seq % 5 else "b", rng.choice("xyz"),
             rng.choice([None, 80, 443]), rng.randrange(1000), rng.randrange(50)) for seq in range(240)]
    check(spark, rows, 40, 2, hot=30)


def test_exactly_one_window_old_is_in_and_later_peers_are_not(spark):
    rows = [(1, 0, "a", "x", 80, 10, 1), (2, 2_000_000, "a", "x", 80, 10, 1), (3, 2_000_000, "a", "y", 81, 10, 1),
            (4, 2_000_001, "a", "x", 80, 10, 1)]
    check(spark, rows, 2_000_000, 30)


def test_burst_on_one_port_has_no_entropy(spark):
    rows = [(i, i * 10_000, "a", "x", 80, 100, 5) for i in range(50)]
    df = spark.createDataFrame(rows, "seq bigint, ts_us bigint, src string, dst string, port int, bytes bigint, duration_ms bigint")
    last = trailing_features(df).orderBy("seq").collect()[-1]
    assert last.dest_port_entropy == 0.0 and last.same_dest_ratio == 1.0 and last.event_rate > 20
