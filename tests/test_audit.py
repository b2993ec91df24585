from pyspark.sql import functions as F

from flowlens.operators.audit import append_chain, chain_tips, drain_jobs, entry_counts, latest_entries, verify_chains

ENTRY = "chain string, seq bigint, entry_id string, ts_us bigint, entry_type string, payload string, actor string"


def log(spark, n=5, start=0, chains=("a", "b")):
    rows = [(c, i, f"{c}{i}", 1000 + i, "detection", f'{{"x":{i},"é":1}}', "system") for c in chains for i in range(start, start + n)]
    return spark.createDataFrame(rows, ENTRY)


def test_chain_links_and_verifies_and_continues(spark):
    first = append_chain(log(spark)).persist()
    assert first.filter((F.col("seq") == 0) & (F.col("prev_hash") != "0" * 64)).count() == 0
    more = append_chain(log(spark, 4, 5), chain_tips(first))
    checked = {r.chain: (r.entries, r.intact, r.first_broken) for r in verify_chains(first.unionByName(more)).collect()}
    assert checked == {"a": (9, True, None), "b": (9, True, None)}


def test_tampering_is_found_at_its_index(spark):
    good = append_chain(log(spark))
    bad = good.withColumn("payload", F.when((F.col("chain") == "a") & (F.col("seq") == 2), "{}").otherwise(F.col("payload")))
    got = {r.chain: (r.intact, r.first_broken) for r in verify_chains(bad).collect()}
    assert got == {"a": (False, 2), "b": (True, None)}
    gone = good.filter(~((F.col("chain") == "b") & (F.col("seq") == 3)))
    assert {r.chain: r.first_broken for r in verify_chains(gone).collect()} == {"a": None, "b": 4}


def test_latest_and_counts(spark):
    entries = log(spark, chains=("a",))
    assert [r.seq for r in latest_entries(entries, "detection", 2).collect()] == [3, 4]
    assert {r.entry_type: r.n for r in entry_counts(entries).collect()}["correction"] == 0


def test_jobs_use_the_latest_detection_and_drop_unknown(spark):
    jobs = spark.createDataFrame([("j1", "v1"), ("j2", "nope")], "job_id string, verdict_id string")
    seen = spark.createDataFrame(
        [("v1", 1, "w", "bouncer", "uncertain", 0.5, [], []), ("v1", 2, "w", "detective", "port_scan", 0.905, ["a", "b"], ["a->b"])],
        "verdict_id string, seq bigint, window_id string, tier string, label string, confidence double, node_ids array<string>, edge_ids array<string>")
    (row,) = drain_jobs(jobs, seen).collect()
    assert row.technique_id == "T1046" and "Seen on 1 edge(s) between 2 node(s)." in row.narrative
