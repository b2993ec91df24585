"""The online pipeline: two independent lanes over one event stream, decisions, log, cold path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import audit, decide, graph
from flowlens.operators.flows import endpoint
from flowlens.operators.windows import packed_key
from flowlens.schemas import (BREAKER_CAP, BREAKER_WINDOW_SECONDS, FLOW_ACTIVE_SECONDS, FLOW_IDLE_SECONDS, MICROS,
                              WINDOW_SECONDS)
from flowlens.streaming import state

WINDOW_US = int(WINDOW_SECONDS * MICROS)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Keys per shard that its windows are dealt over; part of the state's layout, like the schemas.
WINDOW_SLOTS = 64
#: Keys that the sources of a feature stream are dealt over, likewise.
SOURCE_SLOTS = 512


def use_state_store(spark: SparkSession) -> None:
    """The stateful processors need the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def clocked(events: DataFrame, delay: str, held: bool = False) -> DataFrame:
    """Adds the event-time column of the processors and its watermark.

    Spark drops rows behind its watermark before a processor can count them. ``held`` keeps that watermark a horizon further back;
    the processors reckon the watermark of ``delay`` from it, mark what is behind and let it through.
    """
    late = f"{state.HORIZON_MS // 1000} seconds {delay}" if held else delay
    return events.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", late)


def stream_features(events: DataFrame, window_us: int = WINDOW_US, delay: str = "10 seconds") -> DataFrame:
    """Fast lane: trailing features per source. Rows behind the watermark are marked ``late`` and have no features."""
    use_state_store(events.sparkSession)
    delay_us = events.sparkSession.sql(f"select unix_micros(timestamp_seconds(0) + interval {delay})").first()[0]
    text = events.select(F.col("src").cast("string").alias("src"), "seq", "ts_us", "dst", "port", "bytes", "duration_ms")
    # A key per source would be mostly calls and state lookups: sources share the keys of their slots.
    slot = F.pmod(F.crc32(F.coalesce("src", F.lit(""))), F.lit(SOURCE_SLOTS)).cast("int")
    return clocked(text.withColumn("slot", slot), delay, held=True).groupBy("slot").transformWithStateInPandas(
        statefulProcessor=state.TrailingFeatures(window_us, delay_us), outputStructType=state.FEATURE_ROWS,
        outputMode="Append", timeMode="EventTime", eventTimeColumnName="event_time")


def stream_windows(events: DataFrame, width_us: int = WINDOW_US, delay: str = "10 seconds", grace_us: int = 0) -> DataFrame:
    """Deep lane: anchored windows per stream as counts per host pair and port; late rows are marked."""
    use_state_store(events.sparkSession)
    text = events.withColumn("src", F.col("src").cast("string")).withColumn("stream", F.col("stream").cast("string"))
    return clocked(text, delay, held=True).groupBy("stream").transformWithStateInPandas(
        statefulProcessor=state.AnchoredWindows(width_us, grace_us), outputStructType=state.WINDOW_ROWS,
        outputMode="Append", timeMode="EventTime")


def stream_aligned_edges(events: DataFrame, width: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """Scalable deep lane: epoch-aligned edges, pre-aggregated before the shuffle and free of per-key order."""
    return clocked(events, delay).groupBy(F.window("event_time", width), "src", "dst").agg(
        F.sum("bytes").cast("double").alias("bytes"), F.count(F.lit(1)).alias("flow_count"),
        F.avg("duration_ms").alias("duration_mean_ms"),
    ).select(F.unix_micros("window.start").alias("window_start"), "src", "dst", "bytes", "flow_count", "duration_mean_ms")


def stream_port_counts(events: DataFrame, width: str = "2 seconds", delay: str = "10 seconds") -> DataFrame:
    """Epoch-aligned deep lane: counts per window, host pair and port, each window whole in the batch that closes it.

    ``graph.edges``, ``graph.nodes`` and ``graph.window_vectors`` take them from there, key ``window_start``.
    """
    src = F.col("src").cast("string").alias("src")
    return clocked(events, delay).groupBy(F.window("event_time", width), src, "dst", "port").agg(
        F.count(F.lit(1)).alias("flows"), F.sum(F.col("bytes").cast("bigint")).alias("bytes"),
        F.sum(F.col("duration_ms").cast("bigint")).alias("duration"),
    ).select(F.unix_micros("window.start").alias("window_start"), "src", "dst", "port", "flows", "bytes", "duration")


def stream_flows(packets: DataFrame, idle_us: int = int(FLOW_IDLE_SECONDS * MICROS),
                 active_us: int = int(FLOW_ACTIVE_SECONDS * MICROS), delay: str = "10 seconds") -> DataFrame:
    """Flows from a live packet stream."""
    use_state_store(packets.sparkSession)
    a, b = endpoint("src_ip", "src_port"), endpoint("dst_ip", "dst_port")
    keyed = packets.withColumn("_a", F.to_json(F.least(a, b))).withColumn("_b", F.to_json(F.greatest(a, b)))
    keyed = keyed.withColumn("flow_key", packed_key(["capture", "_a", "_b", "protocol"])).drop("_a", "_b")
    return clocked(keyed, delay).groupBy("flow_key").transformWithStateInPandas(
        statefulProcessor=state.OpenFlow(idle_us, active_us), outputStructType=state.FLOW_ROWS,
        outputMode="Append", timeMode="EventTime")


def stream_gate(verdicts: DataFrame, cap: int = BREAKER_CAP, window_us: int = BREAKER_WINDOW_SECONDS * MICROS,
                ttl_us: int | None = None, delay: str = "10 seconds") -> DataFrame:
    """Per verdict: is its window resolved, is the shard's cap reached. Input carries ``on_allowlist``.

    Without ``ttl_us`` a resolved window stays resolved, as in the batch rule, and the state keeps its id. With it the id is
    forgotten that long after it acted: choose it longer than a verdict can be late, or a late one acts again.
    """
    use_state_store(verdicts.sparkSession)
    ready = verdicts.withColumn("breaker_tripped", F.lit(False)).withColumn("acts", decide.acts())
    narrow = ready.select(F.col("shard").cast("string").alias("shard"), "seq", "ts_us", "window_id", "acts", "on_allowlist")
    return clocked(narrow, delay).groupBy("shard").transformWithStateInPandas(
        statefulProcessor=state.DecisionGate(cap, window_us, ttl_us), outputStructType=state.FLAG_ROWS,
        outputMode="Append", timeMode="EventTime")


def stream_decisions(verdicts: DataFrame, cap: int = BREAKER_CAP, window_us: int = BREAKER_WINDOW_SECONDS * MICROS,
                     ttl_us: int | None = None) -> DataFrame:
    """Verdicts of a stream through first action, cap and policy table, as ``decide.decide`` does for a table.

    Input: the columns of ``state.VERDICT_ROWS`` but ``acts``, with the event time of an operator before. Windows resolve
    within their shard. A late verdict keeps its row and gets no decision.
    """
    ready = verdicts.withColumn("breaker_tripped", F.lit(False)).withColumn("acts", decide.acts() & ~F.col("late"))
    narrow = ready.select(*state.names(state.VERDICT_ROWS))
    # A key per window would be a key per verdict, nearly: windows share the keys of their shard's slots.
    slot = F.pmod(F.crc32(F.coalesce("window_id", F.lit(""))), F.lit(WINDOW_SLOTS)).cast("int")
    first = narrow.withColumn("slot", slot).groupBy("shard", "slot").transformWithStateInPandas(
        statefulProcessor=state.FirstActions(ttl_us), outputStructType=f"{state.VERDICT_ROWS}, already_resolved boolean",
        outputMode="Append", timeMode="EventTime", eventTimeColumnName="event_time")
    asks = F.col("acts") & ~F.col("already_resolved") & ~F.col("on_allowlist")
    lane = F.when(asks, F.concat(F.lit("cap/"), "shard")).otherwise(F.concat(F.lit("pass/"), slot.cast("string")))
    capped = first.withColumn("asks", asks).withColumn("lane", lane).groupBy("lane").transformWithStateInPandas(
        statefulProcessor=state.ActionCap(cap, window_us),
        outputStructType=f"{state.VERDICT_ROWS}, already_resolved boolean, breaker_tripped boolean",
        outputMode="Append", timeMode="EventTime", eventTimeColumnName="event_time")
    return decide.policy(capped)


def online(events: DataFrame, verdicts: Callable[[DataFrame], DataFrame], allowlist: DataFrame, window_us: int = WINDOW_US,
           cap: int = BREAKER_CAP, cap_window_us: int = BREAKER_WINDOW_SECONDS * MICROS, ttl_us: int | None = None,
           delay: str = "10 seconds") -> DataFrame:
    """The fast lane as one streaming query: features, score, verdict, gate and policy, one row out per event in.

    ``verdicts`` turns feature rows into verdict rows (``shard, verdict_id, window_id, tier, label, confidence, target``, keeping
    ``seq, ts_us, event_time, late``); the three stateful steps pass the event time on. ``fan_out`` writes what comes out.
    """
    judged = verdicts(stream_features(events, window_us, delay))
    return stream_decisions(decide.flag_allowlist(judged, allowlist), cap, cap_window_us, ttl_us)


def fan_out(folder: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch of ``online`` to ``decisions``, ``late`` and the hash-chained ``log``; each step replaces its own repeat."""
    log, decisions, late = log_decisions(f"{folder}/log"), to_table(f"{folder}/decisions"), to_table(f"{folder}/late")
    last = keep_last_decisions(f"{folder}/last")

    def write(batch: DataFrame, number: int) -> None:
        # Every sink below reads the batch, and the stateful steps behind it are not run again for each.
        batch.persist()
        try:
            on_time = batch.filter(~F.col("late")).drop("event_time", "acts").withColumn(
                "decision_id", F.concat(F.lit("d-"), "verdict_id"))
            decisions(on_time, number)
            late(batch.filter("late").select("shard", "seq", "ts_us"), number)
            if not on_time.isEmpty():
                log(on_time, number)
                last(on_time, number)
        finally:
            batch.unpersist()
    return write


def start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """Starts one lane with its own checkpoint; lanes share nothing and never wait for each other."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def to_table(folder: str) -> Callable[[DataFrame, int], None]:
    """Batch writer whose repeat after a failure replaces its own output."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
    return write


def finished_graphs(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes of the windows emitted in a batch (a window leaves the state whole)."""
    whole = windows.filter(~F.col("late"))
    keys = ["stream", "window_start"]
    return graph.edges(whole, keys), graph.nodes(whole, keys)


def newest_batch(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The table that the newest finished batch (before a number) has written, None if there is none."""
    done = [n for n in _batches(spark, folder) if before is None or n < before]
    return spark.read.parquet(f"{folder}/batch={max(done)}") if done else None


def append_log(folder: str) -> Callable[[DataFrame, int], None]:
    """Appends entries (``chain, seq, entry_id, ts_us, entry_type, payload, actor``) to the hash-chained log.

    Beside the log lies a table of tips, one row per chain and batch; a batch reads only the newest one before it.
    """
    def write(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        tips = newest_batch(spark, f"{folder}-tips", number)
        audit.append_chain(rows, tips).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        newest = audit.chain_tips(spark.read.parquet(f"{folder}/batch={number}"))
        if tips is not None:
            newest = newest.unionByName(tips.join(newest.select("chain"), "chain", "left_anti"))
        newest.write.mode("overwrite").parquet(f"{folder}-tips/batch={number}")
    return write


def log_decisions(folder: str, chain: str = "shard") -> Callable[[DataFrame, int], None]:
    """Fan-out of decided verdicts into the hash-chained log, one chain per shard."""
    append = append_log(folder)

    def write(batch: DataFrame, number: int) -> None:
        rows = audit.decision_rows(batch).filter(F.col("entry_type") != "job")
        rows = rows.join(batch.select("seq", F.col(chain).cast("string").alias("chain")), "seq").select(
            "chain", (F.col("seq") * 4 + F.col("step")).alias("seq"),
            F.concat_ws("-", "verdict_id", F.col("step").cast("string")).alias("entry_id"), "ts_us", "entry_type", "payload",
            F.lit("system").alias("actor"))
        append(rows, number)
    return write


def keep_last_decisions(folder: str) -> Callable[[DataFrame, int], None]:
    """The last decision of every target as a small table per batch: the one before it with this batch's laid over."""
    def write(batch: DataFrame, number: int) -> None:
        newest = batch.filter(F.col("action").isNotNull()).select(
            F.col("target"), F.struct("ts_us", "seq", "decision_id", "shard").alias("d"))
        before = newest_batch(batch.sparkSession, folder, number)
        if before is not None:
            newest = newest.unionByName(before.select("target", F.struct("ts_us", "seq", "decision_id", "shard").alias("d")))
        newest.groupBy("target").agg(F.max("d").alias("d")).select("target", "d.*").write.mode("overwrite").parquet(f"{folder}/batch={number}")
    return write


def record_corrections(decisions: str, out: str) -> Callable[[DataFrame, int], None]:
    """Operator corrections (``correction_id, target, operator, is_false_positive, ts_us, seq``) as audit rows.

    Each one names the last decision of its target, from the newest table of ``keep_last_decisions``; one without is an
    error row. ``log`` gets the audit rows (one chain per shard, actor ``operator:<name>``), ``reversals`` the blocks that end,
    ``errors`` what had no decision, and ``drift`` the counts of the batch.
    """
    append = append_log(f"{out}/log")

    def write(batch: DataFrame, number: int) -> None:
        known = newest_batch(batch.sparkSession, decisions)
        last = (known.select("target", "decision_id", "shard") if known is not None else
                batch.select("target").limit(0).withColumns({"decision_id": F.lit(""), "shard": F.lit("")}))
        was = F.when(F.col("is_false_positive"), "false_positive").otherwise("true_positive")
        found = batch.join(last, "target", "left").withColumn("verdict_was", was).persist()
        try:
            hit = found.filter(F.col("decision_id").isNotNull())
            body = F.to_json(F.struct("decision_id", "operator", "verdict_was"))
            append(hit.select(F.concat(F.lit("corrections-"), "shard").alias("chain"), F.col("seq").cast("bigint").alias("seq"),
                              F.col("correction_id").alias("entry_id"), "ts_us", F.lit("correction").alias("entry_type"),
                              body.alias("payload"), F.concat(F.lit("operator:"), "operator").alias("actor")), number)
            # A reversal takes effect even where no decision is known to correct.
            for name, rows in (("reversals", found.filter("is_false_positive").select("target", "ts_us", "seq")),
                               ("errors", found.filter("decision_id is null").select(
                                   "correction_id", "target", F.lit("no_decision_for_target").alias("error"))),
                               ("drift", found.agg(F.count_if(F.col("decision_id").isNotNull()).alias("corrections"),
                                                   F.count_if(F.col("decision_id").isNotNull() & F.col("is_false_positive")).alias("false_positives")))):
                rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            found.unpersist()
    return write


def tail_log(spark: SparkSession, folder: str) -> DataFrame:
    """Incremental read of the log: each run continues where its checkpoint stopped."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", False).parquet(folder)


def explain_batch(folder: str, out: str) -> Callable[[DataFrame, int], None]:
    """Cold path: detections that were logged and decided and are not benign, explained; rejected verdicts are not."""
    def write(batch: DataFrame, number: int) -> None:
        fields = "verdict_id string, tier string, label string, confidence double, window_id string"
        seen = batch.filter(F.col("entry_type") == "detection").select(F.from_json("payload", fields).alias("p")).select("p.*")
        empty = F.array().cast("array<string>")
        refused = batch.filter(F.col("entry_type") == "policy_decision").select(
            F.from_json("payload", "verdict_id string, rejected boolean").alias("p")).filter("p.rejected").select("p.verdict_id")
        seen = seen.join(refused, "verdict_id", "left_anti")
        notes = audit.narratives(seen.filter(F.col("label") != "benign").withColumn("node_ids", empty).withColumn("edge_ids", empty))
        notes.withColumn("job_id", F.concat(F.lit("job-"), "verdict_id")).write.mode("overwrite").parquet(f"{out}/batch={number}")
    return write


def log_explanations(log: str, out: str) -> Callable[[DataFrame, int], None]:
    """``explain_batch`` with an audit row per note: job, verdict, narrative and technique, chained beside the decisions."""
    explain, append = explain_batch(log, out), append_log(f"{out}-log")

    def write(batch: DataFrame, number: int) -> None:
        explain(batch, number)
        place = batch.filter(F.col("entry_type") == "detection").select(
            F.get_json_object("payload", "$.verdict_id").alias("verdict_id"), "chain", "seq", "ts_us")
        notes = batch.sparkSession.read.parquet(f"{out}/batch={number}").join(place, "verdict_id")
        body = F.to_json(F.struct("job_id", "narrative", "technique_id", "verdict_id"))
        append(notes.select(F.concat(F.lit("explanations-"), "chain").alias("chain"), "seq", F.col("job_id").alias("entry_id"), "ts_us",
                            F.lit("explanation").alias("entry_type"), body.alias("payload"), F.lit("explainer").alias("actor")), number)
    return write


def correct_batch(decisions: str, out: str) -> Callable[[DataFrame, int], None]:
    """Corrections: find the decision, log it or its error; a false positive is a reversal for the block table."""
    def write(batch: DataFrame, number: int) -> None:
        known = batch.sparkSession.read.parquet(decisions)
        found = decide.resolve_corrections(batch, known)
        found.withColumn("reverses", (F.col("verdict_was") == "false_positive") & F.col("error").isNull()).write.mode(
            "overwrite").parquet(f"{out}/batch={number}")
    return write


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished batches of a table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    done = lambda p: system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return [int(s.getPath().getName().split("=")[1]) for s in system.listStatus(path)
            if s.getPath().getName().startswith("batch=") and done(s.getPath())]


