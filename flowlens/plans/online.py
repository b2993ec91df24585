"""Queries: the streaming operators over the events table read as a stream, and the model operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import decide, graph, models, windows
from flowlens.operators.trailing import FEATURES
from flowlens.plans.decisions import OUTCOME, allowlist
from flowlens.plans.detection import ANCHORED, hourly
from flowlens.plans.flagship import LANE
from flowlens.plans.registry import DAY, FLOW, HOUR, MINUTE, ORACLES, flow, query, rounded, table
from flowlens.session import cut_lineage, shared_folder
from flowlens.sources.streams import file_events
from flowlens.streaming import lanes


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared scratch space."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


PARTS = 3


def staged(spark: SparkSession, sf: str, parts: int = PARTS) -> str:
    """``events`` as files in order of time, one micro-batch each, and a last one that ends the input.

    The end is a row without a user, ten years on: it moves the watermark past every open window.
    """
    folder = f"{scratch(spark)}/in"
    events = table(spark, sf, "events")
    events.repartitionByRange(parts, "ts").sortWithinPartitions("ts").write.parquet(folder)
    gone = lambda c: F.lit(None).cast(events.schema[c].dataType).alias(c)
    end = events.agg(F.max("ts").alias("last")).select(
        *[(F.col("last") + F.expr("interval 10 years")).alias(c) if c == "ts" else gone(c) for c in events.columns])
    end.coalesce(1).write.parquet(f"{folder}-end")
    jvm = spark._jvm.org.apache.hadoop.fs
    path = jvm.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(jvm.Path(f"{folder}-end")):
        if status.getPath().getName().startswith("part-"):
            system.rename(status.getPath(), jvm.Path(folder, "part-end.parquet"))
    found = sorted(s.getPath().getName() for s in system.listStatus(path) if s.getPath().getName().startswith("part-"))
    # The file source takes the oldest files first.
    for i, name in enumerate(found):
        system.setTimes(jvm.Path(folder, name), 1_600_000_000_000 + i * 60_000, -1)
    return folder


#: Events of a micro-batch whose keys are few and each take a large part of it.
BATCH_ROWS = 1_000_000


def batches(spark: SparkSession, sf: str) -> int:
    """Micro-batches of at most about ``BATCH_ROWS`` events, so that what a task holds of a stream does not grow with the input."""
    return max(PARTS, -(-table(spark, sf, "events").count() // BATCH_ROWS))


def event_stream(spark: SparkSession, sf: str, parts: int = PARTS) -> DataFrame:
    raw = file_events(spark, staged(spark, sf, parts), table(spark, sf, "events").schema, glob="part-*", files_per_batch=1)
    return raw.select(
        F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.pmod("user_id", F.lit(4)).alias("stream"), F.col("user_id").alias("src"), F.col("event_type").alias("dst"),
        F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("port"), F.floor(F.col("value") * 100).cast("bigint").alias("bytes"),
        F.pmod(F.col("event_id") * 37, F.lit(500)).alias("duration_ms"))


def drained(stream: DataFrame, handle=None) -> DataFrame:
    """Runs a stream over everything there is and returns what it wrote."""
    spark, folder = stream.sparkSession, scratch(stream.sparkSession)
    # One state partition per core: more of them only add workers to every micro-batch.
    width = "spark.sql.shuffle.partitions"
    before = spark.conf.get(width)
    spark.conf.set(width, str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        lanes.start(stream, (handle or lanes.to_table)(f"{folder}/out"), f"{folder}/state", once=True).awaitTermination()
    finally:
        spark.conf.set(width, before)
    return spark.read.parquet(f"{folder}/out").drop("batch")


@query("stream_trailing_features", ORACLES["trailing_features"])
def stream_trailing_features(spark, sf):
    events = event_stream(spark, sf).filter("seq is not null")
    out = drained(lanes.stream_features(events, DAY)).filter(~F.col("late"))
    fine = [F.round(c, 6 if c == "dest_port_entropy" else 9).alias(c) for c in FEATURES]
    return out.select(F.col("src").cast("bigint").alias("src"), "seq", *fine)


@query("stream_anchored_windows", ANCHORED.format(width=6 * HOUR) + "select stream, window_start, count(*) as n_events from win group by all")
def stream_anchored_windows(spark, sf):
    events = event_stream(spark, sf, batches(spark, sf)).withColumn("src", F.col("src").cast("string")).na.fill("end", ["src", "dst"]).na.fill(0, ["bytes", "duration_ms"])
    out = drained(lanes.stream_windows(events, 6 * HOUR, delay="0 seconds"))
    return out.filter(~F.col("late") & F.col("stream").isNotNull()).groupBy(F.col("stream").cast("bigint").alias("stream"), "window_start").agg(
        F.sum("flows").alias("n_events"))


@query("stream_aligned_edges", f"""with {FLOW} select ts_us - ts_us % {HOUR} as window_start, src, dst, cast(sum(bytes) as double) as bytes,
 count(*) as flow_count, round(avg(duration_ms), 6) as duration_mean_ms from flow group by all""")
def stream_aligned_edges(spark, sf):
    out = drained(lanes.stream_aligned_edges(event_stream(spark, sf), "1 hour", "0 seconds")).filter("src is not null")
    return out.withColumn("duration_mean_ms", F.round("duration_mean_ms", 6))


def streamed_counts(spark, sf):
    return drained(lanes.stream_port_counts(event_stream(spark, sf), "1 hour", "0 seconds")).filter("src is not null")


@query("stream_graph_edges", ORACLES["graph_edges_aligned"])
def stream_graph_edges(spark, sf):
    """Edges with port entropy of the windows a stream has closed, all of them."""
    out = graph.edges(streamed_counts(spark, sf), ["window_start"]).withColumn("src", F.col("src").cast("bigint"))
    return rounded(out, "port_entropy", "duration_mean_ms")


@query("stream_graph_nodes", ORACLES["graph_nodes_aligned"])
def stream_graph_nodes(spark, sf):
    return graph.nodes(streamed_counts(spark, sf), ["window_start"])


def lane_verdicts(features):
    """The fixed score of the fast lane and its verdict columns."""
    logit = F.col("n") * 0.6 + F.col("dest_port_entropy") * 0.4 - F.col("same_dest_ratio") * 2.0 - 2.0
    user = F.col("src").cast("bigint")
    scored = features.withColumn("p_flood", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))
    return decide.fast_verdicts(scored).select(
        "seq", "ts_us", "event_time", "late", "tier", "label", "confidence", F.concat(F.lit("v"), "seq").alias("verdict_id"),
        F.concat(F.lit("w"), "src", F.lit("-"), F.floor(F.col("ts_us") / HOUR).cast("bigint").cast("string")).alias("window_id"),
        F.pmod(user, F.lit(4)).cast("string").alias("shard"),
        F.concat(F.lit("10.0.0."), F.pmod(user, F.lit(50)).cast("string")).alias("target"))


@query("online_fast_lane", LANE + OUTCOME + " select seq, label, round(confidence, 6) as confidence, action, reason from d")
def online_fast_lane(spark, sf):
    """Features, score, gate and policy in one streaming query over several micro-batches; every event's decision."""
    lane = lanes.online(event_stream(spark, sf).filter("seq is not null"), lane_verdicts, allowlist(spark, sf), DAY, 20, HOUR)
    out = drained(lane)
    return out.filter(~F.col("late")).select("seq", "label", F.round("confidence", 6).alias("confidence"), "action",
                                             F.try_element_at("reason_codes", F.lit(1)).alias("reason"))


# --- models: no SQL form, checked by rows here and by value in the tests ---

def fixed_weights(hidden: int = 8, embed: int = 3) -> dict:
    """Small given weights, a smooth function of their position."""
    import numpy as np

    wave = lambda *shape: np.sin(np.arange(int(np.prod(shape))) * 0.7 + len(shape)).reshape(shape) * 0.4
    layers = [{"W": wave(width, hidden), "We": wave(4, embed), "a": wave(2 * hidden + embed)} for width in (4, hidden, hidden)]
    return {"layers": layers, "classifier": wave(hidden, 3)}


@query("attention_verdicts")
def attention_verdicts(spark, sf):
    from flowlens.operators.attention import score_windows

    counted = cut_lineage(hourly(spark, sf))
    keys = ["window_start"]
    scored = score_windows(graph.edges(counted, keys), graph.nodes(counted, keys), keys, fixed_weights())
    return scored.select("window_start", "label", F.round("confidence", 6).alias("confidence"), "edge_ids", "node_ids")


@query("separability_probe")
def separability_probe(spark, sf):
    vectors = graph.window_vectors(hourly(spark, sf), ["window_start"])
    spans = windows.merged_intervals(flow(spark, sf).filter("dst = 'error'"), guard_us=2 * MINUTE)
    labelled = cut_lineage(models.windows_in_attack(vectors, spans, [], DAY))
    return models.separability_probe(labelled, "window_start")


@query("fast_lane_model", f"""with {FLOW} select count(*) as rows, count(*) filter (where dst = 'error') as ones,
 count(*) as in_range, count(*) as named, true as beats_the_share from flow""")
def fast_lane_model(spark, sf):
    """Trains the boosted trees on the trailing features and states what must hold of the scores of all events."""
    from flowlens.operators.trailing import trailing_features

    rows = flow(spark, sf).select("*", (F.col("dst") == "error").cast("int").alias("y"))
    features = cut_lineage(trailing_features(rows, DAY, ["src"], bucket_windows=8).join(rows.select("seq", "y"), "seq"))
    model = models.fit_fast(features, "seq")
    scored = cut_lineage(model.score(features).select("y", "p_flood"))
    share = scored.agg(F.avg("y")).scalar()
    loss = lambda p: -F.avg(F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p)))
    named = decide.fast_verdicts(scored).filter(F.col("label").isin("flood", "benign", "uncertain")).agg(F.count(F.lit(1))).scalar()
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y").alias("ones"), F.count_if(F.col("p_flood").between(0.0, 1.0)).alias("in_range"),
        named.alias("named"), (loss(F.greatest(F.least("p_flood", F.lit(1 - 1e-12)), F.lit(1e-12))) < loss(share)).alias("beats_the_share"))
