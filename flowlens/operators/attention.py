"""Graph-attention scoring of windows from given weights."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.decide import derive_label
from flowlens.session import cut_lineage

CLASSES = ("benign", "port_scan", "lateral_movement")
SLOPE = 0.2


def segment_softmax(edges: DataFrame, window: Sequence[str], score: str, segment: str, name: str = "attention") -> DataFrame:
    """Softmax of ``score`` over the edges that share a segment node, shifted by the window's maximum."""
    window = list(window)
    peaks = edges.groupBy(*window).agg(F.max(score).alias("_peak"))
    raised = edges.join(peaks, window).withColumn("_e", F.exp(F.col(score) - F.col("_peak"))).drop("_peak")
    totals = raised.groupBy(*window, segment).agg(F.sum("_e").alias("_total"))
    return raised.join(totals, [*window, segment]).withColumn(
        name, F.col("_e") / (F.col("_total") + F.lit(1e-12))).drop("_e", "_total")


def top_evidence(edges: DataFrame, window: Sequence[str], weight: str, count: int = 3) -> DataFrame:
    """The heaviest edges per window and their distinct endpoints, sorted; weights equal to nine places tie by name."""
    order = Window.partitionBy(*window).orderBy(F.desc(F.round(weight, 9)), "src", "dst")
    best = edges.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= count)
    edge = F.struct("_rn", F.concat("src", F.lit("->"), "dst").alias("id"))
    return best.groupBy(*window).agg(
        F.transform(F.array_sort(F.collect_list(edge)), lambda e: e["id"]).alias("edge_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("src", "dst"))))).alias("node_ids"))


def window_verdicts(windows: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Verdict label and confidence per window; a window without a graph is benign for sure."""
    joined = windows.join(scores, list(keys), "left")
    confidence = F.coalesce("confidence", F.lit(1.0))
    return joined.select(*keys, derive_label(F.coalesce("predicted", F.lit("benign")), confidence).alias("label"),
                         confidence.alias("confidence"))


# --- scoring with given weights -----------------------------------------------------------------


def _project(weights: dict, layer: int):
    """Vectorised ``h -> (Wh, a1.Wh, a2.Wh)`` for node rows."""
    w, a = np.asarray(weights["layers"][layer]["W"]), np.asarray(weights["layers"][layer]["a"])
    size = w.shape[1]

    @F.pandas_udf("struct<_v:array<double>,_send:double,_receive:double>")
    def project(h: pd.Series) -> pd.DataFrame:
        out = np.stack(h.to_numpy()) @ w
        return pd.DataFrame({"_v": list(out), "_send": out @ a[:size], "_receive": out @ a[size:2 * size]})

    return project


def _edge_terms(weights: dict):
    """Vectorised edge part of the attention score, one value per layer."""
    parts = [np.asarray(p["We"]) @ np.asarray(p["a"])[2 * np.asarray(p["W"]).shape[1]:] for p in weights["layers"]]

    @F.pandas_udf("array<double>")
    def terms(features: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(features.to_numpy()) @ np.stack(parts, axis=1)))

    return terms


def _leaky(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(x * SLOPE)


def score_windows(edges: DataFrame, nodes: DataFrame, window: Sequence[str], weights: dict, evidence: int = 3) -> DataFrame:
    """Verdict, class probabilities and heaviest edges per window, for windows of any size.

    Message passing is joins and grouped sums over the long edge and node tables, so neither a window nor
    a hub host has to fit one task. ``weights``: per layer ``W``, ``We``, ``a``, and the ``classifier``.
    """
    window = list(window)
    feats = edges.select(*window, "src", "dst", F.array(F.log1p("bytes"), F.col("flow_count").cast("double"), "port_entropy",
                                                       "duration_mean_ms").alias("f"))
    links = cut_lineage(feats.withColumn("terms", _edge_terms(weights)("f")).drop("f").withColumn("rollout", F.lit(0.0)))
    state = nodes.select(*window, "node", F.array(
        "degree_in", "degree_out", F.log1p("bytes_total"), F.col("unique_ports_contacted").cast("double")).alias("h"))
    for layer, parts in enumerate(weights["layers"]):
        size = np.asarray(parts["W"]).shape[1]
        projected = cut_lineage(state.select(*window, "node", _project(weights, layer)("h").alias("_p"))
                                .select(*window, "node", "_p._v", "_p._send", "_p._receive"))
        side = lambda end, tag, cols: projected.select(
            *window, F.col("node").alias(end), *[F.col(c).alias(f"{tag}{c}") for c in cols])
        term = F.col("terms")[layer]
        # The scores alone meet their peaks; the vectors are joined to the weights, and summed before they are shuffled.
        ends = links.join(side("src", "s", ["_send", "_receive"]), [*window, "src"]).join(
            side("dst", "d", ["_send", "_receive"]), [*window, "dst"])
        scored = cut_lineage(ends.select(
            *links.columns, _leaky(F.col("s_send") + F.col("d_receive") + term).alias("ahead"),
            _leaky(F.col("d_send") + F.col("s_receive") + term).alias("back")))
        peaks = scored.groupBy(*window).agg(F.max(F.greatest("ahead", "back")).alias("peak"))
        weighed = cut_lineage(scored.select(*window, "src", "dst", "ahead", "back").join(peaks, window).select(
            *window, "src", "dst", F.exp(F.col("ahead") - F.col("peak")).alias("ahead"), F.exp(F.col("back") - F.col("peak")).alias("back")))

        def mixed_from(sender: str, receiver: str, weight: str) -> DataFrame:
            sent = weighed.select(*window, sender, F.col(receiver).alias("node"), F.col(weight).alias("e")).join(
                side(sender, "o", ["_v"]), [*window, sender])
            return sent.groupBy(*window, "node").agg(
                F.sum("e").alias("total"), *[F.sum(F.col("e") * F.col("o_v")[k]).alias(f"m{k}") for k in range(size)])

        sums = mixed_from("src", "dst", "ahead").unionByName(mixed_from("dst", "src", "back")).groupBy(*window, "node").agg(
            F.sum("total").alias("total"), F.array(*[F.sum(f"m{k}") for k in range(size)]).alias("mixed"))
        joined = projected.join(sums, [*window, "node"], "left")
        mixed = F.coalesce("mixed", F.array_repeat(F.lit(0.0), size))
        total = F.coalesce("total", F.lit(0.0)) + F.lit(1e-12)
        state = joined.select(*window, "node", F.zip_with(mixed, "_v", lambda m, v: _leaky(m / total + v)).alias("h"))
        shares = segment_softmax(scored.select(*links.columns, F.col("ahead").alias("score")), window, "score", "dst", "share")
        links = cut_lineage(shares.withColumn("rollout", F.col("rollout") + F.col("share")).select(*links.columns))
    size = np.asarray(weights["classifier"]).shape[0]
    pooled = state.groupBy(*window).agg(*[F.avg(F.col("h")[k]).alias(f"g{k}") for k in range(size)])
    logits = [sum((F.col(f"g{k}") * float(np.asarray(weights["classifier"])[k, c]) for k in range(size)), F.lit(0.0))
              for c in range(len(CLASSES))]
    odds = pooled.select(*window, *[x.alias(f"z{c}") for c, x in enumerate(logits)])
    top = F.greatest(*[F.col(f"z{c}") for c in range(len(CLASSES))])
    raised = [F.exp(F.col(f"z{c}") - top) for c in range(len(CLASSES))]
    whole = sum(raised[1:], raised[0])
    probs = odds.select(*window, *[(r / whole).alias(f"p_{name}") for r, name in zip(raised, CLASSES)])
    best = F.greatest(*[F.col(f"p_{c}") for c in CLASSES])
    predicted = None
    for name in CLASSES:
        predicted = F.when(F.col(f"p_{name}") == best, name) if predicted is None else predicted.when(F.col(f"p_{name}") == best, name)
    verdict = probs.withColumn("confidence", best).withColumn("predicted", predicted)
    verdict = verdict.withColumn("label", derive_label(F.col("predicted"), F.col("confidence")))
    found = verdict.join(top_evidence(links, window, "rollout", evidence), window, "left")
    empty = F.array().cast("array<string>")
    quiet = F.col("label") == "benign"
    return found.withColumn("node_ids", F.when(quiet, empty).otherwise(F.col("node_ids"))).withColumn(
        "edge_ids", F.when(quiet, empty).otherwise(F.col("edge_ids"))).withColumn(
        "tier", F.lit("detective")).withColumn("attribution_method", F.lit("attention_rollout"))
