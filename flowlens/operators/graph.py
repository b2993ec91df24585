"""Host graphs per window: edge and node aggregates and the nine-number window vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_VECTOR = (
    "n_edges", "n_nodes", "max_unique_ports", "max_degree_out", "max_degree_in",
    "mean_edge_duration_ms", "mean_edge_bytes", "max_port_entropy", "mean_flow_count",
)


def entropy_of_counts(count: Column) -> Column:
    """Aggregate: Shannon entropy (bits) of a group whose rows are value counts; NULL counts are skipped."""
    total = F.sum(count).cast("double")
    weighted = F.sum(F.when(count > 0, count * F.log2(count.cast("double"))))
    raw = F.when(total > 0, F.greatest(F.lit(0.0), F.log2(total) - weighted / total))
    return F.coalesce(raw, F.lit(0.0)) + F.lit(0.0)


def entropy(df: DataFrame, value: str, keys: Sequence[str], name: str = "entropy") -> DataFrame:
    """Entropy of the non-null values per key: counted first, so a frequent value is one row."""
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("_c"))
    return counts.groupBy(*keys).agg(entropy_of_counts(F.col("_c")).alias(name))


def port_counts(events: DataFrame, window: Sequence[str]) -> DataFrame:
    """The shared first step of edges and nodes: one row per window, host pair and port."""
    return events.groupBy(*window, "src", "dst", "port").agg(
        F.count(F.lit(1)).alias("flows"),
        F.sum(F.col("bytes").cast("bigint")).alias("bytes"),
        F.sum(F.col("duration_ms").cast("bigint")).alias("duration"))


def edges(counted: DataFrame, window: Sequence[str]) -> DataFrame:
    """Edge aggregates from ``port_counts``."""
    return counted.groupBy(*window, "src", "dst").agg(
        F.sum("bytes").cast("double").alias("bytes"),
        F.sum("flows").alias("flow_count"),
        entropy_of_counts(F.when(F.col("port").isNotNull(), F.col("flows"))).alias("port_entropy"),
        (F.sum("duration").cast("double") / F.sum("flows").cast("double")).alias("duration_mean_ms"))


def nodes(counted: DataFrame, window: Sequence[str]) -> DataFrame:
    """Node aggregates from ``port_counts``; degrees count flows and a self-loop adds its bytes twice."""
    zero = F.lit(0).cast("bigint")
    sent = counted.groupBy(*window, "src", "port").agg(
        F.sum("flows").alias("flows"), F.sum("bytes").alias("bytes"))
    sent = sent.select(*window, F.col("src").alias("node"), zero.alias("came"), F.col("flows").alias("went"),
                       "bytes", F.when(F.col("port").isNotNull(), 1).otherwise(0).cast("bigint").alias("ports"))
    received = counted.groupBy(*window, "dst").agg(
        F.sum("flows").alias("flows"), F.sum("bytes").alias("bytes"))
    received = received.select(*window, F.col("dst").alias("node"), F.col("flows").alias("came"),
                               zero.alias("went"), "bytes", zero.alias("ports"))
    return sent.unionByName(received).groupBy(*window, "node").agg(
        F.sum("came").cast("double").alias("degree_in"),
        F.sum("went").cast("double").alias("degree_out"),
        F.sum("bytes").cast("double").alias("bytes_total"),
        F.sum("ports").alias("unique_ports_contacted"))


def window_vectors(counted: DataFrame, window: Sequence[str]) -> DataFrame:
    """Nine statistics per window."""
    per_edge = edges(counted, window).groupBy(*window).agg(
        F.count(F.lit(1)).cast("double").alias("n_edges"),
        F.avg("duration_mean_ms").alias("mean_edge_duration_ms"),
        F.avg("bytes").alias("mean_edge_bytes"),
        F.max("port_entropy").alias("max_port_entropy"),
        F.avg("flow_count").alias("mean_flow_count"))
    per_node = nodes(counted, window).groupBy(*window).agg(
        F.count(F.lit(1)).cast("double").alias("n_nodes"),
        F.max("unique_ports_contacted").cast("double").alias("max_unique_ports"),
        F.max("degree_out").alias("max_degree_out"),
        F.max("degree_in").alias("max_degree_in"))
    return per_edge.join(per_node, list(window)).select(*window, *WINDOW_VECTOR)


def edge_endpoints(edge_rows: DataFrame, node_rows: DataFrame, window: Sequence[str]) -> DataFrame:
    """Edges with the features of both endpoint nodes; byte features as log1p."""
    window = list(window)
    side = lambda end, tag: node_rows.select(
        *window, F.col("node").alias(end),
        F.col("degree_in").alias(f"{tag}_degree_in"), F.col("degree_out").alias(f"{tag}_degree_out"),
        F.log1p("bytes_total").alias(f"{tag}_log_bytes"),
        F.col("unique_ports_contacted").alias(f"{tag}_ports"))
    return (edge_rows.join(side("src", "src"), [*window, "src"]).join(side("dst", "dst"), [*window, "dst"])
            .withColumn("log_bytes", F.log1p("bytes")))

