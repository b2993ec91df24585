"""Label quality: vectors that carry several classes, ceilings, duplicates and host overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_key(columns: Sequence[str], exact: bool = True) -> Column:
    """Key of a feature vector: sha256 of the joined values, or the 32-bit checksum form."""
    joined = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in columns])
    return F.sha2(joined, 256) if exact else F.crc32(joined)


def map_key(features: str | Column = "features") -> Column:
    """Key of a feature map, independent of its entry order."""
    entries = F.array_sort(F.map_entries(features))
    return F.sha2(F.concat_ws("\u001f", F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), 256)


def vector_classes(rows: DataFrame, key: str = "key", category: str = "category") -> DataFrame:
    """Rows per (vector, class): everything below is computed from this one aggregate."""
    return rows.groupBy(key, category).agg(F.count(F.lit(1)).alias("n"))


def per_vector(counted: DataFrame, key: str = "key") -> DataFrame:
    """Per vector: rows, classes and the rows of its majority class."""
    return counted.groupBy(key).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"), F.max("n").alias("majority"))


def ambiguous_vectors(rows: DataFrame, key: str = "key", category: str = "category") -> DataFrame:
    """Vectors seen with more than one class."""
    return per_vector(vector_classes(rows, key, category), key).filter(F.col("classes") > 1)


def drop_ambiguous(rows: DataFrame, key: str = "key", category: str = "category") -> DataFrame:
    return rows.join(ambiguous_vectors(rows, key, category).select(key), key, "left_anti")


def dedupe_first(rows: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """First row of each vector; a partial aggregate, so copies fold before the shuffle."""
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("r"))
    return first.select("r.*")


def label_ceiling(rows: DataFrame, key: str = "key", category: str = "category") -> DataFrame:
    """Best accuracy any function of the vector can reach."""
    vectors = per_vector(vector_classes(rows, key, category), key)
    return vectors.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("majority"), F.lit(0)).alias("majority_rows"),
        (F.sum("majority").cast("double") / F.sum("rows").cast("double")).alias("ceiling"))


def label_quality(rows: DataFrame, key: str = "key", category: str = "category") -> DataFrame:
    """One wide row of totals, duplicate and ambiguous shares and the ceiling."""
    vectors = per_vector(vector_classes(rows, key, category), key)
    total = F.sum("rows").cast("double")
    shared = F.col("classes") > 1
    in_shared = F.coalesce(F.sum(F.when(shared, F.col("rows"))), F.lit(0))
    return vectors.agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("distinct_vectors"),
        (1 - F.count(F.lit(1)).cast("double") / total).alias("duplicate_row_fraction"),
        F.count_if(shared).alias("ambiguous_vectors"),
        in_shared.alias("rows_in_ambiguous_vectors"),
        (in_shared.cast("double") / total).alias("ambiguous_row_fraction"),
        (F.sum("majority").cast("double") / total).alias("deterministic_ceiling"))


def label_quality_by_class(rows: DataFrame, key: str = "key", category: str = "category") -> DataFrame:
    """Per class: rows, vectors, ambiguous share, and what is left once ambiguous vectors are dropped."""
    counted = vector_classes(rows, key, category)
    flagged = counted.join(per_vector(counted, key).select(key, "classes"), key)
    shared = F.col("classes") > 1
    ambiguous = F.coalesce(F.sum(F.when(shared, F.col("n"))), F.lit(0))
    return flagged.groupBy(category).agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("distinct_vectors"),
        (ambiguous.cast("double") / F.sum("n").cast("double")).alias("ambiguous_row_fraction"),
        (F.sum("n") - ambiguous).alias("rows_after_guard"),
        F.count_if(~shared).alias("vectors_after_guard"))


def category_counts(rows: DataFrame, category: str = "category") -> DataFrame:
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"))


def drop_counts(rows: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """Refused rows by reason."""
    return rows.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def _hosts(rows: DataFrame, source: str, label: str, attack: str, benign: str, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys, source).agg(
        F.bool_or(F.col(label) == attack).alias("attacks"),
        F.bool_or(F.col(label) == benign).alias("benign"),
        F.count_if(F.col(label) == benign).alias("benign_rows"))


def host_overlap(rows: DataFrame, source: str = "source_ip", label: str = "label",
                 attack: str = "flood", benign: str = "benign", listed: int = 10) -> DataFrame:
    """Hosts that attack, hosts that are benign, hosts that do both, and the first few of those by name."""
    hosts = _hosts(rows, source, label, attack, benign, [])
    both = F.col("attacks") & F.col("benign")
    counts = hosts.agg(F.count_if("attacks").alias("attack_hosts"), F.count_if("benign").alias("benign_hosts"),
                       F.count_if(both).alias("shared_hosts"))
    first = hosts.filter(both).orderBy(source).limit(listed).agg(
        F.array_join(F.sort_array(F.collect_list(F.col(source))), ",").alias("first_shared"))
    return counts.withColumn("first_shared", first.scalar())


def drop_contaminated(rows: DataFrame, keys: Sequence[str], source: str = "source_ip", label: str = "label",
                      attack: str = "flood", benign: str = "benign") -> DataFrame:
    """Removes benign rows of hosts that attack within the same key."""
    keys = list(keys)
    attackers = rows.filter(F.col(label) == attack).select(*keys, source).distinct().withColumn("_hit", F.lit(True))
    joined = rows.join(attackers, [*keys, source], "left")
    return joined.filter(~((F.col(label) == benign) & F.col("_hit").isNotNull())).select(*rows.columns)


def contaminated_counts(rows: DataFrame, keys: Sequence[str], source: str = "source_ip", label: str = "label",
                        attack: str = "flood", benign: str = "benign") -> DataFrame:
    """Per key: hosts on each side, shared hosts and the benign rows they cost."""
    hosts = _hosts(rows, source, label, attack, benign, keys)
    both = F.col("attacks") & F.col("benign")
    return hosts.groupBy(*keys).agg(
        F.count_if("attacks").alias("attack_hosts"), F.count_if("benign").alias("benign_hosts"),
        F.count_if(both).alias("shared_hosts"),
        F.coalesce(F.sum(F.when(both, F.col("benign_rows"))), F.lit(0)).alias("benign_rows_dropped"))


def survey(rows: DataFrame, keys: Sequence[str], label: str = "label", attack: str = "flood",
           benign: str = "benign", ts: str = "ts_us") -> DataFrame:
    """Per key: rows, class rows, benign share, span in hours, first and last time."""
    hours = (F.max(ts) - F.min(ts)).cast("double") / 3.6e9
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(label) == attack).alias("attack_rows"),
        F.count_if(F.col(label) == benign).alias("benign_rows"),
        (F.count_if(F.col(label) == benign).cast("double") / F.count(F.lit(1))).alias("benign_fraction"),
        hours.alias("span_hours"), F.min(ts).alias("first_us"), F.max(ts).alias("last_us"))


def source_concentration(rows: DataFrame, keys: Sequence[str], source: str = "source_ip") -> DataFrame:
    """Distinct sources, rows per source and the share of the busiest source."""
    per = rows.groupBy(*keys, source).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sources"),
        (F.sum("n").cast("double") / F.count(F.lit(1))).alias("rows_per_source"),
        (F.max("n").cast("double") / F.sum("n").cast("double")).alias("top_share"))
