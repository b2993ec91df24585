"""Mixing sources to target weights: repetition rates per source, whole copies plus one Bernoulli copy.

The sizes of all documents are summed per source (partial sums before the shuffle, so a hot source costs one row per
task). Targets are the capped proportional shares: ``target = min(cap * size, level * weight)`` with the one level at
which the targets add up to the total. The level is found among the sources ordered by ``size / weight`` with
two-level running sums, so the number of sources is unbounded too. Every document is then taken ``floor(rate)`` times
plus one more time where a draw, seeded by its id and text and equal on every run, falls under the fraction of the rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import cut, fresh, md5_unit, stored
from flowlens.operators.scan import row_positions, running_sums

#: ASCII white space as the contract names it.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``_source, _total`` -> also ``_target``: the capped share of all sizes.

    Sources by code point, null last, take the weights in turn. A source of size 0 has target 0.
    """
    named = sizes.select("_source", "_total",
                         F.concat(F.when(F.col("_source").isNull(), "1").otherwise("0"),
                                  F.coalesce("_source", F.lit(""))).alias("_order"))
    placed = row_positions(named, ["_order"], name="_place")
    turn = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]),
                        (F.col("_place") % len(weights) + 1).cast("int"))
    weighed = cut(placed.withColumn("_weight", turn).withColumn("_ratio", F.col("_total") / F.col("_weight")))
    run = running_sums(weighed, ["_ratio", "_order"],
                       {"_sum": F.col("_total"), "_wsum": F.col("_weight")})
    whole = weighed.agg(F.struct(F.sum("_total").alias("all"), F.sum("_weight").alias("w"))).scalar()
    # A source is below its cap where the level that the sources before it leave over does not reach its cap.
    over = run.withColumn("_level", (whole["all"] - cap * (F.col("_sum") - F.col("_total")))
                          / (whole["w"] - (F.col("_wsum") - F.col("_weight"))))
    level = over.filter(cap * F.col("_ratio") >= F.col("_level")).agg(
        F.min_by("_level", F.struct("_ratio", "_order"))).scalar()
    share = F.least(F.col("_total") * F.lit(float(cap)), level * F.col("_weight"))
    return weighed.select("_source", "_total", share.alias("_target"))


def _size(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_rates(sized: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``_named, _total, _target, _rate`` per source of ``_source, _size``, as a table of known size."""
    targets = source_targets(sized.groupBy("_source").agg(F.sum("_size").alias("_total")), weights, cap)
    rate = F.when(F.col("_total") > 0, F.least(F.col("_target") / F.col("_total"), F.lit(float(cap)))).otherwise(0.0)
    return stored(targets.select(F.col("_source").alias("_named"), "_total", "_target", rate.alias("_rate")))


def _copies(rate: str, key: str, digest: Column, seed: str) -> Column:
    """Whole copies, and one more where the draw of the id and the text falls under the fraction."""
    return F.floor(rate) + (md5_unit(F.lit(seed), key, digest) < F.col(rate) - F.floor(rate)).cast("bigint")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
        weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row per input document: ``key, size, source_size, target, rate, copies, taken``.

    Null or empty text has size 0 and takes nothing; documents of a null source form one source; the draw is
    seeded by id and text, so documents without an id draw by their texts, and rows that repeat both share it. An empty table gives an empty result.
    """
    sized = cut(docs.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("_source"),
                            _size(text).alias("_size"), F.md5(text).alias("_digest")))
    rates = source_rates(sized, weights, cap)
    joined = (sized.join(rates, F.col("_source").eqNullSafe(F.col("_named")))
              .withColumn("_copies", _copies("_rate", "_key", F.col("_digest"), seed)))
    return joined.select(F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_total").alias("source_size"),
                         F.col("_target").alias("target"), F.col("_rate").alias("rate"), F.col("_copies").alias("copies"),
                         (F.col("_size") * F.col("_copies")).alias("taken"))


def copies_of(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
              weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus itself: the documents' columns and ``copy`` (from 0), one row per copy taken.

    A document without words is copied at its source's rate too. A ``copy`` column gets a trailing underscore if there is
    one already.
    """
    rates = source_rates(docs.select(F.col(source).cast("string").alias("_source"), _size(text).alias("_size")), weights, cap)
    # The documents' columns may have any name, so what is added takes names that are free.
    named, rate, times = (fresh(docs.columns, name) for name in ("_named", "_rate", "_copies"))
    rates = rates.select(F.col("_named").alias(named), F.col("_rate").alias(rate))
    joined = (docs.join(rates, docs[source].cast("string").eqNullSafe(rates[named]))
              .withColumn(times, _copies(rate, key, F.md5(text), seed)))
    return joined.filter(F.col(times) > 0).select(
        *[docs[c] for c in docs.columns],
        F.explode(F.sequence(F.lit(0), (F.col(times) - 1).cast("int"))).alias(fresh(docs.columns, "copy")))
