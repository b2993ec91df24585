"""Line dedup by site-relative frequency: lines on more than a share of a host's pages are boilerplate.

Pass one hashes every line (128 bits), keeps each once per page and counts pages per host and line; partial sums absorb
hot hosts and hot lines. A host has at most ``mean lines per page / ratio`` lines above the ratio, so the boilerplate of
a host is one bounded row. Pass two drops lines in place: pages are never taken apart and regrouped. The boilerplate
table is written with its size known, so Spark broadcasts it only under its threshold; above, a join on the host runs,
which adaptive execution splits for a hot host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import fresh, stored

RATIO = 0.02
MIN_PAGES = 5

_BLANK = " \t\n\x0b\x0c\r"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _mark(line: Column) -> Column:
    """Two independent 64-bit hashes of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def _blank(line: Column) -> Column:
    """Nothing but ASCII white space."""
    return F.btrim(line, F.lit(_BLANK)) == ""


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """``_host, _marks``: marks of the lines that stand on at least ``min_pages`` pages and over ``ratio`` of them all."""
    lines = F.filter(_lines(text), lambda x: ~_blank(x))
    pages = docs.select(F.col(host).cast("string").alias("_host"),
                        F.array_distinct(F.transform(lines, _mark)).alias("_marks"))
    totals = pages.groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    seen = (pages.select("_host", F.explode("_marks").alias("_mark"))
            .groupBy("_host", "_mark").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_pages))
    return (seen.join(totals.withColumnRenamed("_host", "_h"), F.col("_host").eqNullSafe(F.col("_h")))
            .filter(F.col("_n") > F.lit(ratio) * F.col("_pages"))
            .groupBy("_host").agg(F.collect_list("_mark").alias("_marks")))


def drop_boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """The documents with boilerplate lines gone from ``text``, and counts ``n_lines``, ``n_dropped``.

    Every row counts as a page, repeated rows too. Lines are compared byte by byte. Blank lines (ASCII white space only) are never boilerplate.
    Null text stays null with 0 lines; the empty text has one (blank) line. Null hosts are one host. A count column whose
    name the table already has gets a trailing underscore. An empty table gives an empty result.
    """
    marks = stored(boilerplate(docs, text, host, ratio, min_pages))
    # The table's own columns may have any name, so what is added takes names that are free.
    at, bad, left = (fresh(docs.columns, name) for name in ("_bh", "_bm", "_kept"))
    known = marks.select(F.col("_host").alias(at), F.col("_marks").alias(bad))
    joined = docs.join(known, docs[host].cast("string").eqNullSafe(known[at]), "left")
    kept = F.when(F.col(bad).isNull(), _lines(text)).otherwise(
        F.filter(_lines(text), lambda x: _blank(x) | ~F.array_contains(F.col(bad), _mark(x))))
    before = F.coalesce(F.size(_lines(text)), F.lit(0)).cast("bigint")
    after = F.coalesce(F.size(left), F.lit(0)).cast("bigint")
    n_lines, n_dropped = fresh(docs.columns, "n_lines"), fresh(docs.columns, "n_dropped")
    return joined.withColumn(left, kept).select(
        *[F.array_join(left, "\n").alias(text) if c == text else docs[c] for c in docs.columns],
        before.alias(n_lines), (before - after).alias(n_dropped))
