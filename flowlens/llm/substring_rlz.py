"""Substring dedup by relative Lempel-Ziv factors: each document is parsed against the documents with smaller ids.

The reference is every document, indexed by its blocks of ``WINDOW`` words. A document is factored greedily: from a block
that starts in an earlier document the factor runs on, block by block, as long as the same reference document goes on; where
it ends, the block at the border is looked up afresh. Factors of at least ``WINDOW`` words are duplicate spans.

Not every block has to be looked up. Each block is filed under the smallest of its ``GRAM``-word hashes (its anchor;
neighbouring blocks share them, about one word in five is one). Equal blocks have equal anchors, so a block whose anchor
stands in one document only has no equal elsewhere:

1. anchors of all documents, counted by smallest and largest id (summed up before the shuffle);
2. the places of anchors that stand in several documents, as one list per document;
3. the blocks filed under them, each with the first document it starts in, joined back to the later documents;
4. factors per document, which remove their words.

Exact copies of a smaller document are known from their hashes and skip 2 and 3. Joins on a frequent anchor or block are
plain equality joins, which adaptive execution splits. Blocks are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import cut, prepare
from flowlens.llm.tokens import NOT_SPACE, words_of

WINDOW = 13
GRAM = 5
_NONE = np.uint64(2 ** 64 - 1)
#: Anchors are shuffled with 48 bits; two that meet by chance only cost look-ups.
_SHORT = np.uint64(16)


def _blocks(words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every block, the word its anchor starts at, and the anchor hashes by word."""
    value, at = words.shingles(GRAM)
    gram = np.full(len(words.hash), _NONE)
    gram[at] = value
    n = len(gram) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), gram
    start = np.flatnonzero(words.doc[:n] == words.doc[window - 1:])
    inner = window - GRAM + 1
    smallest = np.lib.stride_tricks.sliding_window_view(gram, inner)[:n].argmin(1)
    return start, start + smallest[start], gram


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchors(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_g, _id, _p``: every anchor of ``_id, _text`` once per place."""
    def run(batches):
        for batch in batches:
            for low, _, words in words_of(batch.column(1), NOT_SPACE):
                _, place, gram = _blocks(words, window)
                place = np.unique(place)
                owner = words.doc[place]
                yield pa.RecordBatch.from_arrays(
                    [_signed(gram[place] >> _SHORT), batch.column(0).take(pa.array(owner + low)),
                     pa.array((place - words.first[owner]).astype(np.int32))], ["_g", "_id", "_p"])
    return docs.mapInArrow(run, f"_g long, _id {docs.schema['_id'].dataType.simpleString()}, _p int")


def blocks_at(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``_w, _id, _th, _p``: the blocks of ``_id, _text, _th, _ps`` whose anchor stands at one of the places ``_ps``."""
    def run(batches):
        for batch in batches:
            for low, high, words in words_of(batch.column(1), NOT_SPACE):
                start, place, _ = _blocks(words, window)
                lists = batch.column(3).slice(low, high - low)
                marked = np.zeros(len(words.hash) + 1, bool)
                places = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = np.diff(lists.offsets.to_numpy())
                at = places + np.repeat(words.first[:-1], sizes)
                # An id may come with several texts; places beyond the end of this one belong to another.
                marked[at[at < np.repeat(words.first[1:], sizes)]] = True
                start = start[marked[place]]
                owner = words.doc[start]
                value, first = words.shingles(window)
                picked = value[np.searchsorted(first, start)]
                take = pa.array(owner + low)
                yield pa.RecordBatch.from_arrays(
                    [_signed(picked), batch.column(0).take(take), batch.column(2).take(take),
                     pa.array((start - words.first[owner]).astype(np.int32))], ["_w", "_id", "_th", "_p"])
    return docs.mapInArrow(run, f"_w long, _id {docs.schema['_id'].dataType.simpleString()}, _th int, _p int")


def factors(places: np.ndarray, sources: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Greedy factors, as (first word, number of words), of the found blocks in order of their places."""
    if not len(places):
        return []
    new = np.flatnonzero((np.diff(places) != 1) | (sources[1:] != sources[:-1])) + 1
    low = np.concatenate([[0], new])
    high = np.concatenate([new, [len(places)]]) - 1
    return [(int(places[a]), int(places[b] - places[a] + window)) for a, b in zip(low, high, strict=True)]


_KEPT = "n_words long, n_removed long, n_factors long, kept_sha256 string, kept string"


def _without_factors(texts: pa.Array, marks: pa.Array, found: pa.Array, copies: pa.Array, window: pa.Array,
                     want: pa.Array) -> pa.Array:
    out = {"n_words": [], "n_removed": [], "n_factors": [], "kept_sha256": [], "kept": []}
    for i in range(len(texts)):
        words = (texts[i].as_py() or "").encode().split()
        mark, size = marks[i].as_py(), window[i].as_py()
        keep = np.ones(len(words), bool)
        parsed: list[tuple[int, int]] = []
        if len(words) >= size and copies[i].values is not None and mark in copies[i].as_py():
            parsed = [(0, len(words))]
        elif found[i].values is not None and len(found[i].values):
            entries = found[i].values
            own = entries.field("_th").to_numpy(zero_copy_only=False) == mark
            places = entries.field("_p").to_numpy(zero_copy_only=False)[own]
            order = np.argsort(places, kind="stable")
            sources = np.array(entries.field("_src").to_pylist(), object)[own][order]
            places, first = np.unique(places[order], return_index=True)
            parsed = factors(places, sources[first], size)
        for start, length in parsed:
            keep[start: start + length] = False
        left = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k)
        out["n_words"].append(len(words))
        out["n_removed"].append(int(len(words) - keep.sum()))
        out["n_factors"].append(len(parsed))
        out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
        out["kept"].append(left.decode() if want[i].as_py() else None)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


def dedup_substrings(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW,
                     texts: bool = False) -> DataFrame:
    """``key, n_words, n_removed, n_factors, kept_sha256`` (and ``kept`` if ``texts``), one row per document.

    Words are runs of anything but ASCII white space; null text has none. A document with a null id is neither a reference
    nor parsed. Texts that share an id are no references for each other. Repeated rows repeat the result. A document
    under ``window`` words keeps them all. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    every = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    base = every.filter("_id is not null")
    mark = F.coalesce(F.xxhash64("_text"), F.lit(0))
    hashed = cut(base.select("_id", mark.alias("_a"), F.xxhash64(F.lit(1), "_text").alias("_b")))
    first = (hashed.groupBy("_a", "_b").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi")).filter("_lo < _hi"))
    rows = hashed.join(first, ["_a", "_b"], "left").select(
        "_id", F.shiftright("_a", 32).cast("int").alias("_th"), F.coalesce(F.col("_id") > F.col("_lo"), F.lit(False)).alias("_copy"))
    copied = cut(rows.groupBy("_id").agg(F.min("_copy").alias("_all"),
                                         F.collect_set(F.when(F.col("_copy"), F.col("_th"))).alias("_copies")))
    found = anchors(base, window)
    # A result of its own, so that the join below has a shuffle on both sides and a frequent anchor can be split.
    shared = cut(found.groupBy("_g").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi")).filter("_lo < _hi").select("_g"))
    spots = cut(found.join(shared, "_g").join(copied.filter("_all").select("_id"), "_id", "left_anti")
                .groupBy("_id").agg(F.collect_list("_p").alias("_ps")))
    opened = base.join(spots, "_id").select("_id", "_text", F.shiftright(mark, 32).cast("int").alias("_th"), "_ps")
    blocks = blocks_at(opened, window)
    known = cut(blocks.groupBy("_w").agg(F.min("_id").alias("_src"), F.max("_id").alias("_hi")).filter("_src < _hi")
                .select("_w", "_src"))
    later = blocks.join(known, "_w").filter("_src < _id").select("_id", F.struct("_th", "_p", "_src").alias("_f"))
    parsed = later.groupBy("_id").agg(F.collect_list("_f").alias("_fs"))
    known_ids = copied.join(parsed, "_id", "left").select("_id", "_copies", "_fs")
    matched = base.join(known_ids, "_id").select(
        "_id", "_text", F.shiftright(mark, 32).cast("int").alias("_th"), "_fs", "_copies")
    nameless = every.filter("_id is null").select(
        "_id", "_text", F.lit(0).alias("_th"), F.lit(None).cast(matched.schema["_fs"].dataType).alias("_fs"),
        F.lit(None).cast("array<int>").alias("_copies"))
    result = matched.union(nameless).select(
        F.col("_id").alias(key), F.arrow_udf(_without_factors, _KEPT)("_text", "_th", "_fs", "_copies", F.lit(window), F.lit(texts)).alias("_r"))
    names = ["n_words", "n_removed", "n_factors", "kept_sha256"] + ["kept"] * texts
    return result.select(key, *[F.col("_r")[n].alias(n) for n in names])
