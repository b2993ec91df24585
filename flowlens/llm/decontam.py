"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

* **Seeds.** A window whose five-word shingles overlap an item's by 0.8 shares a shingle with it. Only documents that share
  one are opened, and only windows that hold one are fingerprinted; no other window can pass the last step.
* **SimHash.** The fingerprint of a window as long as the item has 64 bits: bit ``b`` is the majority of bit ``b`` over the
  hashes of its words. Sixteen sums count all 64 bits, four to a sum in lanes of 16 bits.
* **Multi-index.** Fingerprints are four blocks of 16 bits. Two of them at most ``RADIUS`` = 19 apart have a block at most 4
  apart, so each item is filed under every value within 4 of each of its blocks and a window looks up its four blocks:
  all pairs within the radius meet.
* **Verification.** The weighted Jaccard similarity of the two bags of shingles, exactly; 0.8 or more is a leak.

Only DataFrame functions run. The benchmark and the list of opened documents are written with their sizes known, so Spark
broadcasts them only under its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import fresh, prepare, stored

SHINGLE = 5
SIMILARITY = 0.8
#: Four blocks of 16 bits, each searched to distance 4, find every pair within 4 * 4 + 3.
NEAR = 4
RADIUS = 4 * NEAR + 3

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LANES = 0x0001000100010001


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words (letters, digits and everything beyond ASCII)."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)), lambda w: F.xxhash64(w))


def shingles(words: str) -> Column:
    """Hashes of every five consecutive words of the array column ``words``; one to four words are one short shingle."""
    short = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(words) >= SHINGLE, _runs(words, SHINGLE)).otherwise(short)


def _runs(words: str, length: int) -> Column:
    """Hashes of every ``length`` consecutive words; empty if there are fewer."""
    hashed = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(length)])
    if length < SHINGLE:
        hashed = lambda i: F.xxhash64(F.slice(words, i + 1, length))
    last = F.size(words) - length
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), hashed)).otherwise(F.array().cast("array<bigint>"))


def simhash(words: Column, count: Column) -> list[Column]:
    """The four 16-bit blocks of the fingerprint of an array of word hashes."""
    def lanes(j: int) -> Column:
        return F.aggregate(words, F.lit(0).cast("bigint"),
                           lambda acc, h: acc + F.shiftright(h, j).bitwiseAND(F.lit(_LANES)))

    sums = [lanes(j) for j in range(16)]
    blocks = []
    for k in range(4):
        bits = F.lit(0)
        for j, total in enumerate(sums):
            ones = F.shiftright(total, 16 * k).bitwiseAND(F.lit(0xFFFF))
            bits = bits + F.when(ones * 2 > count, F.lit(1 << j)).otherwise(F.lit(0))
        blocks.append(bits.cast("int"))
    return blocks


def _fingerprinted(windows: DataFrame, keep: list[str]) -> DataFrame:
    blocks = simhash(F.col("_ws"), F.size("_ws"))
    return windows.select(*keep, F.array(*blocks).alias("_fp"))


def _weight(a: str, b: str) -> Column:
    """Weighted Jaccard similarity of two arrays as bags."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0),
                         lambda acc, x: acc + F.least(times(F.col(a), x), times(F.col(b), x)))
    return common / (F.size(a) + F.size(b) - common)


def benchmark_items(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``_item, _iid, _l, _iw, _ish``: a name made of id and words, the id, word count, word and shingle hashes.

    Items under five words are one short shingle; those without words take no part.
    """
    words = benchmark.select(F.col(key).alias("_iid"), word_hashes(F.coalesce(F.col(text), F.lit(""))).alias("_iw"))
    name = F.xxhash64(F.coalesce(F.col("_iid").cast("string"), F.lit("")), F.col("_iid").isNull(), "_iw").alias("_item")
    items = words.select(name, "_iid", F.size("_iw").alias("_l"), "_iw", shingles("_iw").alias("_ish"))
    return stored(items.filter(F.col("_l") > 0).distinct())


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id",
               item_key: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``_key, doc id, item id, first_word, similarity``: the best window of each document and item that leaks.

    ``_key`` is (id as text, hash of the text). A document shorter than an item is one window. Null texts have no words.
    Ties go to the first window. Rows that repeat id and text give one row, items that repeat id and text too. A null item
    id is an id like any other. An item under five words leaks where its words stand in a row.
    """
    prepare(docs.sparkSession)
    items = benchmark_items(benchmark, item_key, item_text)
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(key).alias("_id"), body.alias("_text"),
                        F.struct(F.col(key).cast("string").alias("id"), F.xxhash64(body).alias("h")).alias("_key"))
    grams = stored(items.select("_item", "_l", F.explode(F.array_distinct("_ish")).alias("_gram")))
    hashed = keyed.select("_key", word_hashes(F.col("_text")).alias("_w"))
    # One to four words at most: as many more passes over the words as there are such lengths among the items.
    lengths = [r["_l"] for r in items.filter(F.col("_l") < SHINGLE).select("_l").distinct().collect()]
    def grams_of(words: str) -> list[Column]:
        return [_runs(words, k) for k in (SHINGLE, *sorted(lengths))]

    every = grams_of("_w")
    opened = (hashed.select("_key", F.explode(F.concat(*every) if lengths else every[0]).alias("_gram"))
              .join(grams.select("_gram").distinct(), "_gram", "left_semi").select("_key").distinct())
    opened = stored(opened)
    held = stored(keyed.join(opened.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k")), "left_semi")
                  .dropDuplicates(["_key"]).select("_key", "_id", word_hashes(F.col("_text")).alias("_w")))
    last = F.greatest(F.size("_w") - F.col("_l"), F.lit(0))
    spots = held.select("_key", F.posexplode(every[0]).alias("_p", "_gram"))
    for short in every[1:]:
        spots = spots.union(held.select("_key", F.posexplode(short).alias("_p", "_gram")))
    seeds = spots.join(grams, "_gram").select("_key", "_l", "_p").distinct()
    starts = (seeds.join(held.withColumnRenamed("_key", "_k").select("_k", "_w"), F.col("_key").eqNullSafe(F.col("_k")))
              .select("_key", "_l", F.explode(F.sequence(
                  F.greatest(F.col("_p") - F.col("_l") + F.least(F.col("_l"), F.lit(SHINGLE)), F.lit(0)),
                  F.greatest(F.least(F.col("_p"), last), F.lit(0)))).alias("_s")).distinct())
    windows = (starts.join(held.withColumnRenamed("_key", "_k").select("_k", "_w"), F.col("_key").eqNullSafe(F.col("_k")))
               .select("_key", "_l", "_s", F.slice("_w", F.col("_s") + 1, F.col("_l")).alias("_ws")))
    prints = _fingerprinted(windows, ["_key", "_l", "_s"])
    filed = _fingerprinted(items.withColumn("_ws", F.col("_iw")), ["_item", "_l"]).withColumnRenamed("_fp", "_ifp")
    near = F.filter(F.sequence(F.lit(0), F.lit(65535)), lambda m: F.bit_count(m) <= NEAR)
    # About ten thousand rows per item, so the index is shuffled and never broadcast, whatever the planner makes of it.
    index = (filed.select("_item", "_l", F.posexplode("_ifp").alias("_k", "_block"))
             .select("_item", "_l", "_k", "_block", F.explode(near).alias("_m"))
             .select("_item", "_l", "_k", F.col("_block").bitwiseXOR(F.col("_m")).alias("_v")).hint("merge"))
    probes = prints.select("_key", "_l", "_s", "_fp", F.posexplode("_fp").alias("_k", "_v"))
    apart = F.aggregate(F.zip_with("_fp", "_ifp", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    met = probes.join(index, ["_l", "_k", "_v"]).join(filed.select("_item", "_ifp"), "_item")
    pairs = met.filter(apart <= RADIUS).select("_key", "_s", "_item", "_l").distinct()
    known = held.withColumnRenamed("_key", "_k").select("_k", "_id", "_w")
    sided = (pairs.join(known, F.col("_key").eqNullSafe(F.col("_k")))
             .select("_key", "_id", "_s", "_item", F.slice("_w", F.col("_s") + 1, F.col("_l")).alias("_ws"))
             .select("_key", "_id", "_s", "_item", shingles("_ws").alias("_wsh"))
             .join(items.select("_item", "_ish"), "_item"))
    found = sided.withColumn("_sim", _weight("_wsh", "_ish")).filter(F.col("_sim") >= similarity)
    best = found.groupBy("_key", "_item").agg(
        F.max(F.struct(F.col("_sim"), (-F.col("_s")).alias("_s"), F.col("_id"))).alias("_b"))
    return best.join(items.select("_item", "_iid"), "_item").select(
        "_key", F.col("_b._id").alias(key), F.col("_iid").alias(item_key),
        (-F.col("_b._s")).cast("bigint").alias("first_word"), F.col("_b._sim").alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The documents without those that hold a benchmark item."""
    found = find_leaks(docs, benchmark, text, key, **options)
    name = fresh(docs.columns, "_key")
    mark = F.struct(docs[key].cast("string").alias("id"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("h"))
    leaks = stored(found.select(F.col("_key").alias(name)).distinct())
    return docs.join(leaks, mark.eqNullSafe(leaks[name]), "left_anti")
