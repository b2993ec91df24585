"""License scan: an exact set-similarity join of text blocks with license templates, by containment.

A text block is a line, and a longer line is cut into overlapping windows of ``BLOCK`` words. The words of the whole text are
cut in the same way, and the windows that span a line break are blocks too: every run of ``STEP`` words lies in one block,
however the text is wrapped. Texts that hold too few tokens of every template have no block and are left out first. Tokens are ordered by their frequency over all blocks, rarest first. A template of ``t`` tokens that
must be contained to at least ``THRESHOLD`` needs ``c = ceil(THRESHOLD * t)`` of them, so the first common token of a matching
block is among its first ``t - c + 1``: only those are indexed (prefix filter). A block must hold ``c`` known tokens (length
filter), and at the first common token enough tokens must be left on both sides (positional filter). What passes
is verified by intersecting the sets.

Only DataFrame functions run. The templates are a fixed list, so their index is bounded and broadcast; documents are
scanned twice and only (document, template) hits are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
STEP = 32
THRESHOLD = 0.9

# The phrases and labels of the base scan.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

# Own short forms of the usual notices, by label.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0 1 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "copyright all rights reserved"),
)

_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(column: Column) -> Column:
    return F.translate(column, _UPPER, _LOWER)


def _words(column: Column) -> Column:
    return F.regexp_extract_all(column, F.lit(_WORD), F.lit(0))


def base_places(docs: DataFrame, text: str = "_text") -> DataFrame:
    """Adds ``n_words`` and ``_places``, an array of ``(at, label)`` for each place where a phrase's words stand in a row.

    Words are only built for texts in which the phrases occur at all.
    """
    may = "|".join(_BREAK.join(p.split()) for p in PHRASES.values())
    counted = docs.withColumn("n_words", F.regexp_count(F.col(text), F.lit(_WORD)).cast("bigint"))
    listed = counted.withColumn("_words", F.when(F.col(text).rlike(f"(?i){may}"), _words(_ascii_lower(F.col(text))))
                                .otherwise(F.array().cast("array<string>")))

    def label_at(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for label, phrase in PHRASES.items():
            hit = F.lit(True)
            for j, word in enumerate(phrase.split()):
                hit = hit & F.coalesce(F.get("_words", i + j) == word, F.lit(False))
            out = F.when(hit, label).otherwise(out)
        return out

    spots = F.when(F.size("_words") > 0, F.sequence(F.lit(0), F.size("_words") - 1)).otherwise(F.array().cast("array<int>"))
    places = F.filter(F.transform(spots, lambda i: F.struct(i.cast("bigint").alias("at"), label_at(i).alias("label"))),
                      lambda p: p["label"].isNotNull())
    return listed.withColumn("_places", places).drop("_words")


def _windows(words: Column) -> Column:
    """Overlapping runs of ``BLOCK`` words, as starts and arrays of words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - STEP, F.lit(0)), F.lit(STEP))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice(words, i + 1, BLOCK).alias("words")))


def _wrapped(low: Column) -> Column:
    """The windows of the whole text that span a line break.

    What is used twice is bound as a lambda variable, so that no rule of the optimizer can copy it.
    """
    last = lambda z, b: F.least(b["at"] + BLOCK, F.size(z["l"])) - 1
    spans = lambda z: F.filter(_windows(z["w"]), lambda b: F.get(z["l"], b["at"]) != F.get(z["l"], last(z, b)))
    numbered = lambda lines: F.struct(
        F.flatten(lines).alias("w"), F.flatten(F.transform(lines, lambda w, i: F.array_repeat(i, F.size(w)))).alias("l"))
    lines = F.transform(F.split(low, "\n", -1), _words)
    return F.flatten(F.transform(F.transform(F.array(lines), numbered), lambda z: F.transform(spans(z), lambda b: b["words"])))


def blocks(docs: DataFrame, text: str, sets: list[list[str]], need: list[int]) -> DataFrame:
    """One row per text block with enough known tokens for a template: its key and ``_tokens``, the known tokens once each."""
    vocabulary = sorted({w for s in sets for w in s})
    known = F.array(*[F.lit(v) for v in vocabulary])

    def may(found: Column) -> Column:
        out = F.lit(False)
        for tokens, c in zip(sets, need, strict=True):
            out = out | (F.size(F.array_intersect(found, F.array(*[F.lit(t) for t in tokens]))) >= c)
        return out

    low = F.lower(F.col(text))
    # Bound as a lambda variable: the filter looks at the tokens once per template, and they are found once per text.
    held = (docs.filter(F.exists(F.array(F.array_intersect(F.split(low, _BREAK), known)), may))
            .select("_key", low.alias("_low")))
    lines = held.select("_key", F.explode(F.split("_low", "\n", -1)).alias("_line"))
    words = lines.select("_key", F.split(F.col("_line"), _BREAK).alias("_w"))
    cut = F.when(F.size("_w") <= BLOCK, F.array("_w")).otherwise(F.transform(_windows(F.col("_w")), lambda b: b["words"]))
    return (words.select("_key", F.explode(cut).alias("_block"))
            .union(held.select("_key", F.explode_outer(_wrapped(F.col("_low")))))
            .select("_key", F.array_intersect("_block", known).alias("_tokens"))
            .filter(F.size("_tokens") >= min(need)))


def containment_join(docs: DataFrame, text: str = "_text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``_key, label, containment`` for every text block and template with ``|T & B| >= threshold * |T|``."""
    spark = docs.sparkSession
    sets = [(label, sorted(set(phrase.split()))) for label, phrase in templates]
    need = [math.ceil(threshold * len(s)) for _, s in sets]
    vocabulary = sorted({w for _, s in sets for w in s})
    found = blocks(docs, text, [s for _, s in sets], need)
    # One row per template word at most.
    counts = {r["_t"]: r["n"] for r in found.select(F.explode("_tokens").alias("_t")).groupBy("_t")
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for (label, tokens), c in zip(sets, need, strict=True):
        tokens = sorted(tokens, key=rank.__getitem__)
        rows += [(tokens[i], label, tokens, i, len(tokens), c) for i in range(len(tokens) - c + 1)]
    index = spark.createDataFrame(rows, "_token string, label string, _t array<string>, _ti int, _tn int, _c int")
    ordered = F.array(*[F.lit(w) for w in order])
    ranked = found.select("_key", F.array_intersect(ordered, F.col("_tokens")).alias("_b"))  # rarest first
    probes = ranked.select("_key", "_b", F.posexplode("_b").alias("_bi", "_token"))
    left = F.lit(1) + F.least(F.col("_tn") - F.col("_ti") - 1, F.size("_b") - F.col("_bi") - 1)
    pairs = probes.join(F.broadcast(index), "_token").filter((F.size("_b") >= F.col("_c")) & (left >= F.col("_c")))
    common = F.size(F.array_intersect("_b", "_t"))
    return pairs.withColumn("_n", common).filter(F.col("_n") >= F.col("_c")).select(
        "_key", "label", (F.col("_n") / F.col("_tn")).alias("containment"))


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id", templates=TEMPLATES,
                  threshold: float = THRESHOLD) -> DataFrame:
    """Per document: ``key, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Null text counts as empty: no words, no places, empty label lists, score 0. The score is 1 where a phrase of the base
    scan stands, else the best containment found. Rows that repeat id and text repeat the result. An empty table gives an
    empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(key).alias("_id"), body.alias("_text"),
                        F.struct(F.col(key).cast("string").alias("id"), F.xxhash64(body).alias("h")).alias("_key"))
    hits = (containment_join(keyed, "_text", templates, threshold).groupBy("_key")
            .agg(F.collect_set("label").alias("_more"), F.max("containment").alias("_best"))
            .select(F.col("_key").alias("_k"), "_more", "_best"))
    base = base_places(keyed).drop("_text")
    joined = base.join(hits, F.col("_key").eqNullSafe(F.col("_k")), "left")
    empty = F.array().cast("array<string>")
    labels = F.transform("_places", lambda p: p["label"])
    joined_text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return joined.select(
        F.col("_id").alias(key), "n_words", F.size("_places").cast("bigint").alias("n_base"),
        F.array_min(F.transform("_places", lambda p: p["at"])).alias("first_word"),
        F.array_max(F.transform("_places", lambda p: p["at"])).alias("last_word"),
        joined_text(labels).alias("base_labels"),
        joined_text(F.concat(labels, F.coalesce("_more", empty))).alias("labels"),
        F.when(F.size("_places") > 0, 1.0).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"))
