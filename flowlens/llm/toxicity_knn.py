"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are lower-cased words and their beginnings. From at most ``FIT_ROWS`` labelled documents the terms that
go with the label are kept (counts per term and label, by Spark), so a vector holds what distinguishes and chance words do
not. Inverse document frequencies of these terms are counted over all documents. The labelled vectors form the
index: postings per term in blocks of examples, with the largest weight per term and block. A query document is held
against the blocks in the order of their upper bounds and stops when no block can still enter its best ``K``; the
neighbours are those of a full comparison. Votes weigh ``similarity ** SHARPNESS`` against a prior of ``PRIOR`` votes, and
a monotone map fitted on the examples (each left out of its own vote) makes the share of votes a probability.

Everything that is collected is bounded by the ``FIT_ROWS`` examples and their terms. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import crc_of_id, cut, fresh, labelled_sample, prepare
from flowlens.llm.tokens import LETTER, words_of

#: Bound of the labelled sample.
FIT_ROWS = 12_000
MIN_ROWS = 4
#: Lengths, in bytes, of the word beginnings that are terms of their own.
PREFIXES = (4, 6)
K = 15
BLOCK = 64
SHARPNESS = 2
PRIOR = 0.3
FOLDS = 3
HELD = 1
THRESHOLD = 0.7
#: A term is kept if its share of ones is this many standard errors from the share of all.
STRENGTH = 3.5


def _terms(words) -> np.ndarray:
    """Hashes of each word and of its beginnings; the length is mixed in, so terms of two kinds never meet."""
    return np.stack([words.hash, *[words.prefix_hash(n) ^ np.uint64(n * 0x5BD1E995) for n in PREFIXES]], 1)


def term_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct terms of each text."""
    out = []
    for _, _, words in words_of(texts, LETTER, lower=True):
        terms = _terms(words)
        out += [np.unique(terms[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    return out


def term_counts(texts: pa.Array, vocabulary: np.ndarray):
    """``text, term, count`` triples of the known terms (``vocabulary`` is sorted), in order of text and term."""
    texts_, terms_, counts_ = [], [], []
    for low, _, words in words_of(texts, LETTER, lower=True):
        terms = _terms(words)
        at = np.searchsorted(vocabulary, terms)
        known = vocabulary[np.minimum(at, len(vocabulary) - 1)] == terms if len(vocabulary) else np.zeros(terms.shape, bool)
        key, count = np.unique(np.broadcast_to(words.doc[:, None], terms.shape)[known] * np.int64(1 << 24) + at[known],
                               return_counts=True)
        texts_.append(low + (key >> 24))
        terms_.append(key & ((1 << 24) - 1))
        counts_.append(count)
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([empty, *x]) for x in (texts_, terms_, counts_))


def _runs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from ``low`` up to ``high``, run after run, and the number of the run of each."""
    size = high - low
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which], which


class BlockMaxIndex:
    """Labelled vectors in blocks of ``BLOCK``: per block and term the postings, and the largest weight among them."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, labels: np.ndarray, width: int):
        """``rows`` index ``labels``; vectors have length 1. Rows are placed so that alike vectors share a block."""
        self.labels = labels
        n = len(labels)
        heaviest = np.full(n, width)
        by_weight = np.lexsort((weights, rows))
        heaviest[rows[by_weight]] = terms[by_weight]
        self.rows = np.lexsort((np.arange(n), labels, heaviest))
        place = np.empty(n, np.int64)
        place[self.rows] = np.arange(n)
        self.blocks = -(-n // BLOCK)
        #: Postings in order of term and block; a cell is the run of one term and block, ``first`` is where each term's cells begin.
        block = place[rows] // BLOCK
        by_cell = np.lexsort((place[rows], block, terms))
        self.spots, self.weights = (place[rows] % BLOCK)[by_cell], weights[by_cell]
        cell, start = np.unique((terms * max(self.blocks, 1) + block)[by_cell], return_index=True)
        self.start = np.append(start, len(by_cell))
        self.cell_block = cell % max(self.blocks, 1)
        self.cell_max = np.maximum.reduceat(self.weights, start) if len(start) else np.zeros(0)
        self.first = np.searchsorted(cell, np.arange(width + 1) * max(self.blocks, 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, own: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and cosines of the ``k`` nearest rows with a cosine over 0; ties go to the smaller row number."""
        cells, which = _runs(self.first[terms], self.first[terms + 1])
        blocks, factor = self.cell_block[cells], weights[which]
        bound = np.bincount(blocks, factor * self.cell_max[cells], self.blocks)
        turn = np.empty(self.blocks, np.int64)
        order = np.argsort(-bound, kind="stable")
        turn[order] = np.arange(self.blocks)
        by_turn = np.argsort(turn[blocks], kind="stable")
        cells, factor, turns = cells[by_turn], factor[by_turn], turn[blocks[by_turn]]
        order, low = order[bound[order] > 0], 0
        rows, cosines = np.zeros(0, np.int64), np.zeros(0)
        step = 2
        while len(order) and (len(cosines) < k or bound[order[0]] >= cosines[k - 1] - 1e-5):
            now, order, step = order[:step], order[step:], step * 2
            a, b = np.searchsorted(turns, (low, low + len(now)))
            posts, which = _runs(self.start[cells[a:b]], self.start[cells[a:b] + 1])
            score = np.bincount((turns[a:b][which] - low) * BLOCK + self.spots[posts], factor[a:b][which] * self.weights[posts],
                                len(now) * BLOCK).reshape(-1, BLOCK)
            low += len(now)
            block, spot = np.nonzero(score > 0)
            more = self.rows[now[block] * BLOCK + spot]
            values = score[block, spot].astype(float).round(6)
            keep = more != own
            rows, cosines = np.concatenate([rows, more[keep]]), np.concatenate([cosines, values[keep]])
            best = np.lexsort((rows, -cosines))[:k]
            rows, cosines = rows[best], cosines[best]
        return rows, cosines


def pooled(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Monotone regression (pool adjacent violators): ascending knots and the smoothed share of ones at each."""
    order = np.argsort(x, kind="stable")
    stack: list[list[float]] = []
    for a, b in zip(x[order], y[order], strict=True):
        stack.append([a, a, b, 1.0])
        while len(stack) > 1 and (stack[-2][2] / stack[-2][3] >= stack[-1][2] / stack[-1][3] or stack[-2][1] == stack[-1][0]):
            _, high, ones, n = stack.pop()
            stack[-1] = [stack[-1][0], high, stack[-1][2] + ones, stack[-1][3] + n]
    knots = np.array([[(s[0] + s[1]) / 2, (s[2] + 0.5) / (s[3] + 1)] for s in stack])
    return knots[:, 0], np.maximum.accumulate(knots[:, 1])


class Neighbours:
    """Vocabulary, weights, index and calibration of a fitted model."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, base: float):
        self.vocabulary, self.idf, self.base = vocabulary, idf, base
        self.index: BlockMaxIndex | None = None
        self.names = np.zeros(0, object)
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def vectors(self, texts: pa.Array):
        """``text, term, weight`` of unit TF-IDF vectors, in order of text."""
        rows, terms, counts = term_counts(texts, self.vocabulary)
        weights = (1 + np.log(np.maximum(counts, 1))) * self.idf[terms]
        norm = np.sqrt(np.bincount(rows, weights ** 2, len(texts)))
        return rows, terms, weights / np.maximum(norm[rows], 1e-12)

    def votes(self, terms, weights, own: int = -1):
        """Share of distance-weighted votes for 1, and the neighbours it comes from."""
        rows, cosines = self.index.nearest(terms, weights, K, own)
        weight = cosines ** SHARPNESS
        share = (weight @ self.index.labels[rows] + PRIOR * self.base) / (weight.sum() + PRIOR)
        return float(share), rows, cosines

    def fit(self, texts: pa.Array, labels: np.ndarray, names: np.ndarray) -> Neighbours:
        rows, terms, weights = self.vectors(texts)
        self.index, self.names = BlockMaxIndex(rows, terms, weights, labels, len(self.vocabulary)), names
        if len(labels):
            shares = np.array([s for s, _, _ in self._each(rows, terms, weights, len(labels), leave_out=True)])
            self.knots = pooled(shares, labels)
        return self

    def _each(self, rows, terms, weights, n, leave_out=False):
        ends = np.searchsorted(rows, np.arange(n + 1))
        known: dict[bytes, tuple] = {}
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            key = b"" if leave_out else terms[a:b].tobytes() + weights[a:b].tobytes()
            if leave_out or key not in known:
                known[key] = self.votes(terms[a:b], weights[a:b], i if leave_out else -1)
            yield known[key]

    def score(self, texts: pa.Array) -> list[tuple[float, list, list]]:
        """Per text the probability of label 1 and, as evidence, up to five nearest examples with their cosines."""
        out = []
        for share, rows, cosines in self._each(*self.vectors(texts), len(texts)):
            out.append((float(np.interp(share, *self.knots)), self.names[rows[:5]].tolist(), cosines[:5].tolist()))
        return out


def fit_neighbours(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep: Column | None = None,
                   rows: int = FIT_ROWS) -> Neighbours:
    """Chooses terms and fits the index on at most ``rows`` labelled documents; document frequencies are of all texts."""
    prepare(docs.sparkSession)

    def sets(batches):
        for batch in batches:
            found = term_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["_label", "_terms"])

    sample = cut(labelled_sample(docs, labels, label, rows, keep=keep).orderBy(F.md5(F.col("_key").cast("string")), "_text")
                 .limit(rows).withColumn("_name", F.col("_key").cast("string")).select("_name", "_label", "_text"))
    n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0))).first()
    base = (ones + 0.5) / (n + 1)
    counts = (sample.select("_label", "_text").mapInArrow(sets, "_label int, _terms array<long>")
              .select("_label", F.explode("_terms").alias("_term")).groupBy("_term")
              .agg(F.count(F.lit(1)).alias("_n"), F.sum("_label").alias("_ones")).filter(F.col("_n") >= MIN_ROWS))
    strength = F.abs(F.col("_ones") - F.lit(base) * F.col("_n")) / F.sqrt(F.lit(base * (1 - base)) * F.col("_n"))
    chosen = (counts.withColumn("_s", strength).filter(F.col("_s") >= STRENGTH)
              .select("_term").collect())
    vocabulary = np.sort(np.array([r["_term"] for r in chosen], np.int64).view(np.uint64))

    def frequencies(batches):
        df, seen = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            df += np.bincount(term_counts(batch.column(0), vocabulary)[1], minlength=len(vocabulary))
            seen += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([-1, *np.flatnonzero(df)], pa.int32()), pa.array([seen, *df[df > 0]])],
                                         ["_i", "_df"])

    text = docs.select(F.col("text"))
    df = {r["_i"]: r["_df"] for r in text.mapInArrow(frequencies, "_i int, _df long").groupBy("_i")
          .agg(F.sum("_df").alias("_df")).collect()}  # one row per chosen term
    idf = np.array([np.log((df.get(-1, 0) + 1) / (df.get(i, 0) + 1)) + 1 for i in range(len(vocabulary))])
    got = sample.toArrow()
    texts = got.column("_text").combine_chunks()
    return Neighbours(vocabulary, idf, base).fit(texts, got.column("_label").to_numpy().astype(float),
                                                 np.array(got.column("_name").to_pylist(), object))


def toxicity_score(model: Neighbours):
    """The model as a column function of a text: ``score``, ``near`` (ids of examples) and ``cosines``."""
    @F.arrow_udf("score double, near array<string>, cosines array<double>")
    def score(texts: pa.Array) -> pa.Array:
        found = model.score(texts)
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(pa.string())),
             pa.array([f[2] for f in found], pa.list_(pa.float64()))], ["score", "near", "cosines"])
    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
                   threshold: float = THRESHOLD) -> DataFrame:
    """The documents with ``held_out, score, predicted, near, cosines``; rows with ``crc32(id) mod 3`` = 1 are never learned.

    A text without a known term (null and empty ones too) has no neighbour and gets the calibrated prior. Repeated rows
    score alike. New columns whose name is taken get a trailing underscore. Without labels every score is the prior, 1/2.
    """
    held = crc_of_id(key) % FOLDS == HELD
    model = fit_neighbours(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), labels,
                           keep=crc_of_id("_key") % FOLDS != HELD)
    names = [fresh(docs.columns, n) for n in ("held_out", "score", "predicted", "near", "cosines")]
    got = fresh(docs.columns, "_got")
    scored = docs.withColumn(got, toxicity_score(model)(F.col(text)))
    return scored.select(*docs.columns, held.alias(names[0]), F.col(got)["score"].alias(names[1]),
                         (F.col(got)["score"] >= threshold).cast("int").alias(names[2]),
                         F.col(got)["near"].alias(names[3]), F.col(got)["cosines"].alias(names[4]))
