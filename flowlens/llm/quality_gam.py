"""Quality classifier: a generalised additive model with pairwise interactions (GA2M).

Every text becomes a few numbers (``FEATURES``: shares of character classes, word lengths, repetition), computed in numpy
over whole Arrow batches. Each feature is cut into bins; boosting goes round the features in turn and fits a tree of depth
two on the bins of that one feature, adding its leaves to the feature's lookup table. What is left goes to the pairs of
features with the largest gain, as two-dimensional tables. A score is a sum of looked-up bins, passed through the
logistic function.

The model is fitted on at most ``FIT_ROWS`` labelled rows; only their numbers come to the driver. Scoring is one pass
without a shuffle.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import crc_of_id, fresh, labelled_sample, prepare
from flowlens.llm.tokens import words_of

#: Bound of the labelled sample the model is fitted on.
FIT_ROWS = 20_000
BINS = 32
ROUNDS = 150
RATE = 0.1
PAIRS = 8
FOLDS = 5
THRESHOLD = 0.3

FEATURES = ("log_words", "upper", "digit", "symbol", "stop_mark", "pipe", "bang", "space", "line_words", "word_bytes",
            "long_words", "short_words", "distinct_words", "top_word", "repeats", "distinct_triples", "marked_words",
            "capital_words")

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#$%&*+/<=>@[\\]^_{}~`",
    "stop_mark": b".,;:?", "pipe": b"|", "bang": b"!", "space": b" \t", "line": b"\n",
}


def _class_tables() -> dict[str, np.ndarray]:
    out = {}
    for name, members in _CLASSES.items():
        out[name] = np.zeros(256, bool)
        out[name][list(members)] = True
    return out


_TABLES = _class_tables()
_CAPITAL = _TABLES["upper"]


def _runs(doc: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the size of the largest group of equal ones, per text (on 40 bits of each hash)."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (values >> np.uint64(24)))
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([head, [len(key)]]))
    owner = (key[head] >> np.uint64(40)).astype(np.int64)
    distinct, top = np.bincount(owner, minlength=n), np.zeros(n)
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        top[owner[first]] = np.maximum.reduceat(size, first)
    return distinct, top


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text. Null counts as empty; a text without words has zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for low, high, words in words_of(texts):
        n = high - low
        size = np.maximum(np.diff(words.offsets), 1)
        count, some = words.count, np.maximum(words.count, 1)

        def share(table, words=words, size=size):
            sums = np.concatenate([[0], np.cumsum(table[words.data])])
            return np.diff(sums[words.offsets]) / size

        length = words.end - words.start
        per = lambda w, words=words, n=n: np.bincount(words.doc, w, n)
        distinct, top = _runs(words.doc, words.hash, n)
        triple, at = words.shingles(3)
        triples, _ = _runs(words.doc[at], triple, n)
        same = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
        marks = np.concatenate([[0], np.cumsum(_TABLES["symbol"][words.data] | _TABLES["bang"][words.data])])
        capitals = np.concatenate([[0], np.cumsum(_CAPITAL[words.data])])
        lines = share(_TABLES["line"]) * size + 1
        out[low:high] = np.stack([
            np.log1p(count), share(_TABLES["upper"]), share(_TABLES["digit"]), share(_TABLES["symbol"]),
            share(_TABLES["stop_mark"]), share(_TABLES["pipe"]), share(_TABLES["bang"]), share(_TABLES["space"]),
            np.log1p(count / lines), per(length) / some, per(length > 14) / some, per(length < 4) / some,
            distinct / some, top / some, np.bincount(words.doc[1:][same], minlength=n) / some,
            triples / np.maximum(count - 2, 1), per(marks[words.end] > marks[words.start]) / some,
            per(capitals[words.end] - capitals[words.start] > 1) / some], 1)
    return out


class Gam:
    """Bin edges and lookup tables of a fitted model."""

    def __init__(self, base: float, edges: list[np.ndarray], single: np.ndarray,
                 pairs: list[tuple[int, int]], double: np.ndarray):
        self.base, self.edges, self.single, self.pairs, self.double = base, edges, single, pairs, double

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        total = np.full(len(x), self.base)
        for j in range(x.shape[1]):
            total += self.single[j, bins[:, j]]
        for table, (a, b) in zip(self.double, self.pairs, strict=True):
            total += table[bins[:, a], bins[:, b]]
        return 1 / (1 + np.exp(-total))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)


_RIDGE = 2.0


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Largest gain of one cut over ordered bins, and the number of bins left of it."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl ** 2 / (hl + _RIDGE) + gr ** 2 / (hr + _RIDGE) - g.sum() ** 2 / (h.sum() + _RIDGE)
    if not len(gain):
        return 0.0, 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values, per bin, of a tree of depth two on one feature."""
    borders = {0, len(g)}
    gain, at = _best_cut(g, h)
    if gain > 0:
        borders.add(at)
        for low, high in ((0, at), (at, len(g))):
            gain, inner = _best_cut(g[low:high], h[low:high])
            if gain > 0:
                borders.add(low + inner)
    out = np.zeros(len(g))
    for low, high in itertools.pairwise(sorted(borders)):
        out[low:high] = -g[low:high].sum() / (h[low:high].sum() + _RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of a tree on two features: one cut of the first, then one of the second on each side."""
    best, table = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        ga, ha = np.cumsum(a, 0), np.cumsum(b, 0)
        tops = (np.cumsum(ga, 1), np.cumsum(ha, 1))
        whole_g, whole_h = tops[0][-1], tops[1][-1]

        def side(cg, ch):
            rg, rh = cg[..., -1:] - cg, ch[..., -1:] - ch
            gain = cg ** 2 / (ch + _RIDGE) + rg ** 2 / (rh + _RIDGE)
            return gain.max(-1), gain.argmax(-1)

        left, left_at = side(tops[0][:-1], tops[1][:-1])
        right, right_at = side(whole_g - tops[0][:-1], whole_h - tops[1][:-1])
        gain = left + right - whole_g[-1] ** 2 / (whole_h[-1] + _RIDGE)
        k = int(np.argmax(gain)) if len(gain) else 0
        if len(gain) and gain[k] > best:
            best, leaves = float(gain[k]), np.zeros_like(a)
            for rows, cut in ((slice(0, k + 1), left_at[k] + 1), (slice(k + 1, None), right_at[k] + 1)):
                for cols in (slice(0, cut), slice(cut, None)):
                    leaves[rows, cols] = -a[rows, cols].sum() / (b[rows, cols].sum() + _RIDGE)
            table = leaves.T if turned else leaves
    return best, table


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> Gam:
    """Cyclic boosting; without rows, or with one class only, the score is the smoothed share of ones."""
    width = x.shape[1]
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(y) == 0 or y.min() == y.max():
        return Gam(base, [np.zeros(0)] * width, np.zeros((width, 1)), [], np.zeros((0, 1, 1)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    bins = binned(x, edges)
    single, total = np.zeros((width, BINS)), np.full(len(y), base)
    slope = lambda: (p := 1 / (1 + np.exp(-total)), p - y, p * (1 - p))[1:]
    for _ in range(rounds):
        for j in range(width):
            g, h = slope()
            step = RATE * _tree(np.bincount(bins[:, j], g, BINS), np.bincount(bins[:, j], h, BINS))
            single[j] += step
            total += step[bins[:, j]]

    def plane(a, b, w):
        return np.bincount(bins[:, a] * BINS + bins[:, b], w, BINS * BINS).reshape(BINS, BINS)

    g, h = slope()
    gains = sorted(((_pair_tree(plane(a, b, g), plane(a, b, h))[0], a, b)
                    for a, b in itertools.combinations(range(width), 2)), reverse=True)
    chosen = [(a, b) for gain, a, b in gains[:pairs] if gain > 0]
    double = np.zeros((len(chosen), BINS, BINS))
    for _ in range(rounds // 3):
        for k, (a, b) in enumerate(chosen):
            g, h = slope()
            step = RATE * _pair_tree(plane(a, b, g), plane(a, b, h))[1]
            double[k] += step
            total += step[bins[:, a], bins[:, b]]
    return Gam(base, edges, single, chosen, double)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", keep: Column | None = None,
                rows: int = FIT_ROWS) -> Gam:
    """Fits on at most ``rows`` labelled documents; rows of a repeated id count once each, up to the bound."""
    prepare(docs.sparkSession)
    width = len(FEATURES)

    def extract(batches):
        for batch in batches:
            x = features(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64()))],
                ["_label", "_x"])

    sample = labelled_sample(docs, labels, label, rows, keep=keep)
    sample = sample.select(F.col("_key").cast("string"), "_label", "_text")
    got = sample.mapInArrow(extract, "_label int, _x array<double>").orderBy("_x", "_label").limit(rows).toArrow()
    y = got.column("_label").to_numpy().astype(float)
    x = np.array(got.column("_x").to_pylist(), float).reshape(len(y), width)
    return fit(x, y)


def quality_score(model: Gam):
    """The model as a column function of a text: probability that its label is 1."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(features(texts)))
    return score


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
                  threshold: float = THRESHOLD) -> DataFrame:
    """The documents with ``held_out, score, predicted``; rows whose ``crc32(id) mod 5`` is 0 are never learned from.

    Null and empty texts get the score of a text without words; rows are scored one by one, repeated ones alike. New
    columns whose name is taken get a trailing underscore. Without labels the score is one half.
    """
    held = crc_of_id(key) % FOLDS == 0
    model = fit_quality(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), labels,
                        keep=crc_of_id("_key") % FOLDS != 0)
    names = [fresh(docs.columns, n) for n in ("held_out", "score", "predicted")]
    return (docs.withColumn(names[1], quality_score(model)(F.col(text)))
            .select(*docs.columns, held.alias(names[0]), names[1],
                    (F.col(names[1]) >= threshold).cast("int").alias(names[2])))
