"""Periodic run detection: maximal repetitions by Lyndon roots and constant-time common extensions from suffix trees.

A run is a stretch of words with smallest period ``q`` that no neighbouring word extends, at least four periods and six words long.
Every run has a Lyndon root: for one of the two orders of the words, the longest Lyndon word that starts at some place
of the run has the period as its length. That word ends before the next smaller suffix, which a stack over the
suffix ranks finds, so there are two candidates per place. Each one is extended to the right by the longest common extension of
two suffixes and to the left by that of two suffixes of the reversal. Both come from Ukkonen suffix trees: an Euler tour
and a table of range minima answer lowest common ancestors, whose depth is the extension, in constant time.

Trees are only built where a run can be. In a run of ``4 q`` words every three consecutive words start at least three times,
so a document is first cut into stretches of places whose three words do (counted within the stretch, again until
nothing changes); no run reaches over such a cut. Plain prose leaves almost nothing, periodic text all of it.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import prepare

#: Least number of periods and of words in a run.
PERIODS = 4
WORDS = 6
_GRAM = 3


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of small numbers, its suffix ranks and longest common extensions."""

    def __init__(self, symbols: list[int]):
        self.n = len(symbols)
        # The end mark is smaller than every symbol.
        text = [s + 1 for s in symbols] + [0]
        self._build(text, max(text) + 1)
        self._tour(text)

    def _build(self, text: list[int], sigma: int) -> None:
        start, end, link, child = array("q", [0]), array("q", [0]), array("q", [0]), {}
        size, leaf = len(text), len(text)
        node, edge, length, left = 0, 0, 0, 0
        for at in range(size):
            left += 1
            pending = 0
            while left:
                if not length:
                    edge = at
                key = node * sigma + text[edge]
                down = child.get(key)
                if down is None:
                    start.append(at)
                    end.append(leaf)
                    link.append(0)
                    child[key] = len(start) - 1
                    if pending:
                        link[pending] = node
                        pending = 0
                else:
                    span = min(end[down], at + 1) - start[down]
                    if length >= span:
                        edge += span
                        length -= span
                        node = down
                        continue
                    if text[start[down] + length] == text[at]:
                        if pending and node:
                            link[pending] = node
                        length += 1
                        break
                    split = len(start)
                    start.append(start[down])
                    end.append(start[down] + length)
                    link.append(0)
                    child[key] = split
                    start.append(at)
                    end.append(leaf)
                    link.append(0)
                    child[split * sigma + text[at]] = split + 1
                    start[down] += length
                    child[split * sigma + text[start[down]]] = down
                    if pending:
                        link[pending] = split
                    pending = split
                left -= 1
                if node == 0 and length:
                    length -= 1
                    edge = at - left + 1
                elif node:
                    node = link[node]
        self._start, self._end, self._child, self._sigma = start, end, child, sigma

    def _tour(self, text: list[int]) -> None:
        """Euler tour in the order of the symbols: depths in words, first visits, suffix ranks and range minima."""
        keys = np.fromiter(self._child.keys(), np.int64, len(self._child))
        nodes = np.fromiter(self._child.values(), np.int64, len(self._child))
        order = np.argsort(keys)
        parents = keys[order] // self._sigma
        heads = np.searchsorted(parents, np.arange(len(self._start) + 1)).tolist()
        below = nodes[order].tolist()
        size = len(text)
        depths, first = [0], np.zeros(size, np.int64)
        suffixes: list[int] = []
        path, depth = [(0, 0)], 0
        cursor = heads[:-1]
        while path:
            node, depth = path[-1]
            if cursor[node] < heads[node + 1]:
                down = below[cursor[node]]
                cursor[node] += 1
                deeper = depth + self._end[down] - self._start[down]
                path.append((down, deeper))
                depths.append(deeper)
                if heads[down] == heads[down + 1]:
                    suffix = size - deeper
                    suffixes.append(suffix)
                    first[suffix] = len(depths) - 1
            else:
                path.pop()
                if path:
                    depths.append(path[-1][1])
        self._first = first
        #: Rank of each suffix among all.
        self.rank = np.empty(size, np.int64)
        self.rank[np.array(suffixes)] = np.arange(size)
        table = [np.array(depths, np.int32)]
        while 2 << (len(table) - 1) <= len(depths):
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self._minima = table
        del self._start, self._end, self._child

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and ``b``, which differ."""
        low, high = np.minimum(self._first[a], self._first[b]), np.maximum(self._first[a], self._first[b])
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            row = self._minima[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k) + 1])
        return out


def _next_below(rank: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next one of smaller, and of greater, rank (-1: none)."""
    smaller, greater = [-1] * len(rank), [-1] * len(rank)
    down: list[int] = []
    up: list[int] = []
    for i, r in enumerate(rank):
        while down and rank[down[-1]] > r:
            smaller[down.pop()] = i
        while up and rank[up[-1]] < r:
            greater[up.pop()] = i
        down.append(i)
        up.append(i)
    return smaller, greater


def runs_of(symbols: list[int], periods: int = PERIODS, words: int = WORDS) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of at least ``periods`` (two or more) periods and ``words`` words."""
    n = len(symbols)
    if n < max(words, periods):
        return []
    tree, mirror = SuffixTree(symbols), SuffixTree(symbols[::-1])
    smaller, greater = _next_below(tree.rank.tolist())
    place = np.tile(np.arange(n), 2)
    after = np.array(smaller[:n] + greater[:n])
    # A root that nothing in the text ends is no root of a run.
    known = (after >= 0) & (after < n)
    place, after = place[known], after[known]
    if not len(place):
        return []
    period = after - place
    right = after + tree.extension(place, after)
    back, inner = n - place, n - after
    left = place - np.where(place > 0, mirror.extension(np.minimum(back, n), inner), 0)
    length = right - left
    keep = length >= np.maximum(words, periods * period)
    found = np.unique(np.stack([left, period, length], 1)[keep], axis=0)
    return [(int(s), int(m), int(q)) for s, q, m in found]


def stretches(ids: np.ndarray, periods: int = PERIODS, words: int = WORDS) -> list[tuple[int, int]]:
    """``(first, last + 1)`` of the word stretches that can hold a run: all that do not are left out."""
    if periods < PERIODS or words < WORDS:
        return [(0, len(ids))] if len(ids) else []
    n = len(ids) - _GRAM + 1
    if n < 1:
        return []
    # Three words as one number: pairs are numbered first, so that no product leaves 64 bits.
    scale = int(ids.max()) + 1
    pair = np.unique(ids[:-1] * scale + ids[1:], return_inverse=True)[1]
    gram = np.unique(pair[:n] * scale + ids[2:], return_inverse=True)[1]
    at = np.arange(n)
    while len(at):
        part = np.cumsum(np.diff(at, prepend=at[0] - 2) != 1) - 1
        size = np.bincount(part)[part]
        _, inverse, count = np.unique(part * n + gram[at], return_inverse=True, return_counts=True)
        hot = (count[inverse] >= _GRAM) & (size >= words - _GRAM + 1)
        if hot.all():
            break
        at = at[hot]
    if not len(at):
        return []
    opens = np.flatnonzero(np.diff(at, prepend=at[0] - 2) != 1)
    ends = np.append(opens[1:], len(at)) - 1
    return [(int(at[a]), int(at[b]) + _GRAM) for a, b in zip(opens, ends, strict=True)]


def runs_of_words(text: list[bytes], periods: int = PERIODS, words: int = WORDS) -> list[tuple[int, int, int]]:
    """The runs of a list of words, by start, then period."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in text], np.int64)
    found = []
    for low, high in stretches(ids, periods, words):
        part = np.unique(ids[low:high], return_inverse=True)[1].tolist()
        found += [(start + low, length, period) for start, length, period in runs_of(part, periods, words)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; ties go to the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(text: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return text
    gone = np.zeros(len(text) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(text, np.cumsum(gone).tolist(), strict=False) if not g]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_NAMES = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
_SCHEMA = ("_id {kind}, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
           "collapsed_sha256 string")


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", periods: int = PERIODS, words: int = WORDS,
                  texts: bool = False) -> DataFrame:
    """One row per document: ``key, n_words, n_runs``, the strongest run (``start, length, period, exponent_milli``: null if
    there is none), ``runs_sha256`` and ``collapsed_sha256``; with ``texts`` also all ``runs`` and the ``collapsed`` text.

    Words are runs of anything but ASCII white space; a null, empty or blank text has none. Null ids and repeated rows have
    results like any other row, and other columns are not read. An empty table gives an empty result. Memory follows the longest text.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows, lists, left = [], [], []
            for value in batch.column(1):
                split = (value.as_py() or "").encode().split()
                runs = runs_of_words(split, periods, words)
                best = strongest(runs)
                kept = b" ".join(collapsed(split, runs))
                listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
                rows.append((len(split), len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
                             hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()))
                if texts:
                    lists.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                    left.append(kept.decode())
            columns = [pa.array([r[i] for r in rows], pa.string() if i > 5 else pa.int64()) for i in range(len(_NAMES))]
            more = [pa.array(lists, pa.list_(_RUN)), pa.array(left, pa.string())] if texts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *more],
                                             ["_id", *_NAMES, *(["runs", "collapsed"] if texts else [])])
    plain = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    schema = _SCHEMA.format(kind=plain.schema["_id"].dataType.simpleString())
    if texts:
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return plain.mapInArrow(run, schema).withColumnRenamed("_id", key)


def with_repeating_tails(text: Column, key: Column) -> Column:
    """The text; where crc32 of the id divides by ten, its words from one on repeat with a period drawn from the same number."""
    drawn = F.crc32(key.cast("string").cast("binary"))
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(drawn / 10)
        head = F.pmod(g, n)
        period = 1 + F.floor((n - head) / (3 + F.pmod(g, F.lit(8))))
        root = F.slice(words, (head + 1).cast("int"), period.cast("int"))
        copies = F.flatten(F.array_repeat(root, F.ceil((n - head) / period).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), head.cast("int")), F.slice(copies, F.lit(1), (n - head).cast("int"))), " ")

    return F.when((drawn % 10 == 0) & (F.size(split) > 0), F.get(F.transform(F.array(split), repeated), F.lit(0))).otherwise(text)
