"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Rows and queries are cut into blocks; a task gets one block of rows and one block of queries, so neither side is ever
whole in one place. Inside a block every dimension is a list of the rows sorted by that component. For a query the lists
are read from the end that its sign favours, a slice of all lists at a time. A row seen in some lists has a lower bound (what was seen,
plus the worst values for the rest) and an upper bound (what was seen, plus the last values read). Reading stops when no
row outside the best ``k`` can still reach the k-th lower bound; then the scores of the rows that remain are resolved.
The block results are merged with Spark's partial top-k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import cut

SCALE = 256
#: Sums of integers under this size are exact in a double; rows and queries that could leave it are scored as Python integers.
EXACT = float(1 << 53)
ROW_BLOCK = 8192
#: Rows of the parts a block is read in: the first ones, then all others.
FIRST_PARTS = (256, 1024)
PART = 2048
#: How far the lists are read before the bounds are looked at, in eighths, and the share of rows that is then resolved.
DEPTHS = (5, 7)
RESOLVE = 16
QUERY_BLOCK = 1024


class SortedLists:
    """The rows of a block, and for each dimension the list of its components in order.

    Reading a list to a depth is done for all rows at once: an entry at least as good as the last one read counts with
    its value; one that was not reached counts with the last value read (upper bound) or the worst one (lower bound).
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = rows.astype(np.float64), ids
        self.columns = np.ascontiguousarray(self.rows.T)
        self.sorted = np.sort(self.columns, 1)

    def top(self, query: np.ndarray, k: int, own: int, bar: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best rows but ``own`` that score at least ``bar``; ties go to the smaller id."""
        n = len(self.rows)
        live = np.flatnonzero(self.ids != own)
        up = query >= 0
        worst = np.where(up, self.sorted[:, 0], self.sorted[:, -1]) * query
        for eighths in DEPTHS:
            depth = n * eighths // 8
            if depth == 0 or len(live) <= k:
                continue
            edge = np.where(up, self.sorted[:, n - depth], self.sorted[:, depth - 1]) * query
            gain = (self.columns if len(live) >= n - 1 else self.columns[:, live]) * query[:, None]
            reached = bar
            if bar == -np.inf:
                floor = np.where(gain >= edge[:, None], gain, worst[:, None]).sum(0)
                reached = np.partition(floor, len(floor) - k - 1)[len(floor) - k - 1]  # one more: own may be among them
            ceiling = np.maximum(gain, edge[:, None], out=gain).sum(0)
            live = live[(ceiling[live] if len(ceiling) == n else ceiling) >= reached - 1e-6]
            if len(live) <= max(8 * k, n // RESOLVE):
                break
        # What is left is resolved: the unread entries of these rows complete their scores.
        scores = self.rows[live] @ query
        order = np.lexsort((self.ids[live], -scores))[:k]
        order = order[scores[order] >= bar]
        return self.ids[live][order], scores[order]


def _whole(row: np.ndarray) -> list[int]:
    """``SCALE`` times the components, as integers of any size."""
    return [n * SCALE // m for n, m in map(float.as_integer_ratio, row.tolist())]


class WideRows:
    """Rows of any finite size: scores with a bound of their error choose the rows that are then scored as integers."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = rows, ids
        self.scaled = np.ldexp(rows, -np.frexp(np.abs(rows).max(initial=1.0))[1])

    def top(self, query: np.ndarray, k: int, own: int) -> list[tuple[int, int]]:
        """``(score, id)`` of the ``k`` best rows but ``own``; ties go to the smaller id."""
        live = np.flatnonzero(self.ids != own)
        unit = np.ldexp(query, -np.frexp(np.abs(query).max(initial=1.0))[1])
        rows, d = self.scaled[live], len(query)
        scores, slack = rows @ unit, (np.abs(rows) @ np.abs(unit)) * ((d + 4) * 2.0 ** -52) + d * 2.0 ** -1070
        if len(live) > k:
            live = live[scores + slack >= np.partition(scores - slack, len(live) - k)[len(live) - k]]
        whole = _whole(query)
        found = [(sum(a * b for a, b in zip(whole, _whole(self.rows[i]), strict=True)), int(self.ids[i])) for i in live]
        return sorted(found, key=lambda f: (-f[0], f[1]))[:k]


def best_of_block(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, owns: np.ndarray, k: int):
    """``query number`` and ``(score, id)`` of the best rows of a block for each query.

    The block is read in parts, a small one first: the k-th score of the parts before is a bar that outsiders of the next
    part must reach, so its lists need not be read to the end. Large rows are a part of their own.
    """
    most = np.sqrt(EXACT / max(rows.shape[1], 1)) / SCALE
    slim = np.abs(rows).max(1, initial=0.0) < most
    parts, low = [], 0
    some, names = rows[slim] * SCALE, ids[slim]
    for size in (*FIRST_PARTS, *[PART] * (len(names) // PART + 1)):
        if low < len(names):
            parts.append(SortedLists(some[low: low + size], names[low: low + size]))
            low += size
    large = WideRows(rows[~slim], ids[~slim])
    every = None
    for number, (query, own) in enumerate(zip(queries, owns, strict=True)):
        if not np.abs(query).max(initial=0.0) < most:
            every = every or WideRows(rows, ids)
            yield number, every.top(query, k, own)
            continue
        best, scores = np.zeros(0, np.int64), np.zeros(0)
        for part in parts:
            more, values = part.top(query * SCALE, k, own, scores[k - 1] if len(scores) >= k else -np.inf)
            best, scores = np.concatenate([best, more]), np.concatenate([scores, values])
            order = np.lexsort((best, -scores))[:k]
            best, scores = best[order], scores[order]
        found = list(zip(map(int, scores), best.tolist(), strict=True))
        if len(large.ids):
            found = sorted(found + large.top(query, k, own), key=lambda f: (-f[0], f[1]))[:k]
        yield number, found


_NINES = str.maketrans("0123456789", "9876543210")


def _place(score: int) -> str:
    """A text that sorts like the integer."""
    digits = str(abs(score))
    return f"1{len(digits):04d}{digits}" if score >= 0 else f"0{9999 - len(digits):04d}{digits.translate(_NINES)}"


def _steps(values: str):
    """The components rounded down to steps of 1 / ``SCALE``; from 2^45 on a double is a multiple of that anyway."""
    def step(x):
        x = x.cast("double")
        return F.when(F.abs(x) < float(1 << 45), F.floor(x * SCALE).cast("double") / SCALE).otherwise(x)
    return F.transform(F.col(values), step)


def valid_vectors(vectors: DataFrame, key: str, values: str) -> DataFrame:
    """``_id, _v`` of the vectors that take part: no null or non-finite component, not empty."""
    fine = F.forall(F.col(values), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return (vectors.filter(F.col(key).isNotNull() & F.col(values).isNotNull() & (F.size(values) > 0) & fine)
            .select(F.col(key).cast("bigint").alias("_id"), _steps(values).alias("_v")))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", values: str = "embedding",
          row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every``, its k best other rows.

    A row never finds rows with its own id. Equal scores go to the smaller id. Vectors of another length than the query's
    are no candidates for it. Ids that repeat are rows of their own. Fewer candidates give fewer rows; an empty table none.
    Components may be of any finite size: ranks follow the exact score, and a score that no long can hold is null.
    """
    rows = cut(valid_vectors(vectors, key, values))
    n = rows.count()
    row_blocks, query_blocks = -(-n // row_block) or 1, -(-n // (every * query_block)) or 1
    spread = lambda seed, blocks: F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(blocks)).cast("int")
    one = rows.select("_id", "_v", F.size("_v").alias("_d"), spread(1, row_blocks).alias("_r"),
                      F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("_q"))
    two = (rows.filter(F.col("_id") % every == 0)
           .select("_id", "_v", F.size("_v").alias("_d"),
                   F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("_r"), spread(2, query_blocks).alias("_q")))

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "_score": [], "_place": []}
        if len(left) and len(right):
            owns = right["_id"].to_numpy()
            for i, best in best_of_block(np.stack(left["_v"].to_numpy()), left["_id"].to_numpy(),
                                         np.stack(right["_v"].to_numpy()), owns, k):
                out["query_id"] += [owns[i]] * len(best)
                out["vec_id"] += [name for _, name in best]
                out["_score"] += [str(score) for score, _ in best]
                out["_place"] += [_place(score) for score, _ in best]
        return pd.DataFrame({c: np.array(v, np.int64 if c.endswith("id") else object) for c, v in out.items()})

    found = one.groupBy("_d", "_r", "_q").cogroup(two.groupBy("_d", "_r", "_q")).applyInPandas(
        block, "query_id long, vec_id long, _score string, _place string")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("_place"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", F.col("_score").try_cast("bigint").alias("score")))
