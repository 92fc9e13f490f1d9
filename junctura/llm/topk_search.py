"""Exact top-k by an impact-ordered index, score at a time (operator 8).

The postings of a component (its vectors and integer values) are cut into segments by the value's level, the
value over 2^SHIFT; a query weighs a segment by its own component times the segment's bounds. Segments are
processed by descending impact, the largest contribution they can make, and add their exact values to the accumulators. What
is left is bounded for each component by its unprocessed segments; the query stops only when that bound proves that few
vectors can still be among the k best, and these are scored anew in full.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame

from junctura.llm.vectors import best_of, by_blocks, dense, shape, usable

SCALE = 1024
SHIFT = 6
BLOCK_ROWS, QUERY_ROWS = 16_384, 2_048
CHECKS = 8  # times that a query tests whether it may stop
FEW = 0.02  # of a block's rows may be scored anew


class ImpactIndex:
    def __init__(self, x: np.ndarray):
        """x: integers, a row for each vector in ascending id."""
        self.x = x
        n, d = x.shape
        dim, low, high, rows, values = [], [], [], [], []
        for j in range(d):
            level = x[:, j] >> SHIFT
            order = np.argsort(level, kind="stable").astype(np.int32)
            cut = np.flatnonzero(np.r_[True, np.diff(level[order]) != 0, True])
            for a, b in zip(cut, cut[1:]):
                r = order[a:b]
                dim.append(j)
                rows.append(r)
                values.append(x[r, j])
                low.append(values[-1].min())
                high.append(values[-1].max())
        self.dim, self.low, self.high, self.rows, self.values = np.array(dim), np.array(low), np.array(high), rows, values
        self.begin = np.flatnonzero(np.r_[True, np.diff(self.dim) != 0])

    def candidates(self, q: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """Rows that can be among the k best of those that are not in own."""
        w = q[self.dim]
        most, least = np.maximum(w * self.low, w * self.high), np.minimum(w * self.low, w * self.high)
        order = np.argsort(-np.maximum(np.abs(most), np.abs(least)), kind="stable")
        order = order[w[order] != 0]
        n = len(self.x)
        acc = np.zeros(n, np.int64)
        done = np.zeros(len(w), bool)
        marks = set((len(order) * np.arange(CHECKS // 2, CHECKS) // CHECKS).tolist())
        weights = w[order].tolist()
        for t, (s, weight) in enumerate(zip(order.tolist(), weights)):
            if t in marks:
                done[order[:t]] = True
                up = np.maximum(np.maximum.reduceat(np.where(done, 0, most), self.begin), 0).sum()
                down = np.minimum(np.minimum.reduceat(np.where(done, 0, least), self.begin), 0).sum()
                found = self._above(acc, k, own, up - down)
                if len(found) <= max(4 * k, FEW * n):
                    return found
            acc[self.rows[s]] += weight * self.values[s]
        return self._above(acc, k, own, 0)

    @staticmethod
    def _above(acc, k, own, slack) -> np.ndarray:
        held = np.delete(acc, own) if len(own) else acc
        if len(held) <= k:
            found = np.arange(len(acc))
        else:
            found = np.flatnonzero(acc + slack >= np.partition(held, len(held) - k)[len(held) - k])
        return np.setdiff1d(found, own, assume_unique=True) if len(own) else found


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x); an error where inner products could pass 64 bits."""
    out = np.floor(SCALE * x)
    if out.size and float(np.abs(out).max()) ** 2 * out.shape[1] >= 2.0**61:
        raise ValueError("components too large for scores of 64 bits")
    return out.astype(np.int64)


def _search(ids, rows, queries, query_ids, d, k):
    index = ImpactIndex(whole(dense(rows, d)))
    for i, (own, q) in enumerate(zip(query_ids, whole(dense(queries, d)))):
        at = index.candidates(q, k, np.flatnonzero(ids == own))
        score = index.x[at] @ q
        top = best_of(score, ids[at], k)
        yield i, ids[at][top], score[top]


def search(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products for every row whose vec_id is divisible by `every`.

    Components count as floor(1024 x); where they are so large that a score could pass 64 bits (2^18 at 64 components), the query fails with an error.
    Candidates are all rows but those with the query's vec_id. Rows that are null or hold a null
    or non-finite component take no part; zero vectors do; shorter ones count as ending in zeros. Ties go to the smaller
    vec_id. A vec_id that is repeated is a candidate once for each row, and a query once for each row too, with ranks of its own. An empty table gives
    an empty result.
    """
    v = usable(vectors, nonzero=False)
    n, q, d, _ = shape(v, every)
    return by_blocks(v, every, BLOCK_ROWS, QUERY_ROWS, n, q, partial(_search, d=max(d, 1), k=k), k, "long")
