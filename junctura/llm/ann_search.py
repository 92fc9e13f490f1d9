"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 7).

Vectors are scaled by the largest norm and get one more component that makes them unit vectors, so the
largest inner product is the smallest Euclidean distance. In each of TABLES tables, HASHES normal projections,
shifted and cut into cells of WIDTH, name a bucket, which is found by its key. A query probes its own bucket and those beside it: a
perturbation moves some projections into the next lower or higher cell and costs the sum of squared distances to these cells' bounds, the less the likelier it
succeeds. All perturbations are listed once, by a heap over the expected order of the distances; a query puts its own distances to them and visits
buckets in the order of its costs, up to a reach that all queries share and on until as many rows as are asked for are found (all rows of the table, if its
probes hold fewer). What the tables hold is merged and ranked by the exact inner product of the original vectors.

The reach is fitted on a sample of at most SAMPLE vectors, chosen by a hash of the id and brought to the driver: among them the
distances to the nearest ones of so many queries tell how far FOUND of the neighbours in all rows lie. Every row is indexed.

Tables are built for blocks of candidates, dealt by a hash of the id: a very frequent vector, whose
bucket would hold a third of all rows, is spread over all blocks.
"""

from __future__ import annotations

import heapq
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm.vectors import best_of, by_blocks, dense, inner, shape, usable

TABLES, HASHES, WIDTH = 3, 6, 1.4
PROBES = 729  # perturbations of a table, 3^HASHES: each projection in its cell, the one below or the one above
FOUND = 0.93  # of the neighbours in the sample lie within the reach
SAMPLE, ASKED = 4096, 256  # vectors of the sample, and queries among them
BLOCK_ROWS, QUERY_ROWS = 16_384, 8_192


def unit(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    if query:
        x = x / np.abs(x).max(axis=1, keepdims=True)  # squares stay in range
        return np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))]
    x = x / norm
    return np.c_[x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))]


@lru_cache(maxsize=4)
def perturbations(hashes: int, most: int) -> np.ndarray:
    """Sets of moves as rows of 0 and 1 over the 2 * hashes moves in ascending order of distance, the cheapest sets by expected squared distance first.

    In that order the moves at j and at 2 * hashes - 1 - j are those of one projection downward and upward, so no set holds both.
    """
    m = hashes
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))  # of uniform distances in a cell, squared
    j = np.arange(m + 1, 2 * m + 1)
    cost = np.r_[near, 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2))]
    heap, found = [(cost[0], (0,))], [()]
    while heap and len(found) < most:
        total, moves = heapq.heappop(heap)
        last = moves[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*moves[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*moves, last + 1)))
        if all(2 * m - 1 - x not in moves for x in moves):
            found.append(moves)
    out = np.zeros((len(found), 2 * m))
    for row, moves in zip(out, found):
        row[list(moves)] = 1
    return out


class Table:
    """Buckets of one table over the rows of a block."""

    def __init__(self, x: np.ndarray, seed: int, hashes: int, width: float, probes: int = PROBES):
        rng = np.random.default_rng([seed, 977])
        self.project = rng.standard_normal((x.shape[1], hashes)) / width
        self.shift = rng.uniform(0, 1, hashes)
        self.moves = perturbations(hashes, probes)
        cell = np.floor(x @ self.project + self.shift).astype(np.int64)
        self.low = cell.min(axis=0)
        self.span = cell.max(axis=0) - self.low + 1
        if np.prod(self.span.astype(float)) > 2**52:
            raise ValueError("too many cells for a key: fewer hashes or a greater width")
        self.radix = np.r_[1, np.cumprod(self.span[:-1])]
        self.keys, inverse, self.count = np.unique((cell - self.low) @ self.radix, return_inverse=True, return_counts=True)
        self.bucket = inverse.ravel()
        self.rows = np.argsort(self.bucket, kind="stable")
        self.start = np.cumsum(self.count) - self.count

    def probe(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and perturbation the bucket (-1 if there is none) and the cost."""
        at = queries @ self.project + self.shift
        cell = np.floor(at)
        inside, away = at - cell, cell - self.low
        distance = np.c_[inside, 1 - inside]  # to the cell below, to the one above
        order = np.argsort(distance, axis=1, kind="stable")
        sorted_ = lambda x: np.take_along_axis(np.broadcast_to(x, distance.shape), order, 1)
        outside = lambda x: ((x < 0) | (x >= self.span)).astype(float)  # noqa: E731  cells that no row has
        off = outside(away)
        turned = sorted_(np.c_[outside(away - 1) - off, outside(away + 1) - off]) @ self.moves.T + off.sum(axis=1)[:, None]
        key = (away @ self.radix)[:, None] + sorted_(np.r_[-self.radix, self.radix].astype(float)) @ self.moves.T
        cost = np.square(sorted_(distance)) @ self.moves.T
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((turned < 0.5) & (self.keys[place] == key), place, -1), cost

    def visit(self, queries: np.ndarray, reach: float, least: int) -> list[np.ndarray]:
        """For each query the buckets to visit, best estimated success first, within reach and on until they hold `least` rows."""
        out = []
        for buckets, cost in zip(*self.probe(queries)):
            there = np.flatnonzero(buckets >= 0)
            there = there[np.argsort(cost[there], kind="stable")]
            held = np.cumsum(self.count[buckets[there]])
            n = max(np.searchsorted(cost[there], reach, side="right"), np.searchsorted(held, least) + 1)
            enough = len(held) and held[-1] >= least
            out.append(buckets[there[:n]] if enough else np.arange(len(self.count)))
        return out

    def of(self, buckets: np.ndarray) -> np.ndarray:
        n = self.count[buckets]
        end = np.cumsum(n)
        return self.rows[np.arange(end[-1]) + np.repeat(self.start[buckets] - (end - n), n)]


def fitted_reach(x: np.ndarray, n: int, norm: float, k: int, tables: int, hashes: int, width: float) -> float:
    """The reach within which, in one table at least, FOUND of the k nearest of n vectors lie, by the sample x."""
    x = np.random.default_rng(3).permutation(np.unique(x / norm if norm else x, axis=0))  # copies of a vector say nothing of the reach
    if len(x) < 2:
        return np.inf
    q = x[:ASKED]
    score = q @ x.T
    np.fill_diagonal(score, -np.inf)
    rank = min(len(x) - 1, -(-k * len(x) // n) + (3 if n > len(x) else 0))  # where the k nearest of all rows stand among the sample
    near = np.argpartition(-score, rank - 1, axis=1)[:, :rank]
    least = np.full(near.shape, np.inf)
    for t in range(tables):
        table = Table(unit(x, 1 + 1e-12, False), t, hashes, width)
        for i, (buckets, cost) in enumerate(zip(*table.probe(unit(q, 1.0, True)))):
            of_bucket = np.full(len(table.count), np.inf)
            np.minimum.at(of_bucket, buckets[buckets >= 0], cost[buckets >= 0])
            least[i] = np.minimum(least[i], of_bucket[table.bucket[near[i]]])
    return float(np.quantile(least, FOUND, method="higher"))


def _search(ids, rows, queries, query_ids, d, norm, k, tables, hashes, width, reach):
    x, q = dense(rows, d), dense(queries, d)
    made = [Table(unit(x, norm, False), t, hashes, width) for t in range(tables)]
    for lo in range(0, len(q), 64):
        part = unit(q[lo : lo + 64], norm, True)
        visits = [t.visit(part, reach, k + 1) for t in made]
        for i in range(len(part)):
            seen = np.zeros(len(ids), bool)
            for t, v in zip(made, visits):
                seen[t.of(v[i])] = True
            at = np.flatnonzero(seen & (ids != query_ids[lo + i]))
            one = q[lo + i]
            with np.errstate(over="ignore", invalid="ignore"):
                rough = x[at] @ one
                if len(at) > k and np.isfinite(rough).all():  # the exact order is found among those that rounding leaves in question
                    least = np.partition(rough, len(rough) - k)[len(rough) - k]
                    at = at[~(rough < least - 1e-13 * d * norm * np.abs(one).sum())]
                score = inner(x[at], one)
            top = best_of(np.where(np.isnan(score), -np.inf, score), ids[at], k)
            yield lo + i, ids[at][top], score[top]


def search(vectors: DataFrame, k: int = 20, every: int = 20, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for every row whose vec_id is divisible by `every`.

    Candidates are all rows but those with the query's vec_id. Rows that are null, zero, or hold a null or
    non-finite component take no part; shorter vectors count as ending in zeros. A vec_id that is repeated is a candidate once for each row,
    and a query once for each row too, with ranks of its own. Equal vectors have equal scores, their ties go to the smaller vec_id. Columns but
    vec_id and embedding are not looked at. An empty table gives an empty result. Components may be of any size as long as norms are in range (sums of squares need not be);
    a product out of range is infinite as in any double, and one that adds up both infinities comes last.
    """
    v = usable(vectors, nonzero=True)
    n, q, d, norm = shape(v, every)
    norm *= 1 + 1e-12
    chosen = v.orderBy(F.xxhash64(F.lit(11), "vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    sample = np.zeros((len(chosen), max(d, 1)))
    for row, r in zip(sample, chosen):
        row[: len(r["v"])] = r["v"]
    reach = fitted_reach(sample, max(n, 1), norm, k, tables, hashes, width)
    find = partial(_search, d=d, norm=norm, k=k, tables=tables, hashes=hashes, width=width, reach=reach)
    return by_blocks(v, every, BLOCK_ROWS, QUERY_ROWS, n, q, find, k, "double")
