"""What the two searches over vectors share: which vectors count, blocks of candidates and queries, and the final ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id and v (array<double>) of the vectors that are not null and hold no null or non-finite component.

    Rows without a vec_id take no part. With nonzero, vectors of zeros take none either. Empty vectors count as zero.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return v.where(F.exists("v", lambda x: x != 0)) if nonzero else v


def shape(v: DataFrame, every: int) -> tuple[int, int, int, float]:
    """Vectors, queries among them, components of the longest, and the largest norm."""
    top = F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0))
    norm = F.when(top == 0, 0.0).otherwise(top * F.sqrt(F.aggregate(F.transform("v", lambda x: x / top), F.lit(0.0), lambda a, x: a + x * x)))  # squares stay in range
    r = v.agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q"), F.max(F.size("v")).alias("d"), F.max(norm).alias("norm")).first()
    return r["n"], r["q"] or 0, r["d"] or 0, r["norm"] or 0.0


def by_blocks(v: DataFrame, every: int, rows: int, query_rows: int, n: int, q: int, search, k: int, kind: str) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of what search() finds for each query in each block of candidates.

    The candidates are dealt to blocks by a hash of their id, so equal or near vectors spread over all blocks; the queries
    to blocks of their own. Every block of queries meets every block of candidates in one task. Rows that repeat a query's
    id are queries of their own, told apart by `copy`.
    """
    blocks, query_blocks = max(1, -(-n // rows)), max(1, -(-q // query_rows))
    h = F.xxhash64("vec_id")
    ids = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    candidates = v.select(F.pmod(h, F.lit(blocks)).cast("int").alias("block"), "vec_id", "v").withColumn("query_block", ids(query_blocks))
    told = F.row_number().over(Window.partitionBy("vec_id").orderBy("v"))
    asked = v.where(F.col("vec_id") % every == 0).withColumn("copy", told)
    queries = asked.select("copy", F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(query_blocks)).cast("int").alias("query_block"), "vec_id", "v").withColumn("block", ids(blocks))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "copy", "vec_id", "score"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64() if kind == "long" else pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        left, right = left.sort_by("vec_id"), right.sort_by([("vec_id", "ascending"), ("copy", "ascending")])
        query_ids = right.column("vec_id").to_numpy()
        count, found = np.zeros(len(query_ids), np.int64), []
        for i, at, score in search(left.column("vec_id").to_numpy(), left.column("v"), right.column("v"), query_ids):
            count[i] = len(at)
            found.append((at, score))
        columns = [np.repeat(query_ids, count), np.repeat(right.column("copy").to_numpy(), count), *(np.concatenate(x) for x in zip(*found))]
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds)], names=names)

    met = candidates.groupBy("block", "query_block").cogroup(queries.groupBy("block", "query_block")).applyInArrow(run, f"query_id long, copy int, vec_id long, score {kind}")
    best = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The inner product of each row with q, summed component by component, so that equal rows have equal products wherever they stand."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * q[j]
    return out


def dense(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Rows of d components; shorter vectors end in zeros."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if (n == d).all():
        return flat.reshape(len(n), d)
    out = np.zeros((len(n), d))
    out[np.arange(d) < n[:, None]] = flat
    return out


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > k:
        low = np.partition(score, len(score) - k)[len(score) - k]
        keep = np.flatnonzero(score >= low)
    else:
        keep = np.arange(len(score))
    return keep[np.lexsort((ids[keep], -score[keep]))[:k]]
