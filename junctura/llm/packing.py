"""Conflict-constrained best-fit packing (operator 10).

Sequences of `capacity` tokens are filled with documents, no two of one source and no two of one cluster
of duplicates in a sequence. Documents are dealt at random to groups that are packed apart from each
other, so no task sees more than a group. In a group they are placed in descending length: the bins stand
in order of their residual, each with a bitmap of its sources and one of its clusters; from the successor
of the length on, the first bin that holds neither is the tightest that fits, and no bin is left out of the search.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm.common import batches_of, checkpoint, forget, give_back, strings

GROUP_ROWS = 4096
CAPACITY = 2048
BATCH_ROWS = 2048  # whole texts that pass to Python at a time; both sides hold them


def pack_group(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """For each item (of 1 to capacity tokens) its bin and place there, and for each bin its residual.

    sources and clusters are small numbers; a negative one conflicts with nothing. Placed longest first, ties in the order given.
    """
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins, at = [0] * len(lengths), [0] * len(lengths)
    residual: list[int] = []
    count: list[int] = []
    marks: list[int] = []
    ordered: list[tuple[int, int]] = []  # (residual, bin) of the bins that are not full
    shift = max(sources, default=0) + 1
    for i in order:
        n = lengths[i]
        mark = (1 << sources[i] if sources[i] >= 0 else 0) | (1 << shift + clusters[i] if clusters[i] >= 0 else 0)
        k = bisect_left(ordered, (n, -1))
        while k < len(ordered) and marks[ordered[k][1]] & mark:
            k += 1
        if k < len(ordered):
            b = ordered.pop(k)[1]
        else:
            b = len(residual)
            residual.append(capacity)
            count.append(0)
            marks.append(0)
        bins[i], at[i] = b, count[b]
        count[b] += 1
        residual[b] -= n
        marks[b] |= mark
        if residual[b]:
            insort(ordered, (residual[b], b))
    return bins, at, residual


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items: doc_id, source, cluster (long), n_tokens. Returns one row for each placed piece of a document.

    doc_id, source, piece, n_tokens (of the piece), pack_group, bin (in its group), place (in its bin), residual (of the bin).

    A document longer than the capacity is cut into full pieces, each a bin of its own, and a rest. A document
    without tokens (null or 0) is a piece of 0 tokens in bin -1. A null source or cluster conflicts with nothing.
    Rows with one doc_id are packed each on their own.
    """
    with batches_of(items.sparkSession, BATCH_ROWS):
        items = checkpoint(items.select("doc_id", "source", "cluster", "n_tokens"))  # lengths cost more than anything here; they are taken once
    groups = max(1, -(-items.count() // GROUP_ROWS))
    dealt = items.select(F.pmod(F.xxhash64(F.lit(5), "doc_id", "cluster"), F.lit(groups)).cast("int").alias("pack_group"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("long").alias("cluster"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        total = table.column("n_tokens").to_numpy()
        full, rest = total // capacity, total % capacity
        code = lambda name: table.column(name).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        sources, clusters = code("source").tolist(), code("cluster")
        often = np.bincount(clusters + 1, minlength=2) > 1
        often[0] = False  # no cluster; one that is alone in the group needs no bit either
        clusters = np.where(often[clusters + 1], (np.cumsum(often) - 1)[clusters + 1], -1).tolist()
        with_rest = np.flatnonzero(rest)
        bins, at, residual = pack_group(rest[with_rest].tolist(), [sources[i] for i in with_rest], [clusters[i] for i in with_rest], capacity)
        row = [np.repeat(np.arange(len(total)), full), with_rest, np.flatnonzero(total == 0)]
        k = len(row[0])
        piece = np.r_[np.arange(k) - np.repeat(np.cumsum(full) - full, full), full[with_rest], np.zeros(len(row[2]), np.int64)]
        size = np.r_[np.full(k, capacity), rest[with_rest], np.zeros(len(row[2]), np.int64)]
        bin_ = np.r_[len(residual) + np.arange(k), np.array(bins, np.int64), np.full(len(row[2]), -1)]
        left = np.r_[np.zeros(k, np.int64), np.array(residual, np.int64)[bins] if bins else np.zeros(0, np.int64), np.full(len(row[2]), capacity)]
        place = np.r_[np.zeros(k, np.int64), np.array(at, np.int64), np.arange(len(row[2]))]
        took = table.take(pa.array(np.concatenate(row)))
        as_int = lambda x: pa.array(x.astype(np.int32))
        return pa.table([took.column("doc_id"), took.column("source"), as_int(piece), as_int(size), took.column("pack_group"), as_int(bin_), as_int(place), as_int(left)], names=["doc_id", "source", "piece", "n_tokens", "pack_group", "bin", "place", "residual"])

    return dealt.groupBy("pack_group").applyInArrow(run, "doc_id long, source string, piece int, n_tokens int, pack_group int, bin int, place int, residual int")


def measured(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, source, cluster (of equal texts; none for empty ones) and n_tokens by the tokenizer, with an end id for each document that has a text."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.when(F.length("text") > 0, F.xxhash64("text")).alias("cluster"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    return source.mapInArrow(_lengths(tokenizer), "doc_id long, source string, cluster long, n_tokens long")


def _lengths(tokenizer: str):
    """Counts the ids of the texts in a worker that holds nothing else and keeps nothing afterwards: idle workers count too, while Spark plans, sorts and writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from junctura.llm.bpe import chunks
        from junctura.llm.token_files import COUNTED, encoder_of

        forget()
        try:
            encoder = encoder_of(tokenizer)
            for batch in batches:
                n = [k + 1 if t else 0 for part in chunks(strings(batch.column(3)), COUNTED) for t, k in zip(part, encoder.counts(part))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], ["doc_id", "source", "cluster", "n_tokens"])
                give_back()
        finally:
            encoder = batch = None
            forget()

    return run
