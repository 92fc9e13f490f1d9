"""What a plan promises about its rows: counts taken while it runs, bad rows told by their first examples."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Watch:
    """Counts of conditions over the rows that pass through a plan, taken by the plan's own action."""

    def __init__(self, observation: Observation):
        self._observation = observation

    def counts(self) -> dict[str, int]:
        """The counts; waits for the first action on the watched rows."""
        return dict(self._observation.get)

    def enforce(self, **most: int) -> None:
        """An error if more rows than allowed met a condition; a condition without a bound may hold anywhere."""
        seen = self.counts()
        over = {k: seen[k] for k, bound in most.items() if seen[k] > bound}
        if over:
            raise ValueError("; ".join(f"{n} rows are {k}, at most {most[k]} may be" for k, n in sorted(over.items())))


def watched(df: DataFrame, **conditions: Column) -> tuple[DataFrame, Watch]:
    """df as it is, and the counts of rows that meet each condition. Nothing is scanned or shuffled for them."""
    seen = Observation()
    return df.observe(seen, *[F.count(F.when(c, 1)).alias(k) for k, c in conditions.items()]), Watch(seen)


def pairing(both: DataFrame) -> tuple[DataFrame, Watch]:
    """Rows of placement.met with the counts of reads (rows), reads without a report (absent), unmapped ones and those on another chromosome (elsewhere)."""
    mapped = F.col("r_flag").bitwiseAND(F.lit(4)) == 0
    return watched(both, rows=F.lit(True), absent=F.col("r_cigar").isNull(), unmapped=~mapped & F.col("r_cigar").isNotNull(), elsewhere=mapped & (F.col("chr") != F.col("r_chr")))


def first_faults(df: DataFrame, kinds: dict[str, Column], order: list[str], most: int = 10, merge: int = 256) -> DataFrame:
    """kind, n (rows of this kind) and first, the `most` first of them as structs of the columns of `order`, in that order (nulls first). Kinds without rows are left out.

    One pass: each partition keeps `most` rows of a kind, which are merged `merge` partitions at a time. The input is not sorted.
    """
    names = list(kinds)
    held = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(kinds.values())]), lambda k: k.isNotNull())
    bad = df.select(held.alias("_kinds"), F.struct(*order).alias("row")).where(F.size("_kinds") > 0).select(F.explode("_kinds").alias("kind"), "row")
    row = f"struct<{','.join(f'{f.name}:{f.dataType.simpleString()}' for f in df.select(*order).schema)}>"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, top, kind_of = {}, {}, None
        for batch in batches:
            kind_of = batch.schema.field("row").type
            by: dict[int, list[dict]] = {}
            for k, r in zip(batch.column("kind").to_pylist(), batch.column("row").to_pylist()):
                by.setdefault(k, []).append(r)
            for k, rows in by.items():
                counts[k] = counts.get(k, 0) + len(rows)
                top[k] = heapq.nsmallest(most, chain(top.get(k, ()), rows), key=lambda r: [(r[c] is not None, r[c]) if r[c] is not None else (False,) for c in order])
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64()), pa.array([top[k] for k in counts], pa.list_(kind_of))], ["kind", "n", "first"])

    parts = bad.mapInArrow(local, f"kind int, n long, first array<{row}>").withColumn("part", F.spark_partition_id())
    # array_sort puts null structs last, but fields within a struct with nulls first
    joined = lambda by: [F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("first"))), 1, most).alias("first")]
    some = parts.groupBy("kind", F.expr(f"part div {merge}").alias("part")).agg(*joined(None))
    every = some.groupBy("kind").agg(*joined(None))
    return every.select(F.get(F.array(*map(F.lit, names)), F.col("kind")).alias("kind"), "n", "first")
