"""Interval algebra over rows (chr, s, e), 1-based and closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 1 << 16  # bases of a chromosome that one group sees


def _lot(column: str, stretch: int) -> Column:
    return F.floor(F.col(column) / stretch).cast("long")


def union(intervals: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Disjoint intervals that cover the same bases; adjacent ones are merged.

    Intervals are cut at the bounds of stretches of `stretch` bases and merged in each stretch apart from the others, which sees one row
    for each begin at most. Only what touches a bound, at most two pieces of a stretch, is then merged along its chromosome.
    """
    kind = {c: intervals.schema[c].dataType for c in ("s", "e")}
    lots = intervals.select("chr", "s", "e", F.explode(F.sequence(_lot("s", stretch), _lot("e", stretch))).alias("lot"))
    begin, end = F.col("lot") * stretch, F.col("lot") * stretch + stretch - 1
    cut = lots.select("chr", "lot", F.greatest("s", begin).alias("s"), F.least("e", end).alias("e")).groupBy("chr", "lot", "s").agg(F.max("e").alias("e"))
    inside = _merged(cut, ["chr", "lot"])
    touches = (F.col("s") == begin) | (F.col("e") == end)
    whole = _merged(inside.withColumn("lot", F.when(~touches, F.col("lot"))), ["chr", "lot"])  # null: what touches a bound
    return whole.select("chr", *[F.col(c).cast(kind[c]).alias(c) for c in ("s", "e")])


def _merged(intervals: DataFrame, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = intervals.withColumn("new", F.when(F.col("s") <= reach + 1, 0).otherwise(1))
    island = new.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def gaps(disjoint: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The bases between disjoint intervals of a chromosome. Neighbours are found within stretches, then among the first and last of each."""
    w = Window.partitionBy("chr", "lot").orderBy("s")
    near = disjoint.select("chr", "s", "e", _lot("s", stretch).alias("lot")).select("*", F.lead("s").over(w).alias("nxt"), F.lag("s").over(w).isNull().alias("first"))
    edge = F.col("first") | F.col("nxt").isNull()
    near = near.withColumn("lot", F.when(~edge, F.col("lot")))  # null: first or last of a stretch
    found = near.select("chr", "e", F.coalesce("nxt", F.lead("s").over(w)).alias("nxt"))
    return found.select("chr", (F.col("e") + 1).alias("s"), (F.col("nxt") - 1).alias("e")).where("e >= s")


def binned(intervals: DataFrame, width: int) -> DataFrame:
    return intervals.withColumn("bin", F.explode(F.sequence(F.expr(f"s div {width}"), F.expr(f"e div {width}"))))


def overlaps(a: DataFrame, b: DataFrame, width: int = 1000) -> DataFrame:
    """Pairs that share a base: the columns of a, and bs, be. An equi-join on bins; each pair comes from the bin of its first common base."""
    right = binned(b.select("chr", F.col("s").alias("bs"), F.col("e").alias("be"), "s", "e"), width).drop("s", "e")
    met = binned(a, width).join(right, ["chr", "bin"])
    first = F.greatest("s", "bs")
    return met.where((first <= F.least("e", "be")) & (F.col("bin") == F.expr(f"greatest(s, bs) div {width}"))).select(*a.columns, "bs", "be")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return overlaps(a, b).select("chr", F.greatest("s", "bs").alias("s"), F.least("e", "be").alias("e"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bases of the disjoint intervals a that no interval of the disjoint b covers."""
    spans = a.groupBy("chr").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    ends = spans.select("chr", (F.col("lo") - 1).alias("s"), (F.col("lo") - 1).alias("e")).union(spans.select("chr", F.col("hi") + 1, F.col("hi") + 1))
    return union(intersection(a, gaps(union(b.select("chr", "s", "e").union(ends)))))


def intron_territory(exons: DataFrame) -> DataFrame:
    """What lies within a transcript's span and in no exon; exons: tx_id, chr, s, e."""
    genic = union(exons.groupBy("tx_id", "chr").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("chr", "s", "e"))
    return subtract(genic, union(exons.select("chr", "s", "e")))


def covered(windows: DataFrame, key: list[str], disjoint: DataFrame) -> DataFrame:
    """key, s, e and the bases of each window that the disjoint intervals cover."""
    width = F.least("e", "be") - F.greatest("s", "bs") + 1
    sums = overlaps(windows, disjoint).groupBy(*key).agg(F.sum(width).alias("covered"))
    return windows.join(sums, key, "left").select(*key, "s", "e", F.coalesce("covered", F.lit(0)).alias("covered"))
