"""Gaps of alignments: junctions, sizes, counts and positional profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.functions import cigar, tags


INTRON = 18  # bases; in the scoring of reads a longer gap over the reference is an intron and any other a deletion, whatever its letter


def has_intron(cigar_: Column) -> Column:
    """Whether an internal gap of more than INTRON bases is there; told by the string alone."""
    return cigar_.rlike(r"[A-Z=](19|[2-9][0-9]|[1-9][0-9]{2,})[ND][0-9]")


def tallied(alignments: DataFrame, by: list[str]) -> DataFrame:
    """Mapped alignments counted (n_reads) by the columns of `by` before their CIGAR is walked; each kind is then walked once."""
    return alignments.where(~tags.has(F.col("flag"), tags.UNMAPPED)).groupBy(*by).agg(F.count("*").alias("n_reads"))


def operations(alignments: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each CIGAR operation of the mapped alignments: the columns to keep, i, l, op, q, t and n (operations of the CIGAR)."""
    mapped = alignments.where(~tags.has(F.col("flag"), tags.UNMAPPED))
    steps = mapped.select(*keep, cigar.walk(F.col("cigar"), F.col("pos")).alias("steps"))
    # an inner generator would ask for the size of steps, walk included, of each row below a count or distinct
    return steps.select(*keep, F.size("steps").alias("n"), F.inline_outer("steps")).where("op is not null")


def introns(alignments: DataFrame, keep: list[str], least: int = 0) -> DataFrame:
    """Internal gaps over reference: N, or with `least` N and D longer than that. start is the first base of the gap."""
    kind = F.col("op").isin("N", "D") & (F.col("l") > least) if least else F.col("op") == "N"
    may = F.col("cigar").rlike("[ND]" if least else "N")  # the others are not walked
    found = operations(alignments.where(may), keep).where(kind & (F.col("i") > 0) & (F.col("i") < F.col("n") - 1))
    return found.select(*keep, F.col("t").alias("start"), F.col("l").alias("len"), F.col("q"))


def junction_counts(alignments: DataFrame) -> DataFrame:
    """chr, start, len and reads of each junction. Equal alignments are counted before their CIGAR is walked, but in a stream, which has one aggregation."""
    if alignments.isStreaming:
        return introns(alignments, ["chr"]).groupBy("chr", "start", "len").agg(F.count("*").alias("reads"))
    kinds = tallied(alignments.where(F.col("cigar").contains("N")), ["chr", "pos", "cigar"]).withColumn("flag", F.lit(0))
    return introns(kinds, ["chr", "n_reads"]).groupBy("chr", "start", "len").agg(F.sum("n_reads").alias("reads"))


def capped_histogram(counts: DataFrame, by: list[str], cap: int, value: str = "reads") -> DataFrame:
    return counts.groupBy(*by, F.least(F.col(value), F.lit(cap)).alias("depth")).agg(F.count("*").alias("junctions"))


def pivoted_histogram(counts: DataFrame, classes: DataFrame, by: list[str], cap: int) -> DataFrame:
    """A row for each class, zeros included: reads (not capped) and n1 .. n<cap>."""
    depth = F.least(F.col("reads"), F.lit(cap))
    sums = counts.groupBy(*by).agg(F.sum("reads").alias("reads"), *[F.count(F.when(depth == k, 1)).alias(f"n{k}") for k in range(1, cap + 1)])
    filled = classes.join(sums, by, "left")
    return filled.select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ["reads", *[f"n{k}" for k in range(1, cap + 1)]]])


def filled(counts: DataFrame, sizes: dict[str, int], values: list[str], kinds: DataFrame | None = None) -> DataFrame:
    """counts with a row for every place from 0 below each size (and for every row of kinds), zeros where there was none. The places are fixed, whatever the input."""
    spine = kinds if kinds is not None else counts.sparkSession.range(1).select(F.lit(None).alias("_"))
    for name, size in sizes.items():
        spine = spine.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))).alias(name))
    spine = spine.drop("_")
    key = spine.columns
    held = counts.select(*[F.col(c).cast("long").alias(c) if c in sizes else c for c in key], *values)
    for name, size in sizes.items():
        held = held.where(F.col(name).between(0, size - 1))
    return spine.join(held, key, "left").na.fill(0, values)


def position_class(op: Column, i: Column, n: Column, flag: Column) -> Column:
    """D, I, N for internal operations; D0, I0, S0 first and D1, I1, S1 last, as the read was sequenced."""
    backward = tags.has(flag, tags.REVERSE)
    first = F.when(backward, i == n - 1).otherwise(i == 0)
    last = F.when(backward, i == 0).otherwise(i == n - 1)
    ends = op.isin("D", "I", "S")
    return F.when(first & ends, F.concat(op, F.lit("0"))).when(last & ends, F.concat(op, F.lit("1"))).when(~first & ~last & op.isin("D", "I", "N"), op)


def classed(alignments: DataFrame, keep: list[str]) -> DataFrame:
    ops = operations(alignments, [*keep, "flag"])
    return ops.withColumn("class", position_class(F.col("op"), F.col("i"), F.col("n"), F.col("flag"))).where("class is not null")


def size_distribution(alignments: DataFrame) -> DataFrame:
    kinds = tallied(alignments.withColumn("flag", F.col("flag").bitwiseAND(F.lit(tags.UNMAPPED | tags.REVERSE))).withColumn("pos", F.lit(0)), ["flag", "pos", "cigar"])
    return classed(kinds, ["n_reads"]).groupBy("class", F.col("l").alias("size")).agg(F.sum("n_reads").alias("n"))


def counts_per_read(alignments: DataFrame, kinds=("D", "I", "N")) -> DataFrame:
    """How many mapped reads hold k internal operations of each kind, k from 0; one walk for each different CIGAR."""
    steps = tallied(alignments, ["cigar"]).select("n_reads", cigar.walk(F.col("cigar"), F.lit(0)).alias("s"))
    inner = lambda k: F.size(F.filter("s", lambda x: (x["op"] == k) & (x["i"] > 0) & (x["i"] < F.size("s") - 1)))
    each = steps.select("n_reads", F.explode(F.array(*[F.struct(F.lit(k).alias("op"), inner(k).alias("k")) for k in kinds])).alias("x"))
    return each.groupBy("x.op", "x.k").agg(F.sum("n_reads").alias("reads"))


def position_profile(alignments: DataFrame, length: int) -> DataFrame:
    """pos and the introns, deletions and inserted bases there, in sequenced orientation, zeros included."""
    kinds = tallied(alignments.withColumn("flag", F.col("flag").bitwiseAND(F.lit(tags.UNMAPPED | tags.REVERSE))).withColumn("pos", F.lit(0)), ["flag", "pos", "cigar"])
    ops = operations(kinds, ["flag", "n_reads"]).where((F.col("i") > 0) & (F.col("i") < F.col("n") - 1))
    at = tags.mirrored(F.col("q") - 1, F.col("flag"), length)
    base = F.when(tags.has(F.col("flag"), tags.REVERSE), length - 1 - F.col("b")).otherwise(F.col("b"))
    gaps = ops.where(F.col("op").isin("N", "D")).select(at.alias("pos"), "op", "n_reads")
    inserted = ops.where("op = 'I'").select("flag", "op", "n_reads", F.explode(F.sequence(F.col("q"), F.col("q") + F.col("l") - 1)).alias("b")).select(base.alias("pos"), "op", "n_reads")
    one = lambda k: F.sum(F.when(F.col("op") == k, F.col("n_reads")).otherwise(0))
    counts = gaps.union(inserted).groupBy("pos").agg(one("N").alias("introns"), one("D").alias("deletions"), one("I").alias("insertions"))
    spine = ops.sparkSession.range(length).select(F.col("id").cast("int").alias("pos"))
    return spine.join(F.broadcast(counts.where(F.col("pos").between(0, length - 1))), "pos", "left").na.fill(0)  # at most `length` rows
