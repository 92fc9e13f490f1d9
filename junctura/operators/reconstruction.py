"""Predicted exons and patterns against those of a reference, and alignments within introns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.functions import cigar, tags
from junctura.operators import intervals, order


def typed_exons(transcripts: DataFrame) -> DataFrame:
    """Distinct (chr, strand, s, e, kind): single, first, internal or last by position on the chromosome."""
    e = transcripts.select("chr", "strand", F.size("exons").alias("n"), F.posexplode("exons").alias("i", "x"))
    kind = F.when(F.col("n") == 1, "single").when(F.col("i") == 0, "first").when(F.col("i") == F.col("n") - 1, "last").otherwise("internal")
    return e.select("chr", "strand", F.col("x.s").alias("s"), F.col("x.e").alias("e"), kind.alias("kind")).distinct()


def _agrees(share: float, stranded: bool | tuple[bool, bool]) -> Column:
    """stranded: whether strands must agree, or that for exons of spliced transcripts and for single ones apart."""
    spliced, single_ = stranded if isinstance(stranded, tuple) else (stranded, stranded)
    kind = F.col("r_kind")
    ends = F.when(kind == "internal", (F.col("s") == F.col("r_s")) & (F.col("e") == F.col("r_e"))).when(kind == "first", F.col("e") == F.col("r_e")).otherwise(F.col("s") == F.col("r_s"))
    single = F.least("e", "r_e") - F.greatest("s", "r_s") + 1 >= share * (F.col("r_e") - F.col("r_s"))
    strand = F.when(kind == "single", F.lit(not single_)).otherwise(F.lit(not spliced)) | (F.col("strand") == F.col("r_strand"))
    return F.when(kind == "single", single).otherwise(ends) & strand


def exon_pairs(predicted: DataFrame, reference: DataFrame, share: float = 0.6, stranded: bool | tuple[bool, bool] = True, width: int = 1000) -> DataFrame:
    """Pairs of overlapping exons (the columns of predicted, and r_...) that agree as the reference's kind asks: a single exon by the
    share of it that is covered, others by their inner ends. An equi-join on bins; a pair comes from the bin of its first common base."""
    right = reference.select(F.col("chr"), *[F.col(c).alias("r_" + c) for c in reference.columns if c != "chr"], "s", "e")
    met = intervals.binned(predicted, width).join(intervals.binned(right, width).drop("s", "e"), ["chr", "bin"])
    first = F.greatest("s", "r_s")
    met = met.where((first <= F.least("e", "r_e")) & (F.col("bin") == F.expr(f"greatest(s, r_s) div {width}")))
    return met.where(_agrees(share, stranded)).drop("bin")


def known_exons(reference: DataFrame, annotation: DataFrame, **how) -> DataFrame:
    """The exons of reference with known: whether one of annotation agrees with them."""
    hits = exon_pairs(reference, annotation, **how).select(*reference.columns).distinct().withColumn("known", F.lit(True))
    return reference.join(hits, reference.columns, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def exon_accuracy(predicted: DataFrame, reference: DataFrame, **how) -> DataFrame:
    """One row: exons predicted, correct, correct by a known one; exons of the reference, known ones, and those that a prediction met. reference has `known`."""
    flat = predicted.select("chr", "strand", "s", "e").distinct()
    pairs = exon_pairs(flat, reference, **how)
    one = lambda c: F.count(F.when(c, 1))
    hits = pairs.groupBy("chr", "strand", "s", "e").agg(F.max("r_known").alias("k"))
    found = flat.join(hits, ["chr", "strand", "s", "e"], "left").agg(F.count("*").alias("predicted"), F.count("k").alias("correct"), one(F.col("k")).alias("correct_known"))
    met = pairs.select("chr", *[F.col("r_" + c).alias(c) for c in ("strand", "s", "e", "kind")]).distinct().withColumn("met", F.lit(True))
    told = reference.join(met, ["chr", "strand", "s", "e", "kind"], "left").agg(
        F.count("*").alias("reference"), one(F.col("known")).alias("reference_known"), F.count("met").alias("reference_met"), one(F.col("known") & F.col("met")).alias("reference_known_met")
    )
    return found.join(F.broadcast(told))  # one row each


def chains(transcripts: DataFrame) -> DataFrame:
    """tx_id, chr, strand and introns of the spliced transcripts."""
    chain = F.transform(F.sequence(F.lit(1), F.size("exons") - 1), lambda i: F.struct(F.get("exons", i - 1)["e"].alias("left"), F.get("exons", i)["s"].alias("right")))
    return transcripts.where(F.size("exons") > 1).select("tx_id", "chr", "strand", chain.alias("introns"))


def pattern_ids(transcripts: DataFrame) -> DataFrame:
    """tx_id and pattern_id of each spliced transcript: patterns (introns and strand) are numbered from 1 without gaps, in their order."""
    return order.dense_ids(chains(transcripts), ["chr", "strand", "introns"], "pattern_id").select("tx_id", "pattern_id")


def pattern_members(transcripts: DataFrame) -> DataFrame:
    """tx_id of each spliced transcript and pattern, the smallest tx_id with the same introns on the same strand."""
    t = chains(transcripts)
    key = ["chr", "strand", "introns"]
    return t.join(t.groupBy(*key).agg(F.min("tx_id").alias("pattern")), key).select("tx_id", "pattern")


def intronic_counts(alignments: DataFrame, exons: DataFrame, repeats: DataFrame) -> DataFrame:
    """One row: mapped alignments, those whose whole span is within introns and in no repeat, and those in introns that touch a repeat."""
    mapped = alignments.where(~tags.has(F.col("flag"), tags.UNMAPPED))
    spans = mapped.select("chr", F.col("pos").alias("s"), (F.col("pos") + cigar.target_span(F.col("cigar")) - 1).alias("e")).groupBy("chr", "s", "e").agg(F.count("*").alias("n"))
    key = ["chr", "s", "e"]
    sums = lambda where: intervals.overlaps(spans.select(*key), where).groupBy(*key).agg(F.sum(F.least("e", "be") - F.greatest("s", "bs") + 1).alias("bases"))
    inside = sums(intervals.intron_territory(exons)).where("bases = e - s + 1").select(*key, F.lit(True).alias("inside"))
    touched = sums(intervals.union(repeats)).select(*key, F.lit(True).alias("touched"))
    x = spans.join(inside, key, "left").join(touched, key, "left")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return x.agg(total(F.lit(True)).alias("mapped"), total(F.col("inside") & F.col("touched").isNull()).alias("intronic"), total(F.col("inside") & F.col("touched")).alias("intronic_repeat"))
