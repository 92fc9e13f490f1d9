"""Transcripts, their introns and exons, and the classes of junctions against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = ("Known splice", "Same gene", "Different genes", "One novel", "Both novel")


def introns(transcripts: DataFrame) -> DataFrame:
    """Distinct (chr, gene_id, left, right) with the flanking bases, from transcripts (tx_id, gene_id, chr, strand, exons array<struct<s, e>>)."""
    gap = F.transform(F.sequence(F.lit(1), F.size("exons") - 1), lambda i: F.struct(F.get("exons", i - 1)["e"].alias("left"), F.get("exons", i)["s"].alias("right")))
    return transcripts.where(F.size("exons") > 1).select("chr", "gene_id", F.inline(gap)).distinct()


def classify(junctions: DataFrame, splices: DataFrame, name: str = "class1") -> DataFrame:
    """Adds the class of each junction (chr, start, len). Annotation is unstranded here.

    The three lookups are joins on the junction's ends; Catalyst broadcasts them where they are small.
    """
    j = junctions.withColumn("left", F.col("start") - 1).withColumn("right", F.col("start") + F.col("len"))
    pairs = splices.select("chr", "left", "right").distinct().withColumn("_known", F.lit(True))
    ends = lambda c: splices.groupBy("chr", c).agg(F.collect_set("gene_id").alias(f"_{c}"))
    m = j.join(pairs, ["chr", "left", "right"], "left").join(ends("left"), ["chr", "left"], "left").join(ends("right"), ["chr", "right"], "left")
    l, r = F.col("_left").isNotNull(), F.col("_right").isNotNull()
    kind = F.when(F.col("_known"), CLASSES[0]).when(l & r & F.arrays_overlap("_left", "_right"), CLASSES[1]).when(l & r, CLASSES[2]).when(l | r, CLASSES[3]).otherwise(CLASSES[4])
    return m.select(*junctions.columns, kind.alias(name))


def exons(transcripts: DataFrame) -> DataFrame:
    """tx_id, chr, strand, s, e and kind (single, first, internal, last, as transcribed) of every exon."""
    n = F.size("exons")
    e = transcripts.select("tx_id", "chr", "strand", n.alias("n"), F.posexplode("exons").alias("i", "x")).select("tx_id", "chr", "strand", "n", "i", F.col("x.s").alias("s"), F.col("x.e").alias("e"))
    low, high = F.col("i") == 0, F.col("i") == F.col("n") - 1
    minus = F.col("strand") == "-"
    kind = F.when(F.col("n") == 1, "single").when(F.when(minus, high).otherwise(low), "first").when(F.when(minus, low).otherwise(high), "last").otherwise("internal")
    return e.select("tx_id", "chr", "strand", "s", "e", kind.alias("kind"))


def expressed(features: DataFrame, expression: DataFrame, value: str, above: float = 0.0, key: str = "tx_id") -> DataFrame:
    """The features of transcripts whose value is above the bound; a transcript without a row in expression goes."""
    return features.join(expression.where(F.col(value) > above).select(key), key, "left_semi")


def gene_types(features: DataFrame) -> DataFrame:
    """gene_id and its type; n_types above 1 tells of a conflict."""
    return features.groupBy("gene_id").agg(F.min("type").alias("type"), F.countDistinct("type").alias("n_types"))
