"""Alignments (SAM text), annotation (GTF), reads (FASTQ) and small tables as DataFrames. Compressed files are read by their suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAM = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment lines with typed columns and `tags`, an array of the optional fields. Header lines (@) are left out."""
    f = F.split("value", "\t")
    ints = {"flag", "pos", "mapq", "pnext", "tlen"}
    body = spark.read.text(path).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    columns = [F.get(f, F.lit(i)).cast("int" if c in ints else "string").alias(c) for i, c in enumerate(SAM)]
    return body.select(*columns, F.slice(f, 12, 1 << 20).alias("tags"))


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value").startswith("@"))


def gtf(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    attribute = lambda name: F.nullif(F.regexp_extract(F.get(f, F.lit(8)), rf'\b{name}\s+"?([^";]+)"?', 1), F.lit(""))
    body = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(f) > 8))
    return body.select(
        F.get(f, F.lit(0)).alias("chr"), F.get(f, F.lit(1)).alias("type"), F.get(f, F.lit(2)).alias("feature"), F.get(f, F.lit(3)).cast("int").alias("s"), F.get(f, F.lit(4)).cast("int").alias("e"),
        F.get(f, F.lit(6)).alias("strand"), attribute("gene_id").alias("gene_id"), attribute("transcript_id").alias("tx_id"),
    )


def transcripts(features: DataFrame, type_: str | None = None) -> DataFrame:
    """tx_id, gene_id, type, chr, strand and sorted exons. A transcript with two genes, types, chromosomes or strands is an error."""
    e = features.where(F.col("feature") == "exon")
    e = e.where(F.col("type") == type_) if type_ else e
    one = ("gene_id", "type", "chr", "strand")
    made = e.groupBy("tx_id").agg(*[F.min(c).alias(c) for c in one], *[F.max(c).alias("_" + c) for c in one], F.sort_array(F.collect_set(F.struct("s", "e"))).alias("exons"))
    clash = F.lit(False)
    for c in one:
        clash = clash | (F.col(c) != F.col("_" + c))
    checked = F.when(F.coalesce(clash, F.lit(False)), F.raise_error(F.concat(F.lit("conflicting transcript "), "tx_id")).cast("string")).otherwise(F.col("tx_id"))
    return made.select(checked.alias("tx_id"), *one, "exons")


BLOCKS = 100_000  # of files, one row each, that are brought to the driver and broadcast


def numbered_lines(spark: SparkSession, path: str, eager: bool = False) -> DataFrame:
    """file, value and i, the number of the line in its file, from 0.

    Lines are numbered in the blocks that a file is read by; the sums over its blocks, one row each, give their place in the file. eager: the blocks are counted now, and if
    they are BLOCKS at most, they are broadcast and lines need no shuffle for their numbers.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moves = blocks.select("file", "block", (above - F.col("first")).alias("shift"))
    if eager:
        known = moves.limit(BLOCKS + 1).collect()
        if len(known) <= BLOCKS:
            moves = F.broadcast(spark.createDataFrame(known, moves.schema))
    return lines.join(moves, ["file", "block"]).select("file", "value", (F.col("at") + F.col("shift")).alias("i"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """id, mate (by the header, else by _1 or _2 in the file's name), seq and qual of four-line records. A quality line may begin like a header, so records are told by the number of the line in its file."""
    four = numbered_lines(spark, path, eager=True).groupBy("file", F.expr("i div 4").alias("record")).agg(*[F.max(F.when(F.col("i") % 4 == k, F.col("value"))).alias(c) for k, c in enumerate(("head", "seq", "plus", "qual"))])
    mate = F.coalesce(F.nullif(F.regexp_extract("head", r"/([12])$", 1), F.lit("")), F.nullif(F.regexp_extract("head", r"^\S+\s+([12]):", 1), F.lit("")), F.nullif(F.regexp_extract("file", r"_([12])[^/0-9][^/]*$", 1), F.lit("")))
    return four.select(F.regexp_extract("head", r"^@([^\s/]+)", 1).alias("id"), mate.cast("int").alias("mate"), "seq", "qual")


def repeats(spark: SparkSession, path: str) -> DataFrame:
    """chr, s, e (1-based, closed) from columns 6 to 8 of a repeat table with 0-based begins."""
    t = spark.read.csv(path, sep="\t")
    return t.select(F.col("_c5").alias("chr"), (F.col("_c6").cast("int") + 1).alias("s"), F.col("_c7").cast("int").alias("e"))


def shifts(spark: SparkSession, path: str) -> DataFrame:
    """chr, op, t, size, ls and rs of shifts as operators.ambiguity takes them, from tab-separated region, pos, signed size (deletions are negative), left and right shift."""
    t = spark.read.csv(path, sep="\t")
    n = lambda i: F.col(f"_c{i}").cast("int")
    return t.select(F.col("_c0").alias("chr"), F.when(n(2) < 0, "D").otherwise("I").alias("op"), n(1).alias("t"), F.abs(n(2)).alias("size"), n(3).alias("ls"), n(4).alias("rs")).where("size > 0")


def coverage(spark: SparkSession, path: str, cap: int = 20) -> DataFrame:
    """chr, start, len and reads (at most cap) from tab-separated chr:a-b, the bases beside a junction, and its reads."""
    t = spark.read.csv(path, sep="\t")
    part = lambda i: F.regexp_extract("_c0", r"^(.+):([0-9]+)-([0-9]+)$", i)
    a, b = part(2).try_cast("int"), part(3).try_cast("int")
    return t.select(part(1).alias("chr"), (a + 1).alias("start"), (b - a - 1).alias("len"), F.least(F.col("_c1").cast("int"), F.lit(cap)).alias("reads")).where("start is not null")


def keyed(spark: SparkSession, glob: str, header: bool = True) -> DataFrame:
    """Tab-separated files with family, team, dataset and number from names such as family.team.dataset_number.txt."""
    name = F.col("_metadata.file_name")
    part = lambda i: F.regexp_extract(name, r"^(.+)\.([^.]+)\.([^.]+)_([0-9]+)\.txt$", i)
    return spark.read.csv(glob, sep="\t", header=header).select("*", part(1).alias("family"), part(2).alias("team"), part(3).alias("dataset"), part(4).cast("int").alias("number"))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)
