"""Text files of sections that begin with a line of their own kind: transcript blocks of a simulator, sequences in FASTA.

A section may begin in one split of a file and end in another. Lines are numbered by section within the blocks a file is read by, and sums
over the blocks of a file, one row each, move the numbers; a section is then a group by file and number, wherever the file was cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TILE = 4096  # bases of a sequence in one row


def sections(spark: SparkSession, path: str, head: Column) -> DataFrame:
    """file, section (from 1; 0 stands before the first head), block, at (order within the block), is_head and value of each line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = lines.withColumn("is_head", head)
    heads = lines.groupBy("file", "block").agg(F.count(F.when(F.col("is_head"), 1)).alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.count(F.when(F.col("is_head"), 1)).over(Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    numbered = lines.withColumn("within", within).join(heads.select("file", "block", above.alias("above")), ["file", "block"])
    return numbered.select("file", (F.col("above") + F.col("within")).alias("section"), "block", "at", "is_head", "value")


def _needed(found: Column, what: str) -> Column:
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit(f"no {what} in transcript block "), F.col("section").cast("string"), F.lit(" of "), F.col("file"))).cast("string")).otherwise(found)


def transcript_blocks(spark: SparkSession, path: str) -> DataFrame:
    """id, chr and exons (array of s and e, 1-based, closed) of blocks that begin with ---. Lines before the first one, a block without id, starts, ends or chr, and lists of unequal length are errors."""
    lines = sections(spark, path, F.col("value").startswith("---")).where(~F.col("is_head") & (F.length("value") > 0))
    take = lambda pattern: F.max(F.nullif(F.regexp_extract("value", pattern, 1), F.lit("")))
    b = lines.groupBy("file", "section").agg(take(r"^genes\[(\d+)\] =").alias("id"), take(r"^starts = ([\d,]+),$").alias("starts"), take(r"^ends = ([\d,]+),$").alias("ends"), take(r"^chr = (\w+)$").alias("chr"))
    first = F.when(F.col("section") == 0, F.raise_error(F.concat(F.lit("no block begins at the top of "), F.col("file"))).cast("string")).otherwise(_needed(F.col("id"), "id"))
    n = lambda c: F.transform(F.split(_needed(F.col(c), c), ","), lambda x: x.cast("int"))
    b = b.select("file", "section", first.cast("long").alias("id"), _needed(F.col("chr"), "chr").alias("chr"), n("starts").alias("a"), n("ends").alias("b"))
    uneven = F.raise_error(F.concat(F.lit("starts and ends differ in number in transcript "), F.col("id").cast("string"))).cast("array<struct<s:int,e:int>>")
    return b.select("id", "chr", F.when(F.size("a") != F.size("b"), uneven).otherwise(F.zip_with("a", "b", lambda s, e: F.struct((s + 1).alias("s"), e.alias("e")))).alias("exons"))


def short_introns(transcripts: DataFrame, most: int = 20) -> DataFrame:
    """Distinct chr, s1, e1, s2, e2 of neighbouring exons with at most `most` bases between them; none between them is an error."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("exons") - 1), lambda i: F.struct(F.get("exons", i - 1).alias("a"), F.get("exons", i).alias("b")))
    x = transcripts.where(F.size("exons") > 1).select("chr", F.inline(pairs)).select("chr", F.col("a.s").alias("s1"), F.col("a.e").alias("e1"), F.col("b.s").alias("s2"), F.col("b.e").alias("e2"))
    gap = F.col("s2") - F.col("e1") - 1
    bad = F.raise_error(F.concat(F.lit("an intron of "), gap.cast("string"), F.lit(" bases on "), F.col("chr"))).cast("int")
    return x.where(gap <= most).distinct().withColumn("s2", F.when(gap <= 0, bad).otherwise(F.col("s2")))


def simulated_indels(spark: SparkSession, path: str) -> DataFrame:
    """chr, s, e (the region), pos (bases of the region before the indel), size (signed, deletions are negative) and seq of tab-separated region, pos, size, seq."""
    t = spark.read.csv(path, sep="\t")
    part = lambda i: F.regexp_extract("_c0", r"^(\w+):(\d+)-(\d+)$", i)
    chr_ = F.when(part(1) == "", F.raise_error(F.concat(F.lit("no region: "), "_c0")).cast("string")).otherwise(part(1))
    return t.select(chr_.alias("chr"), part(2).try_cast("int").alias("s"), part(3).try_cast("int").alias("e"), F.col("_c1").cast("int").alias("pos"), F.col("_c2").cast("int").alias("size"), F.col("_c3").alias("seq"))


def fasta_tiles(spark: SparkSession, path: str, tile: int = TILE) -> DataFrame:
    """chr, tile and seq (upper case): the bases tile * `tile` + 1 and on of each sequence. No task holds a whole sequence; a name that stands twice is an error."""
    lines = sections(spark, path, F.col("value").startswith(">"))
    key = ["file", "section"]
    names = lines.where("is_head").select(*key, F.regexp_extract("value", r"^>\s*(\S+)", 1).alias("chr"))
    twice = F.count("*").over(Window.partitionBy("chr")) > 1
    names = names.withColumn("chr", F.when(twice, F.raise_error(F.concat(F.lit("two sequences are named "), "chr")).cast("string")).otherwise(F.col("chr")))
    body = lines.where("not is_head").withColumn("value", F.upper(F.trim("value"))).withColumn("n", F.length("value")).where("n > 0")
    parts = body.groupBy(*key, "block").agg(F.sum("n").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key, "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = body.withColumn("before", before).join(parts.select(*key, "block", above.alias("above")), [*key, "block"]).join(names, key)
    placed = placed.select("chr", (F.col("above") + F.col("before")).alias("p"), "n", "value")
    last = F.expr(f"(p + n - 1) div {tile}")
    pieces = placed.select("chr", "p", "value", F.explode(F.sequence(F.expr(f"p div {tile}"), last)).alias("tile"))
    first = F.greatest(F.col("p"), F.col("tile") * tile)
    piece = F.col("value").substr((first - F.col("p") + 1).cast("int"), ((F.col("tile") + 1) * tile - first).cast("int"))
    return pieces.groupBy("chr", "tile").agg(F.sort_array(F.collect_list(F.struct(first.alias("at"), piece.alias("seq")))).alias("x")).select("chr", "tile", F.array_join(F.transform("x", lambda s: s["seq"]), "").alias("seq"))
