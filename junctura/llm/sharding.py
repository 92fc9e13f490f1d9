"""Proportional stratified interleaving (operator 6).

Within each source the rows are shuffled by a seeded hash and ranked; row r of n takes the fraction
(2r - 1) / 2n. All rows sorted by that fraction and cut into equal runs give shards whose mixtures match
the whole. Counts per shard differ by one at most (law `rows`).

The hash is that of the text, so equal texts are a group: the rows of a group stand side by side in their source, and a
shard's bound is all that parts them. Groups of several sources have one hash and so nearly one fraction in each.

No rank is counted in one task: a source is cut into sections by the hash, whose counts, summed over the
sections before, give a section's first rank; the sort by fraction is cut likewise. A source with a third of
all rows so takes a third of the sections, and a group with more than 1 / HOT of all rows is cut into sections of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from junctura.llm.common import LOT, before, checkpoint

BUCKET_ROWS = 5_000  # rows aimed at in a bucket
HOT = 4096  # so many groups at most are cut, each with more than 1 / HOT of all rows; what tells them is broadcast


def assign(docs: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes and 8), text_crc32, law, shard, slot (from 0 in each shard) and grown_shard (null).

    One row for each row of docs. A null text has no bytes and is of the group of empty texts; rows without a source (or a table
    without that column) are a source of their own; a null doc_id stands before others of its group.
    Equal rows take places of their own in either order. With fewer rows than shards some shards stay empty. An empty table gives an empty result.
    """
    n = docs.count()
    buckets = max(64, -(-n // BUCKET_ROWS))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    source = docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    stratum = F.coalesce(F.concat(F.lit("="), source), F.lit("null"))
    rows = docs.select(docs["doc_id"].alias("doc_id"), source.alias("source"), stratum.alias("stratum"), F.xxhash64(F.lit(seed), text).alias("key"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    rows = checkpoint(rows)
    groups = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max(BUCKET_ROWS, n // HOT))
    hot = groups.select("key", (1 + HOT * (F.row_number().over(Window.orderBy("key")) - 1)).alias("own"))  # HOT rows at most
    rows = rows.join(F.broadcast(hot), "key", "left").withColumn("section", F.coalesce(F.col("own") + F.pmod(F.xxhash64("doc_id"), F.lit(HOT)), F.lit(0)))
    counts = rows.groupBy("stratum", "bucket", "section").agg(F.count("*").alias("here"))
    counts = before(counts, ["stratum"], F.struct("bucket", "section"), F.expr(f"bucket div {LOT}"))
    of = rows.groupBy("stratum").agg(F.count("*").alias("of"))
    within = Window.partitionBy("stratum", "bucket", "section").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = rows.join(counts, ["stratum", "bucket", "section"]).join(of, "stratum").withColumn("odd", 2 * (F.col("before") + F.row_number().over(within)) - 1)
    placed = checkpoint(ranked.select("doc_id", "source", "size", "text_crc32", "key", F.xxhash64("stratum").alias("tie"), "odd", "of", (F.col("odd") / (2 * F.col("of"))).alias("fraction"), F.expr(f"odd * {buckets}L div (2 * of)").alias("run")))
    starts = before(placed.groupBy("run").agg(F.count("*").alias("here")), [], F.col("run"), F.expr(f"run div {LOT}")).drop("here").withColumnRenamed("before", "start")
    in_run = Window.partitionBy("run").orderBy("fraction", "tie", "odd")
    at = placed.join(starts, "run").withColumn("at", F.col("start") + F.row_number().over(in_run) - 1)
    shard = F.expr(f"at * {shards}L div {max(n, 1)}L")
    return at.withColumn("shard", shard).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("at") - F.expr(f"(shard * {n}L + {shards - 1}L) div {shards}L")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
