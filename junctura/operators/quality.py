"""Counts that tell whether alignments are sound, and their normal form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.functions import cigar, tags


def per_fragment(alignments: DataFrame) -> DataFrame:
    """frag, n1 and n2 (mapped alignments of each mate), pri1 and pri2 (primary ones among them)."""
    mapped = alignments.where(~tags.has(F.col("flag"), tags.UNMAPPED))
    primary = ~tags.has(F.col("flag"), tags.SECONDARY)
    one = lambda c: F.count(F.when(c, 1))
    n = [one(F.col("mate") == k).alias(f"n{k}") for k in (1, 2)]
    return mapped.groupBy("frag").agg(*n, *[one((F.col("mate") == k) & primary).alias(f"pri{k}") for k in (1, 2)])


def summary(alignments: DataFrame) -> DataFrame:
    """One row: alignments, spliced and unspliced, primaries beyond the first of a read, reads with secondary ones only, most alignments of a read."""
    mapped = alignments.where(~tags.has(F.col("flag"), tags.UNMAPPED))
    spliced = F.exists(cigar.parse(F.col("cigar")), lambda x: x["op"] == "N")
    kinds = mapped.agg(F.count("*").alias("alignments"), F.count(F.when(spliced, 1)).alias("spliced"), F.count(F.when(~spliced, 1)).alias("unspliced"))
    per = per_fragment(alignments)
    over = lambda k: F.greatest(F.col(f"pri{k}") - 1, F.lit(0))
    lone = lambda k: ((F.col(f"n{k}") > 0) & (F.col(f"pri{k}") == 0)).cast("long")
    reads = per.agg(F.sum(over(1) + over(2)).alias("more_primaries"), F.sum(lone(1) + lone(2)).alias("only_secondary"), F.max(F.greatest("n1", "n2")).alias("most"))
    return kinds.join(F.broadcast(reads))  # one row each


def hit_tags(alignments: DataFrame, fragments: DataFrame) -> DataFrame:
    """Normal form of alignments (frag, mate, seq, flag, chr, pos, cigar): of each read the last primary and the first secondary by seq.

    Every fragment of `fragments` has one row for each mate, or two (hi 1 and 2, ih 2) where a mate has a secondary one; what is absent is unmapped.
    """
    unmapped = F.struct((F.lit(64) * F.col("mate") + 5).cast("int").alias("flag"), F.lit("*").alias("chr"), F.lit(0).alias("pos"), F.lit("*").alias("cigar"))
    row = F.struct("flag", "chr", "pos", "cigar")
    second = tags.has(F.col("flag"), tags.SECONDARY)
    picked = alignments.groupBy("frag", "mate").agg(F.max_by(F.when(~second, row), F.when(~second, F.col("seq"))).alias("pri"), F.min_by(F.when(second, row), F.when(second, F.col("seq"))).alias("sec"))
    any_ = picked.groupBy("frag").agg(F.max(F.col("sec").isNotNull()).alias("two"))
    mates = fragments.select("frag").distinct().select("frag", F.explode(F.array(F.lit(1), F.lit(2))).alias("mate"))
    all_ = mates.join(picked, ["frag", "mate"], "left").join(any_, "frag", "left").withColumn("two", F.coalesce("two", F.lit(False)))
    hits = all_.select("frag", "mate", "two", "pri", "sec", F.explode(F.when(F.col("two"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("hi"))
    x = F.coalesce(F.when(F.col("hi") == 1, F.col("pri")).otherwise(F.col("sec")), unmapped)
    return hits.select("frag", "mate", "hi", F.when(F.col("two"), 2).otherwise(1).alias("ih"), x.alias("x")).select("frag", "mate", "hi", "ih", "x.*")


def mismatches_by_quality(alignments: DataFrame, qualities: DataFrame, offset: int = 33) -> DataFrame:
    """q (mean quality, null if the read is unknown), nm and reads, of the primary mapped alignments (frag, mate, flag, nm)."""
    main = alignments.where(~tags.has(F.col("flag"), tags.SECONDARY) & ~tags.has(F.col("flag"), tags.UNMAPPED))
    q = qualities.select("frag", "mate", tags.mean_quality(F.col("qual"), offset).alias("q"))
    return main.select("frag", "mate", "nm").join(q, ["frag", "mate"], "left").groupBy("q", "nm").agg(F.count("*").alias("reads"))


def quality_distribution(reads: DataFrame, offset: int = 33) -> DataFrame:
    """q (mean quality) and reads, from qual."""
    return reads.groupBy(tags.mean_quality(F.col("qual"), offset).alias("q")).agg(F.count("*").alias("reads"))


def mismatches_without_n(alignments: DataFrame) -> DataFrame:
    """alignments (cigar, bases, md, nm and others) with nm counted without inserted and deleted bases and without N on either side."""
    nm = tags.edits_without_n(F.col("nm"), cigar.indel_bases(F.col("cigar")), cigar.read_n(F.col("cigar"), F.col("bases")), tags.reference_n(F.col("md")))
    return alignments.withColumn("nm", nm)


def ambiguity(hits: DataFrame) -> DataFrame:
    """frag, mate, by_fragment (a mate of the fragment has a secondary row) and by_read (this one has), from rows of hit_tags."""
    own = (F.col("hi") == 2) & ~tags.has(F.col("flag"), tags.UNMAPPED)
    return hits.groupBy("frag", "mate").agg(F.max(F.col("ih") == 2).alias("by_fragment"), F.max(own).alias("by_read"))


def with_valid_ids(counts: DataFrame, valid: DataFrame, key: str, value: str) -> DataFrame:
    """key, valid and value: every valid id, 0 where it is absent, and the ids that are not valid."""
    known = valid.select(key).distinct().withColumn("valid", F.lit(True))
    return known.join(counts, key, "full").select(key, F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce(value, F.lit(0)).alias(value))


def lane_counts(fragments: DataFrame, alignments: DataFrame) -> DataFrame:
    """lane, total (fragments of it), mate1 and mate2 (fragments with that mate aligned); fragments: frag, lane."""
    met = fragments.join(per_fragment(alignments), "frag", "left")
    return met.groupBy("lane").agg(F.count("*").alias("total"), *[F.count(F.when(F.col(f"n{k}") > 0, 1)).alias(f"mate{k}") for k in (1, 2)])


def checks(alignments: DataFrame, known: DataFrame, length: int) -> DataFrame:
    """item and n: what a report of soundness lists. alignments: frag, flag, cigar, tags; known: the frags that were sequenced.

    A row counts as the first of unknown read, mate number error, not aligned, else as aligned. Whether a fragment has secondary
    alignments only is judged where mate 1 is aligned and has no primary one: for the mate, if mate 2 has a primary one, else for the fragment.
    Rows are counted by fragment on the map side before they meet the known reads.
    """
    bits = F.col("flag").bitwiseAND(F.lit(tags.MATE_1 | tags.MATE_2))
    mated = bits.isin(tags.MATE_1, tags.MATE_2)
    off = tags.has(F.col("flag"), tags.UNMAPPED)
    good = mated & ~off
    primary = good & ~tags.has(F.col("flag"), tags.SECONDARY)
    spliced, size = F.col("cigar").contains("N"), cigar.query_length(F.col("cigar"))
    stranded = F.exists("tags", lambda x: x.isin("XS:A:+", "XS:A:-"))
    first = bits == tags.MATE_1
    kinds = {
        "rows": F.lit(True), "unmated": ~mated, "off": mated & off, "n1": good & first, "n2": good & ~first, "p1": primary & first, "p2": primary & ~first, "short": good & (size < length), "long": good & (size > length),
        "spliced": good & spliced, "spliced_xs": good & spliced & stranded, "unspliced": good & ~spliced, "unspliced_xs": good & ~spliced & stranded,
    }
    per = alignments.groupBy("frag").agg(*[F.count(F.when(c, 1)).alias(k) for k, c in kinds.items()])
    met = per.join(known.select("frag").distinct().withColumn("is_known", F.lit(True)), "frag", "left")
    ok = F.col("is_known").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(ok, c)), F.lit(0)).cast("long")
    more = lambda k: F.greatest(F.col(k) - 1, F.lit(0))
    lone = (F.col("n1") > 0) & (F.col("p1") == 0)
    items = {
        "Unknown read ID": F.coalesce(F.sum(F.when(~ok, F.col("rows"))), F.lit(0)).cast("long"), "Mate number error": total(F.col("unmated")), "Non-alignment": total(F.col("off")), "Extra primary alignment": total(more("p1") + more("p2")),
        "Only secondary alignment for mate": total((lone & (F.col("p2") > 0)).cast("long")), "Only secondary alignment for fragment": total((lone & (F.col("p2") == 0)).cast("long")),
        "Max alignments for any read": F.coalesce(F.max(F.when(ok, F.greatest("n1", "n2"))), F.lit(0)).cast("long"), "Short sequence": total(F.col("short")), "Long sequence": total(F.col("long")),
        "Spliced": total(F.col("spliced")), "Spliced XS": total(F.col("spliced_xs")), "Unspliced": total(F.col("unspliced")), "Unspliced XS": total(F.col("unspliced_xs")),
    }
    one = met.agg(F.array(*[F.struct(F.lit(k).alias("item"), c.alias("n")) for k, c in items.items()]).alias("x"))
    return one.select(F.inline("x"))
