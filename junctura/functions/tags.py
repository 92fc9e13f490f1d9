"""Columns over flags, optional tags, MD strings, qualities and read ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNMAPPED, REVERSE, MATE_1, MATE_2, SECONDARY = 4, 16, 64, 128, 256


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def mate(flag: Column) -> Column:
    return F.when(has(flag, MATE_1), 1).when(has(flag, MATE_2), 2)


def tag(tags: Column, name: str, kind: str = "string") -> Column:
    """The value of an optional field such as NM:i:3 in an array of fields; null if it is absent."""
    found = F.filter(tags, lambda x: x.startswith(name + ":"))
    return F.substring(F.get(found, F.lit(0)), len(name) + 4, 1 << 30).cast(kind)


def mirrored(q: Column, flag: Column, length: int) -> Column:
    """Position before an event, as the read was sequenced."""
    return F.when(has(flag, REVERSE), F.lit(length) - q - 2).otherwise(q)


def mean_quality(quality: Column, offset: int) -> Column:
    total = F.aggregate(F.split(quality, ""), F.lit(0), lambda n, x: n + F.when(x == "", 0).otherwise(F.ascii(x) - offset))
    return (total / F.nullif(F.length(quality), F.lit(0))).cast("int")


def mismatches(md: Column) -> Column:
    """array<struct<p:int, base:string>>: positions (0-based, in aligned bases) where MD names another reference base."""
    tokens = F.regexp_extract_all(md, F.lit(r"[0-9]+|\^[A-Za-z]+|[A-Za-z]"), F.lit(0))
    start = F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<p:int,base:string>>").alias("out"))

    def add(s, x):
        number, deleted = x.rlike("^[0-9]+$"), x.startswith("^")
        here = F.array(F.struct(s["p"].alias("p"), x.alias("base")))
        p = s["p"] + F.when(number, x.try_cast("int")).when(deleted, 0).otherwise(1)
        return F.struct(p.alias("p"), F.when(number | deleted, s["out"]).otherwise(F.concat(s["out"], here)).alias("out"))

    return F.aggregate(tokens, start, add, lambda s: s["out"])


def edits_without_n(nm: Column, indel_bases: Column, read_n: Column, reference_n: Column) -> Column:
    """Mismatches by NM without inserted and deleted bases and without positions where either side is N; at least 0."""
    only_read = F.size(F.array_except(read_n, reference_n))
    return F.greatest(nm - indel_bases - only_read - F.size(reference_n), F.lit(0))


def reference_n(md: Column) -> Column:
    """array<int>: positions (0-based, in aligned bases) where MD names an N of the reference; N in deletions do not count."""
    found = F.transform(F.filter(mismatches(md), lambda x: x["base"] == "N"), lambda x: x["p"])
    return F.when(md.contains("N"), found).otherwise(F.array().cast("array<int>"))


def lane(qname: Column) -> Column:
    """Run and lane, the first two fields of a read id such as RUN:3:...; another id is an error."""
    found = F.regexp_extract(qname, r"^(\w+:[0-9]+):", 1)
    return F.when(found == "", F.raise_error(F.concat(F.lit("no lane in read id "), qname)).cast("string")).otherwise(found)
