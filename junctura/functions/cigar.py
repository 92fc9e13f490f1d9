"""Columns over CIGAR strings. All stay in the JVM and need no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY_OPS = ("M", "I", "S", "=", "X")
TARGET_OPS = ("M", "D", "N", "=", "X")


def is_valid(cigar: Column) -> Column:
    return cigar.rlike(r"^([0-9]+[MIDNSHP=X])+$")


def parse(cigar: Column) -> Column:
    """array<struct<l:int, op:string>>; empty for '*' and for anything that is not a CIGAR."""
    tokens = F.regexp_extract_all(F.when(is_valid(cigar), cigar).otherwise(F.lit("")), F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(tokens, lambda x: F.struct(F.regexp_extract(x, "^[0-9]+", 0).cast("int").alias("l"), F.right(x, F.lit(1)).alias("op")))


def _total(ops: Column, kinds: tuple[str, ...]) -> Column:
    return F.aggregate(ops, F.lit(0), lambda n, x: n + F.when(x["op"].isin(*kinds), x["l"]).otherwise(0))


def query_length(cigar: Column) -> Column:
    return _total(parse(cigar), QUERY_OPS)


def target_span(cigar: Column) -> Column:
    return _total(parse(cigar), TARGET_OPS)


def indel_bases(cigar: Column) -> Column:
    return _total(parse(cigar), ("I", "D"))


def checked_length(cigar: Column, bases: Column) -> Column:
    """The query length; an error where a sequence is given (not '*') and has another one."""
    n = query_length(cigar)
    wrong = F.coalesce((bases != "*") & (F.length(bases) != n), F.lit(False))
    return F.when(wrong, F.raise_error(F.concat(F.lit("a sequence does not fit its CIGAR "), cigar)).cast("int")).otherwise(n)


def read_n(cigar: Column, bases: Column) -> Column:
    """array<int>: where M operations read an N, counted in bases of the read after a leading soft clip."""
    steps = walk(cigar, F.lit(0))
    clip = F.coalesce(F.get(F.filter(steps, lambda x: (x["op"] == "S") & (x["q"] == 0)), F.lit(0))["l"], F.lit(0))
    is_n = lambda j: bases.substr(j + 1, F.lit(1)) == "N"
    of_step = lambda x: F.filter(F.sequence(x["q"], x["q"] + x["l"] - 1), is_n)
    found = F.flatten(F.transform(F.filter(steps, lambda x: (x["op"] == "M") & (x["l"] > 0)), of_step))
    return F.when(bases.contains("N"), F.transform(found, lambda j: j - clip)).otherwise(F.array().cast("array<int>"))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def walk(cigar: Column, pos: Column) -> Column:
    """array<struct<i, l, op, q, t, last>>: each operation with the query (0-based) and target position where it begins."""
    ops = parse(cigar)
    step = lambda x, kinds: F.when(x["op"].isin(*kinds), x["l"]).otherwise(0)
    kind = "array<struct<i:int,l:int,op:string,q:int,t:int>>"
    start = F.struct(F.lit(0).alias("q"), pos.cast("int").alias("t"), F.array().cast(kind).alias("out"))

    def add(s, x):
        one = F.struct(F.size(s["out"]).alias("i"), x["l"].alias("l"), x["op"].alias("op"), s["q"].alias("q"), s["t"].alias("t"))
        return F.struct((s["q"] + step(x, QUERY_OPS)).alias("q"), (s["t"] + step(x, TARGET_OPS)).alias("t"), F.concat(s["out"], F.array(one)).alias("out"))

    return F.aggregate(ops, start, add, lambda s: s["out"])
