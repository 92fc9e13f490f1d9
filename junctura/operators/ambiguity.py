"""Scoring of indels and bases where a true indel could stand at several places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.functions import cigar
from junctura.operators import accuracy, gaps, placement

_GAP = "array<struct<i:int,q:int,t:int,l:int,ls:int,rs:int>>"
_WRONG = "array<struct<i:int,q:int,t:int,l:int>>"


def indels(alignments: DataFrame, keep: list[str], longest: int = gaps.INTRON) -> DataFrame:
    """keep, op (D, I), i, q, t, l and terminal of each indel; a longer gap over the reference is an intron, a shorter N a deletion. q is the base before a deletion, the first base of an insertion."""
    ops = gaps.operations(alignments.where(F.col("cigar").rlike("[DIN]")), keep)
    small = (F.col("op").isin("D", "N") & (F.col("l") <= longest)) | (F.col("op") == "I")
    ops = ops.where(small).withColumn("op", F.when(F.col("op") == "I", "I").otherwise("D"))
    terminal = (F.col("q") == 0) | (F.col("i") == F.col("n") - 1)
    return ops.select(*keep, "op", "i", (F.col("q") - (F.col("op") == "D").cast("int")).alias("q"), "t", "l", terminal.alias("terminal"))


def with_shifts(found: DataFrame, shifts: DataFrame, keep: list[str]) -> DataFrame:
    """Adds ls and rs, the largest known shifts to the left and right (0 if none is known), from shifts (chr, op, t, size, ls, rs).

    Sizes must be equal; an insertion at an end of its read may be a part of a longer one.
    """
    known = shifts.select("chr", "op", "t", "size", F.col("ls").alias("_ls"), F.col("rs").alias("_rs")).groupBy("chr", "op", "t", "size").agg(F.max("_ls").alias("_ls"), F.max("_rs").alias("_rs"))
    part = (F.col("op") == "I") & F.col("terminal") & (F.col("size") > F.col("l"))
    met = found.join(known, ["chr", "op", "t"], "left").withColumn("_fit", (F.col("size") == F.col("l")) | part)
    most = lambda c: F.coalesce(F.max(F.when(F.col("_fit"), F.col(c))), F.lit(0)).cast("int")
    return met.groupBy(*keep, "op", "i", "q", "t", "l").agg(most("_ls").alias("ls"), most("_rs").alias("rs"))


def _matched(true: Column, reported: Column) -> Column:
    """For each true indel, in order, the place of the first reported one of its size within its shifts that no earlier one took; -1 if none."""
    places = F.sequence(F.lit(0), F.size(reported) - 1)

    def near(a, b):
        return (a["l"] == b["l"]) & b["q"].between(a["q"] - a["ls"], a["q"] + a["rs"]) & b["t"].between(a["t"] - a["ls"], a["t"] + a["rs"])

    def take(taken, a):
        free = F.filter(places, lambda k: near(a, F.get(reported, k)) & ~F.array_contains(taken, k))
        return F.concat(taken, F.array(F.coalesce(F.get(free, F.lit(0)), F.lit(-1))))

    none = F.transform(true, lambda a: F.lit(-1))
    return F.when(F.size(reported) == 0, none).otherwise(F.aggregate(true, F.array().cast("array<int>"), take))


def indel_verdicts(truth: DataFrame, report: DataFrame, shifts: DataFrame, length: int) -> DataFrame:
    """kind, size and the correct, missed and wrong indels, one reported for one true. Indels that may touch an end of the read don't count,
    but a report that meets one isn't wrong. A report on another chromosome or strand meets nothing."""
    key = ["frag", "mate"]
    side = [*key, "chr", "flag"]
    t = with_shifts(indels(truth, side), shifts, side)
    packed = lambda x, *c: F.sort_array(F.collect_list(F.struct("i", "q", "t", "l", *c)))  # noqa: E731  the indels of one read
    strand = lambda f: F.col(f).bitwiseAND(F.lit(16))
    t = t.groupBy(*side, "op").agg(packed(t, "ls", "rs").alias("a"))
    r = indels(report, side)
    r = r.groupBy(*key, F.col("chr").alias("r_chr"), F.col("flag").alias("r_flag"), "op").agg(packed(r).alias("b"))
    both = t.join(r, [*key, "op"], "full").withColumns({"a": F.coalesce("a", F.array().cast(_GAP)), "b": F.coalesce("b", F.array().cast(_WRONG))})
    same = F.coalesce((F.col("chr") == F.col("r_chr")) & (strand("flag") == strand("r_flag")), F.lit(False))
    both = both.withColumn("hit", F.when(same, _matched(F.col("a"), F.col("b"))).otherwise(F.transform("a", lambda x: F.lit(-1))))
    deletion = F.col("op") == "D"
    inner = lambda x: F.when(deletion, (x["q"] - x["ls"] >= 0) & (x["q"] + x["rs"] < length - 1)).otherwise((x["q"] - x["ls"] > 0) & (x["q"] + x["rs"] + x["l"] < length))
    apart = lambda x: F.when(deletion, (x["q"] != -1) & (x["q"] != length - 1)).otherwise((x["q"] > 0) & (x["q"] + x["l"] < length))
    event = lambda size, name: F.struct(size.alias("size"), name.alias("event"))
    true = F.transform(F.filter(F.zip_with("a", "hit", lambda x, h: F.struct(x.alias("x"), h.alias("h"))), lambda z: inner(z["x"])), lambda z: event(z["x"]["l"], F.when(z["h"] >= 0, "correct").otherwise("missed")))
    rest = F.filter("b", lambda x, k: ~F.array_contains("hit", k) & apart(x))
    each = both.select(F.col("op").alias("kind"), F.inline(F.concat(true, F.transform(rest, lambda x: event(x["l"], F.lit("wrong"))))))
    return each.groupBy("kind", "size").agg(*[F.count(F.when(F.col("event") == e, 1)).alias(e) for e in ("correct", "missed", "wrong")])


def alternatives(j: Column, gap: Column) -> Column:
    """The doubled reference positions that base j (0-based) may have besides its own, by one indel (op, q, t, l, ls, rs)."""
    q, t, n, ls, rs = (gap[c] for c in ("q", "t", "l", "ls", "rs"))
    at = lambda ok, x: F.when(ok, F.array(x.cast("int"))).otherwise(F.array().cast("array<int>"))
    deleted = F.concat(at((j > q - ls) & (j <= q), 2 * (t + n - 1 - q + j)), at((j > q) & (j <= q + rs), 2 * (t - 1 + j - q)))
    each = lambda most, f: F.flatten(F.transform(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), f))
    left = each(ls, lambda i: F.concat(at(j == q - i + n, 2 * (t - i)), at((j >= q - i) & (j < q - i + n), 2 * (t - i) - 1)))
    right = each(rs, lambda i: F.concat(at(j == q - 1 + i, 2 * (t - 1 + i)), at((j > q - 1 + i) & (j <= q - 1 + i + n), 2 * (t - 1 + i) + 1)))
    return F.when(gap["op"] == "D", deleted).otherwise(F.concat(left, right))


def right_bases(truth: DataFrame, report: DataFrame, shifts: DataFrame) -> DataFrame:
    """frag, mate and right: bases that a report on the right chromosome and strand puts where they may be. A read is there once on each side."""
    return _right(_comparable(truth, report).select("frag", "mate", "chr", "pos", "cigar", "r_pos", "r_cigar"), shifts, ["frag", "mate"])


def counted_right_bases(truth: DataFrame, report: DataFrame, shifts: DataFrame) -> DataFrame:
    """The same with reads, their number, in place of frag and mate: reads that are placed alike are judged once."""
    alike = _comparable(truth, report).groupBy("chr", "pos", "cigar", "r_pos", "r_cigar").agg(F.count("*").alias("reads"))
    return _right(alike, shifts, ["reads"])


def _comparable(truth: DataFrame, report: DataFrame) -> DataFrame:
    same = (F.col("r_flag").bitwiseAND(F.lit(4)) == 0) & (F.col("chr") == F.col("r_chr")) & (F.col("flag").bitwiseAND(F.lit(16)) == F.col("r_flag").bitwiseAND(F.lit(16)))
    return accuracy.paired(truth, report).where(same)


def _right(x: DataFrame, shifts: DataFrame, keep: list[str]) -> DataFrame:
    """keep and right, for rows that are told by keep, chr and both placements."""
    read = F.struct(*x.columns).alias("read")
    movable = F.col("cigar").rlike("[DIN]")
    x = x.select("chr", read, F.coalesce(F.when(movable, placement.listed_indels(F.col("cigar"), F.col("pos"))), F.array().cast(placement._INDELS)).alias("indels"))
    x = placement.with_gaps(x, shifts, counted="reads" in keep).select("read.*", "gaps")
    bases = F.aggregate(cigar.parse(F.col("cigar")), F.lit(0), lambda n, o: n + F.when(o["op"].isin(*cigar.QUERY_OPS), o["l"]).otherwise(0))
    x = x.select("*", placement.runs(F.col("r_cigar"), F.col("r_pos")).alias("reported"), bases.alias("_bases"))
    allowed = F.concat(placement.runs(F.col("cigar"), F.col("pos")), F.flatten(F.transform("gaps", lambda g: placement.moved_runs(g, F.col("_bases")))))
    return x.withColumn("allowed", allowed).select(*keep, placement.agreeing(F.col("allowed"), F.col("reported")).alias("right"))
