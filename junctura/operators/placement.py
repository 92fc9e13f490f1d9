"""Where the bases of a read lie, as runs: scoring of placements without laying out bases.

A run is q (its first base in the read), l (bases), moving and d. The bases of a moving run follow the reference: base j lies at d + j. Those of a
standing run were inserted and lie between the same two bases of the reference: d is the one after them. Two placements agree on the bases
where runs of the same kind and d overlap. An indel that can be moved adds a few runs to those of the true placement, whatever the read's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.functions import cigar, tags
from junctura.operators import gaps

_RUN = "struct<q:int,l:int,moving:boolean,d:int>"
_SPAN = "struct<s:int,e:int>"
_INDELS = "array<struct<op:string,q:int,t:int,l:int,terminal:boolean>>"
_GAPS = "array<struct<op:string,q:int,t:int,l:int,ls:int,rs:int>>"


def _run(q: Column, end: Column, moving: bool, d: Column, length: int | Column) -> Column:
    """The run of the bases q to end (end excluded), as far as they are in the read."""
    first = F.greatest(q, F.lit(0))
    return F.struct(first.cast("int").alias("q"), (F.least(end, F.lit(length)) - first).cast("int").alias("l"), F.lit(moving).alias("moving"), d.cast("int").alias("d"))


def runs(cigar_: Column, pos: Column) -> Column:
    """The runs of a placement; clipped bases lie nowhere."""
    steps = F.filter(cigar.walk(cigar_, pos), lambda x: x["op"].isin("M", "I", "=", "X") & (x["l"] > 0))
    moving = lambda x: x["op"] != "I"
    return F.transform(steps, lambda x: F.struct(x["q"].alias("q"), x["l"].alias("l"), moving(x).alias("moving"), F.when(moving(x), x["t"] - x["q"]).otherwise(x["t"]).alias("d")))


def moved_runs(gap: Column, length: int | Column) -> Column:
    """The runs that the moves of one indel (op, q, t, l, ls, rs) add; q as in operators.ambiguity."""
    q, t, n, ls, rs = (gap[c] for c in ("q", "t", "l", "ls", "rs"))
    deleted = F.array(_run(q - ls + 1, q + 1, True, t + n - q - 1, length), _run(q + 1, q + rs + 1, True, t - q - 1, length))
    by = lambda most, f: F.transform(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), f)
    left = F.concat(F.array(_run(q - ls + n, q + n, True, t - q - n, length)), by(ls, lambda i: _run(q - i, q - i + n, False, t - i, length)))
    right = F.concat(F.array(_run(q, q + rs, True, t - q, length)), by(rs, lambda i: _run(q + i, q + i + n, False, t + i, length)))
    every = F.when(gap["op"] == "D", deleted).otherwise(F.concat(left, right))
    return F.filter(every, lambda r: r["l"] > 0)


def _covered(spans: Column) -> Column:
    """How many bases the union of spans (s, e; e excluded) covers."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))

    def add(a, x):
        more = F.greatest(x["e"] - F.greatest(x["s"], a["end"]), F.lit(0))
        return F.struct((a["n"] + more).alias("n"), F.greatest(a["end"], x["e"]).alias("end"))

    return F.aggregate(F.array_sort(spans), start, add, lambda a: a["n"])


def agreeing(allowed: Column, reported: Column) -> Column:
    """How many bases of the reported runs lie where one of the allowed runs puts them."""

    def of_run(n, r):
        same = F.filter(allowed, lambda a: (a["moving"] == r["moving"]) & (a["d"] == r["d"]) & (a["q"] < r["q"] + r["l"]) & (r["q"] < a["q"] + a["l"]))
        spans = F.transform(same, lambda a: F.struct(F.greatest(a["q"], r["q"]).alias("s"), F.least(a["q"] + a["l"], r["q"] + r["l"]).alias("e")).cast(_SPAN))
        return n + _covered(spans)

    return F.aggregate(reported, F.lit(0), of_run)


def touching(allowed: Column, reported: Column) -> Column:
    """Whether some place of the reference (or between two bases of it) has bases of both, whichever bases they are."""
    at = lambda r: F.when(r["moving"], r["d"] + r["q"]).otherwise(r["d"])
    end = lambda r: F.when(r["moving"], r["d"] + r["q"] + r["l"]).otherwise(r["d"] + 1)
    meets = lambda a, r: (a["moving"] == r["moving"]) & (at(a) < end(r)) & (at(r) < end(a))
    return F.exists(reported, lambda r: F.exists(allowed, lambda a: meets(a, r)))


def met(truth: DataFrame, report: DataFrame, extra: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> DataFrame:
    """One row for each true read with its report (r_ columns); a read without one is unmapped. A read that is there twice on a side is an error.
    Reads that truly lie on a chromosome of `without` (such as that of mitochondria) are left out, wherever they are reported.

    Counting the rows of a read needs the order and the partitions that the join needs, so it costs no shuffle.
    """
    key = ["frag", "mate"]

    def single(df: DataFrame, columns: list[str], what: str) -> DataFrame:
        one = df.repartition(*key).groupBy(*key).agg(*[F.first(c).alias(c) for c in columns], F.count("*").alias("_n"))
        clash = F.raise_error(F.concat(F.lit(f"a read has several {what} rows: "), F.col("frag").cast("string"), F.lit("/"), F.col("mate").cast("string")))
        return one.withColumn(columns[0], F.when(F.col("_n") > 1, clash.cast(dict(df.dtypes)[columns[0]])).otherwise(F.col(columns[0]))).drop("_n")

    place = ["flag", "chr", "pos", "cigar"]
    t = single(truth.where(~F.col("chr").isin(*without)) if without else truth, [*place, *[c for c in ("amb", *extra) if c in truth.columns]], "true")
    r = single(report, place, "reported").select(*key, *[F.col(c).alias("r_" + c) for c in place])
    return t.join(r, key, "left").withColumn("r_flag", F.coalesce("r_flag", F.lit(tags.UNMAPPED)))


def verdicts(both: DataFrame, shifts: DataFrame, length: int) -> DataFrame:
    """frag, mate, amb, spliced, aligned, base_right, base_wrong and verdict (perfect, partial, overlap, none) of rows of `met`, with known shifts
    of true indels (chr, op, t, size, ls, rs).

    Equal placements count all `length` bases as right, clipped ones too. Only reads that differ from the truth and have an indel there meet the shifts.
    """
    return _verdicts(_compared(both), shifts, length, ["frag", "mate", "amb"])


def counted_verdicts(both: DataFrame, shifts: DataFrame, length: int) -> DataFrame:
    """The verdicts with reads, their number, in place of frag and mate, and with the true cigar. Reads whose placements are alike are judged once.

    Where a read stands tells only if it meets the shifts; of the others only the two placements relative to each other are looked at.
    """
    x = _compared(both)
    meets = F.col("same") & ~F.col("equal") & F.col("cigar").rlike("[IDN]")
    at = F.when(meets, F.col("pos")).otherwise(0)
    moved = F.when(F.col("same"), F.col("r_pos") - F.col("pos") + at).otherwise(0)
    alike = x.select("amb", "aligned", "same", "equal", F.when(meets, F.col("chr")).alias("chr"), at.alias("pos"), "cigar", moved.alias("r_pos"), "r_cigar")
    alike = alike.groupBy(*alike.columns).agg(F.count("*").alias("reads"))
    return _verdicts(alike, shifts, length, ["amb", "cigar", "reads"])


def _compared(both: DataFrame) -> DataFrame:
    aligned = ~tags.has(F.col("r_flag"), tags.UNMAPPED)
    same = F.coalesce(aligned & (F.col("chr") == F.col("r_chr")) & (tags.has(F.col("flag"), tags.REVERSE) == tags.has(F.col("r_flag"), tags.REVERSE)), F.lit(False))
    return both.withColumns({"aligned": aligned, "same": same}).withColumn("equal", F.col("same") & (F.col("pos") == F.col("r_pos")) & (F.col("cigar") == F.col("r_cigar")))


def _verdicts(x: DataFrame, shifts: DataFrame, length: int, keep: list[str]) -> DataFrame:
    movable = F.when(F.col("same") & ~F.col("equal") & F.col("cigar").rlike("[IDN]"), listed_indels(F.col("cigar"), F.col("pos")))
    read = F.struct(*keep, *[c for c in ("cigar", "pos", "r_cigar", "r_pos", "aligned", "same", "equal") if c not in keep])
    x = x.select("chr", read.alias("read"), F.coalesce(movable, F.array().cast(_INDELS)).alias("indels"))
    return _scored(with_gaps(x, shifts, counted="reads" in keep).select("read.*", "gaps"), length, keep)


def with_gaps(x: DataFrame, shifts: DataFrame, counted: bool) -> DataFrame:
    """read and gaps of rows of chr, read and indels. Of single reads only those with indels meet the shifts; of counted ones, which are few,
    all do: a condition on what comes out of the count would be tried on each read before it, and the count be taken twice."""
    if counted:
        return with_shifts(x, shifts)
    still = x.where(F.size("indels") == 0).select("read", F.array().cast(_GAPS).alias("gaps"))
    return still.union(with_shifts(x.where(F.size("indels") > 0), shifts))


def listed_indels(cigar_: Column, pos: Column) -> Column:
    """The insertions and short gaps over the reference of a placement; q is the base before a deletion, the first base of an insertion."""
    deleted = lambda x: x["op"] != "I"
    small = lambda x: (x["op"] == "I") | (x["op"].isin("D", "N") & (x["l"] <= gaps.INTRON))

    def listed(steps: Column) -> Column:
        one = lambda x: F.struct(F.when(deleted(x), "D").otherwise("I").alias("op"), (x["q"] - deleted(x).cast("int")).alias("q"), x["t"].alias("t"), x["l"].alias("l"), ((x["q"] == 0) | (x["i"] == F.size(steps) - 1)).alias("terminal"))
        return F.transform(F.filter(steps, small), one)

    return cigar.bound(cigar.walk(cigar_, pos), listed)


def with_shifts(reads: DataFrame, shifts: DataFrame) -> DataFrame:
    """read and gaps, its indels with the largest shifts known for each (0 if none is); an insertion at an end of its read may be a part of a larger one."""
    s = shifts.groupBy("chr", "op", "t", "size").agg(F.max("ls").alias("_ls"), F.max("rs").alias("_rs"))
    found = reads.select("chr", "read", F.posexplode_outer("indels").alias("k", "x")).select("chr", "read", "k", "x.*").join(s, ["chr", "op", "t"], "left").repartition("chr", "read")
    fits = (F.col("size") == F.col("l")) | ((F.col("op") == "I") & F.col("terminal") & (F.col("size") > F.col("l")))
    most = lambda c: F.coalesce(F.max(F.when(fits, F.col(c))), F.lit(0)).cast("int").alias(c[1:])
    each = found.groupBy("chr", "read", "k", "op", "q", "t", "l").agg(most("_ls"), most("_rs"))
    return each.groupBy("chr", "read").agg(F.collect_list(F.when(F.col("op").isNotNull(), F.struct("op", "q", "t", "l", "ls", "rs"))).alias("gaps")).select("read", "gaps")


def _scored(x: DataFrame, length: int, keep: list[str]) -> DataFrame:
    differs = F.col("same") & ~F.col("equal")
    empty = F.array().cast(f"array<{_RUN}>")
    own = F.concat(runs(F.col("cigar"), F.col("pos")), F.flatten(F.transform("gaps", lambda g: moved_runs(g, length))))
    x = x.withColumn("allowed", F.when(differs, own).otherwise(empty)).withColumn("reported", F.when(F.col("aligned") & ~F.col("equal"), runs(F.col("r_cigar"), F.col("r_pos"))).otherwise(empty))
    placed = F.aggregate("reported", F.lit(0), lambda n, r: n + r["l"])
    x = x.withColumns({"placed": placed, "right": F.when(F.col("equal"), length).when(F.col("same"), agreeing(F.col("allowed"), F.col("reported"))).otherwise(0)})
    wrong = F.when(F.col("equal"), 0).otherwise(F.col("placed") - F.col("right"))
    verdict = F.when(F.col("right") == length, "perfect").when(F.col("right") > 0, "partial").when(differs & touching(F.col("allowed"), F.col("reported")), "overlap").otherwise("none")
    return x.select(*keep, gaps.has_intron(F.col("cigar")).alias("spliced"), "aligned", F.col("right").alias("base_right"), wrong.alias("base_wrong"), verdict.alias("verdict"))


def general_table(judged: DataFrame, length: int) -> DataFrame:
    """cat (uni_contig, uni_spliced, amb_contig, amb_spliced), bases_right, bases_wrong, aln, overlap, some_right, perfect, total_reads and total_bases; a row for each cat. judged may have `reads`, their number."""
    n = F.col("reads") if "reads" in judged.columns else F.lit(1)
    one = lambda c: F.sum(F.when(c, n).otherwise(0))
    cat = F.concat(F.when(F.col("amb"), "amb").otherwise("uni"), F.when(F.col("spliced"), "_spliced").otherwise("_contig"))
    got = judged.groupBy(cat.alias("cat")).agg(
        F.sum(F.col("base_right") * n).alias("bases_right"), F.sum(F.col("base_wrong") * n).alias("bases_wrong"), one(F.col("aligned")).alias("aln"), one(F.col("verdict") == "overlap").alias("overlap"),
        one(F.col("verdict") == "partial").alias("some_right"), one(F.col("verdict") == "perfect").alias("perfect"), F.sum(n).cast("long").alias("total_reads"),
    )
    spine = judged.sparkSession.createDataFrame([(f"{a}_{s}",) for a in ("uni", "amb") for s in ("contig", "spliced")], "cat string")
    return spine.join(got, "cat", "left").na.fill(0).withColumn("total_bases", F.col("total_reads") * length)
