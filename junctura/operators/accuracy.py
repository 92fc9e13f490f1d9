"""True alignments against reported ones: bases, introns, indels, and introns of read pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.functions import cigar, tags
from junctura.operators import gaps


def coordinates(cigar_: Column, pos: Column) -> Column:
    """For each base of the read its doubled reference position; odd for inserted bases, null for clipped ones."""
    steps = F.filter(cigar.walk(cigar_, pos), lambda x: x["op"].isin(*cigar.QUERY_OPS))
    each = lambda x: F.transform(F.sequence(F.lit(0), x["l"] - 1), lambda k: F.when(x["op"] == "I", 2 * x["t"] - 1).when(x["op"] != "S", 2 * (x["t"] + k)))
    return F.flatten(F.transform(steps, each))


def paired(truth: DataFrame, report: DataFrame) -> DataFrame:
    """One row for each true read with the report on it; an absent report counts as unmapped."""
    r = report.select("frag", "mate", *[F.col(c).alias("r_" + c) for c in ("flag", "chr", "pos", "cigar")])
    return truth.join(r, ["frag", "mate"], "left").withColumn("r_flag", F.coalesce("r_flag", F.lit(4)))


def read_verdicts(both: DataFrame, length: int) -> DataFrame:
    """frag, mate, amb, spliced, aligned, base_right, base_wrong and verdict (perfect, partial, overlap, none)."""
    aligned = ~tags.has(F.col("r_flag"), tags.UNMAPPED)
    same = aligned & F.col("chr").eqNullSafe(F.col("r_chr")) & (tags.has(F.col("flag"), tags.REVERSE) == tags.has(F.col("r_flag"), tags.REVERSE))
    equal = same & (F.col("pos") == F.col("r_pos")) & (F.col("cigar") == F.col("r_cigar"))
    # bases are laid out only where the two may agree in part; of the rest their number is enough
    lay = lambda c, p: F.when(same & ~equal, coordinates(F.col(c), F.col(p))).otherwise(F.array().cast("array<int>"))
    t, r = lay("cigar", "pos"), lay("r_cigar", "r_pos")
    spliced = gaps.has_intron(F.col("cigar"))
    on_target = F.aggregate(F.when(aligned & ~equal, cigar.parse(F.col("r_cigar"))), F.lit(0), lambda n, o: n + F.when(o["op"].isin("M", "I", "=", "X"), o["l"]).otherwise(0))
    x = both.select("frag", "mate", "amb", spliced.alias("spliced"), aligned.alias("aligned"), same.alias("same"), equal.alias("equal"), t.alias("t"), r.alias("r"), F.coalesce(on_target, F.lit(0)).alias("placed"))
    right = F.when(F.col("equal"), length).when(F.col("same"), F.size(F.filter(F.arrays_zip("t", "r"), lambda v: v["t"] == v["r"]))).otherwise(0)
    x = x.withColumn("base_right", right).withColumn("base_wrong", F.when(F.col("equal"), 0).otherwise(F.col("placed") - right))
    verdict = F.when(F.col("base_right") == length, "perfect").when(F.col("base_right") > 0, "partial").when(F.col("same") & F.arrays_overlap(F.filter("t", lambda v: v.isNotNull()), F.filter("r", lambda v: v.isNotNull())), "overlap").otherwise("none")
    return x.select("frag", "mate", "amb", "spliced", "aligned", "base_right", "base_wrong", verdict.alias("verdict"))


def read_accuracy(verdicts: DataFrame) -> DataFrame:
    """The general table: a row for each of unique or ambiguous, contiguous or spliced, zeros included."""
    one = lambda c: F.count(F.when(c, 1))
    got = verdicts.groupBy("amb", "spliced").agg(
        F.sum("base_right").alias("bases_right"), F.sum("base_wrong").alias("bases_wrong"), one(F.col("aligned")).alias("aln"), one(F.col("verdict") == "overlap").alias("overlap"),
        one(F.col("verdict") == "partial").alias("some_right"), one(F.col("verdict") == "perfect").alias("perfect"), F.count("*").alias("total_reads"),
    )
    spine = verdicts.sparkSession.createDataFrame([(a, s) for a in (False, True) for s in (False, True)], "amb boolean, spliced boolean")
    return spine.join(F.broadcast(got), ["amb", "spliced"], "left").na.fill(0)  # four rows


_PLACE = "struct<amb:boolean,chr:string,flag:int,pos:int,cigar:string>"


def together(truth: DataFrame, report: DataFrame, needed: Column, every: bool = False) -> DataFrame:
    """frag and mates: for each mate of a fragment its true and its reported placement (t, r; null where it is not there, not mapped or not needed) and whether it is among the true reads.

    Both sides meet in one exchange, of needed rows only; with `every`, true reads without need come as their key. A read that is there twice on a side is an error.
    """
    place = F.struct("amb", "chr", F.col("flag").cast("int").alias("flag"), F.col("pos").cast("int").alias("pos"), "cigar").cast(_PLACE)
    needed = needed & ~tags.has(F.col("flag"), tags.UNMAPPED)
    side = lambda df, true: df.select("frag", "mate", F.lit(true).alias("true"), "amb", F.when(needed, place).alias("place"))
    t, r = side(truth, True), side(report, False).where("place is not null")
    rows = (t if every else t.where("place is not null")).union(r).repartition("frag")  # dealt first, so a fragment is sorted and summed up once
    several = F.raise_error(F.concat(F.lit("a read has several rows on a side in fragment "), F.col("frag").cast("string"))).cast(_PLACE)
    of = lambda m, true: (F.col("mate") == m) & (F.col("true") == F.lit(true))
    found = [F.count(F.when(of(m, true), 1)).alias(f"n_{name}{m}") for m in (1, 2) for name, true in (("t", True), ("r", False))]
    found += [F.first(F.when(of(m, true), F.col("place")), ignorenulls=True).alias(f"{name}{m}") for m in (1, 2) for name, true in (("t", True), ("r", False))]
    found += [F.first(F.when(of(m, True), F.col("amb")), ignorenulls=True).alias(f"amb{m}") for m in (1, 2)]

    def mate(m: int) -> Column:
        one = lambda name: F.when(F.col(f"n_{name}{m}") > 1, several).otherwise(F.col(f"{name}{m}")).alias(name)
        return F.struct(F.lit(m).alias("mate"), (F.col(f"n_t{m}") > 0).alias("seen"), F.col(f"amb{m}").alias("amb"), one("t"), one("r"))

    return rows.groupBy("frag").agg(*found).select("frag", F.array(mate(1), mate(2)).alias("mates"))


_INTRONS = "array<struct<start:int,len:int,q:int>>"


def _introns(p: Column) -> Column:
    """The internal gaps of more than gaps.INTRON bases of a placement, found in its row."""
    inner = lambda steps: F.filter(steps, lambda x: x["op"].isin("N", "D") & (x["l"] > gaps.INTRON) & (x["i"] > 0) & (x["i"] < F.size(steps) - 1))
    listed = F.transform(cigar.bound(cigar.walk(p["cigar"], p["pos"]), inner), lambda x: F.struct(x["t"].alias("start"), x["l"].alias("len"), x["q"].alias("q")))
    return F.coalesce(F.when(gaps.has_intron(p["cigar"]), listed), F.array().cast(_INTRONS))


def _read_introns(truth: DataFrame, report: DataFrame, every: bool = False) -> DataFrame:
    """frag and mates with ti and ri, the true and the reported introns of each read; equal placements are walked once."""
    x = together(truth, report, gaps.has_intron(F.col("cigar")), every)
    x = x.select("frag", F.transform("mates", lambda m: F.struct(*[m[c].alias(c) for c in ("mate", "seen", "amb", "t", "r")], _introns(m["t"]).alias("ti"))).alias("mates"))
    equal = lambda m: F.coalesce((m["t"]["pos"] == m["r"]["pos"]) & (m["t"]["cigar"] == m["r"]["cigar"]), F.lit(False))
    more = lambda m: F.struct(*[m[c].alias(c) for c in ("mate", "seen", "amb", "t", "r", "ti")], F.when(equal(m), m["ti"]).otherwise(_introns(m["r"])).alias("ri"))
    return x.select("frag", F.transform("mates", more).alias("mates"))


def _same_strand(t: Column, r: Column) -> Column:
    return F.coalesce((t["chr"] == r["chr"]) & (tags.has(t["flag"], tags.REVERSE) == tags.has(r["flag"], tags.REVERSE)), F.lit(False))


def _holds(introns: Column, x: Column) -> Column:
    return F.exists(introns, lambda y: (y["start"] == x["start"]) & (y["len"] == x["len"]))


def intron_events(truth: DataFrame, report: DataFrame, coverage: DataFrame, length: int, cap: int = 20, strict: bool = False) -> DataFrame:
    """event (tp, fn, fp), amb, p (position in the read, as sequenced) and coverage (capped; 0 if unknown) of every intron.

    Reads without introns are not shuffled; the others once, and their introns are matched in the row. strict: a true intron without coverage is an error.
    """
    reads = _read_introns(truth, report).select(F.inline("mates"))
    same, t, r = _same_strand(F.col("t"), F.col("r")), F.col("t"), F.col("r")
    one = lambda x, event, side: F.struct(event.alias("event"), side["amb"].alias("amb"), tags.mirrored(x["q"] - 1, side["flag"], length).alias("p"), side["chr"].alias("chr"), x["start"].alias("start"), x["len"].alias("len"))
    true = F.transform("ti", lambda x: one(x, F.when(same & _holds(F.col("ri"), x), "tp").otherwise("fn"), t))
    false = F.transform(F.filter("ri", lambda x: ~(same & _holds(F.col("ti"), x))), lambda x: one(x, F.lit("fp"), r))
    named = reads.select(F.inline(F.concat(true, false)))
    depth = coverage.select("chr", "start", "len", F.least("reads", F.lit(cap)).alias("coverage"))
    met = named.join(depth, ["chr", "start", "len"], "left")
    if strict:
        none = F.raise_error(F.concat(F.lit("no coverage for the true junction "), F.concat_ws(":", "chr", "start", "len"))).cast("bigint")
        met = met.withColumn("coverage", F.when((F.col("event") != "fp") & (F.coalesce("coverage", F.lit(0)) == 0), none).otherwise(F.col("coverage")))
    return met.select("event", "amb", "p", F.coalesce("coverage", F.lit(0)).alias("coverage"))


def _standing(x: DataFrame, *sides: str) -> DataFrame:
    """Rows that are alike but for where on which chromosome they stand are one, with their number as units: the placements `sides` of a row, relative to each other."""
    others = [c for c in x.columns if c not in sides]
    first, names = F.coalesce(*[F.col(c)["pos"] for c in sides]), F.array(*[F.col(c)["chr"] for c in sides])
    reverse = lambda c: F.when(tags.has(F.col(c)["flag"], tags.REVERSE), tags.REVERSE).otherwise(0)
    place = lambda c: F.struct(F.lit(False).alias("amb"), F.array_position(names, F.col(c)["chr"]).cast("string").alias("chr"), reverse(c).alias("flag"), (F.col(c)["pos"] - first).alias("pos"), F.col(c)["cigar"].alias("cigar"))
    alike = x.select(*others, *[F.when(F.col(c).isNotNull(), place(c)).alias(c) for c in sides])
    return alike.groupBy(*alike.columns).agg(F.count("*").alias("units"))


def multi_intron(truth: DataFrame, report: DataFrame, by: list[str], ambiguity: bool = False) -> DataFrame:
    """k and how many units (reads, or pairs with by=['frag']) have k true, k reported and k correct introns; with `ambiguity` apart for amb, of a pair whether a mate's is set.

    An intron of a read is correct on its strand only; the mates of a pair have two strands, so pairs go without. Units that are alike are walked once.
    """
    x = together(truth, report, gaps.has_intron(F.col("cigar")), every=True)
    if "mate" in by:
        per = _standing(x.select(F.inline("mates")).where("seen").select("amb", "t", "r"), "t", "r")
        per = per.select("amb", "units", "t", "r", _introns(F.col("t")).alias("ti"), _introns(F.col("r")).alias("ri"))
        correct = F.when(_same_strand(F.col("t"), F.col("r")), F.size(F.filter("ti", lambda i: _holds(F.col("ri"), i)))).otherwise(0)
        per = per.select("amb", "units", F.size("ti").alias("actual"), F.size("ri").alias("reported"), correct.alias("correct"))
    else:
        m = lambda k: F.col("mates")[k]
        amb = F.coalesce(m(0)["amb"], F.lit(False)) | F.coalesce(m(1)["amb"], F.lit(False))
        pairs = x.where(m(0)["seen"] | m(1)["seen"]).select(amb.alias("amb"), *[m(k)[side].alias(f"{side}{k}") for side in ("t", "r") for k in (0, 1)])
        pairs = _standing(pairs, "t0", "t1", "r0", "r1")
        named = lambda c: F.transform(_introns(F.col(c)), lambda i: F.struct(F.col(c)["chr"].alias("chr"), i["start"].alias("start"), i["len"].alias("len")))
        every = lambda side: F.array_distinct(F.concat(named(f"{side}0"), named(f"{side}1")))
        pairs = pairs.select("amb", "units", every("t").alias("ti"), every("r").alias("ri"))
        per = pairs.select("amb", "units", F.size("ti").alias("actual"), F.size("ri").alias("reported"), F.size(F.array_intersect("ti", "ri")).alias("correct"))
    apart = ["amb"] if ambiguity else []
    kinds = per.groupBy(*apart, "actual", "reported", "correct").agg(F.sum("units").alias("units"))  # few kinds, whatever the number of reads
    long = kinds.unpivot([*apart, "units"], ["actual", "reported", "correct"], "what", "k")
    one = lambda w: F.coalesce(F.sum(F.when(F.col("what") == w, F.col("units"))), F.lit(0)).alias(w)
    return long.groupBy(*apart, "k").agg(one("actual"), one("reported"), one("correct"))


_INDELS = "array<struct<op:string,q:int,t:int,l:int>>"


def _inner_indels(p: Column) -> Column:
    """The internal insertions and short gaps over the reference of a placement."""
    short = lambda x: (x["op"] == "I") | (x["op"].isin("D", "N") & (x["l"] <= gaps.INTRON))
    inner = lambda steps: F.filter(steps, lambda x: short(x) & (x["i"] > 0) & (x["i"] < F.size(steps) - 1))
    listed = F.transform(cigar.bound(cigar.walk(p["cigar"], p["pos"]), inner), lambda x: F.struct(F.when(x["op"] == "I", "I").otherwise("D").alias("op"), x["q"].alias("q"), x["t"].alias("t"), x["l"].alias("l")))
    return F.coalesce(listed, F.array().cast(_INDELS))


def indel_accuracy(truth: DataFrame, report: DataFrame, ambiguity: bool = False) -> DataFrame:
    """kind (D, I), size and the correct, missed and wrong internal indels, with `ambiguity` apart for amb; a match has equal place and size, one report for one truth.

    Reads without gaps are not shuffled, the others once; those that are alike are walked once.
    """
    reads = together(truth, report, F.col("cigar").rlike("[DIN]")).select(F.inline("mates")).select(F.coalesce(F.col("t.amb"), F.col("r.amb")).alias("amb"), "t", "r").where("t is not null or r is not null")
    reads = _standing(reads, "t", "r").select("amb", "units", "t", "r", _inner_indels(F.col("t")).alias("a"), _inner_indels(F.col("r")).alias("b"))
    same = F.coalesce(F.col("t.chr") == F.col("r.chr"), F.lit(False))
    event = lambda x, name: F.struct("amb", "units", x["op"].alias("kind"), x["l"].alias("size"), name.alias("event"))
    true = F.transform("a", lambda x: event(x, F.when(same & F.array_contains("b", x), "correct").otherwise("missed")))
    false = F.transform(F.filter("b", lambda x: ~(same & F.array_contains("a", x))), lambda x: event(x, F.lit("wrong")))
    one = lambda e: F.coalesce(F.sum(F.when(F.col("event") == e, F.col("units"))), F.lit(0)).alias(e)
    events = reads.select(F.inline_outer(F.concat(true, false))).where("event is not null")  # an inner generator would judge each read below the count
    return events.groupBy(*(["amb"] if ambiguity else []), "kind", "size").agg(one("correct"), one("missed"), one("wrong"))
