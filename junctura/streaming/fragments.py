"""Fragments completed over a stream: the rows of both mates, which may arrive in different batches, become their normal form once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from junctura.functions import tags

_PLACE = "struct<flag:int,chr:string,pos:int,cigar:string>"


def _hits(rows: Column) -> Column:
    """The rows of quality.hit_tags from all rows (mate, seq, flag, chr, pos, cigar) of one fragment."""
    secondary = lambda r: tags.has(r["flag"], tags.SECONDARY)
    place = lambda r: F.struct(*[r[c].alias(c) for c in ("flag", "chr", "pos", "cigar")]).cast(_PLACE)

    def mate(m: int) -> Column:
        keyed = lambda keep: F.transform(F.filter(rows, lambda r: (r["mate"] == m) & keep(r)), lambda r: F.struct(r["seq"].alias("seq"), place(r).alias("x")))
        first, last = F.array_max(keyed(lambda r: ~secondary(r)))["x"], F.array_min(keyed(secondary))["x"]
        return F.struct(F.lit(m).alias("mate"), first.alias("pri"), last.alias("sec"), F.lit(64 * m + 5).alias("none"))

    def out(mates: Column) -> Column:
        two = F.exists(mates, lambda m: m["sec"].isNotNull())
        ih = F.when(two, 2).otherwise(1)
        row = lambda m, hi, x: F.struct(m["mate"].alias("mate"), F.lit(hi).alias("hi"), ih.alias("ih"), F.coalesce(x, F.struct(m["none"].alias("flag"), F.lit("*").alias("chr"), F.lit(0).alias("pos"), F.lit("*").alias("cigar")).cast(_PLACE)).alias("x"))
        ones, twos = F.transform(mates, lambda m: row(m, 1, m["pri"])), F.transform(mates, lambda m: row(m, 2, m["sec"]))
        return F.when(two, F.concat(ones, twos)).otherwise(ones)

    return F.get(F.transform(F.array(F.array(mate(1), mate(2))), out), F.lit(0))


def completed(arrivals: DataFrame, gap: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """frag, mate, hi, ih, flag, chr, pos and cigar, as quality.hit_tags has them, of a stream of frag, mate, seq, flag, chr, pos, cigar and ts. Write it in append mode.

    A fragment is complete when none of its rows has come for `gap`, by the rows' times; it is written when the stream is `late` past that, and its state is dropped.
    A row that comes later than this is left out and counted by `left_out`; one that comes after a gap without being late begins the fragment anew.
    State is the rows of open fragments, in the state store of the JVM.
    """
    rows = F.collect_list(F.struct("mate", "seq", "flag", "chr", "pos", "cigar"))
    open_ = arrivals.withWatermark("ts", late).groupBy("frag", F.session_window("ts", gap)).agg(rows.alias("rows"))
    return open_.select("frag", F.inline(_hits(F.col("rows")))).select("frag", "mate", "hi", "ih", "x.*")


def left_out(query: StreamingQuery) -> int:
    """How many rows of a stream came too late, by the progress that it still holds."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
