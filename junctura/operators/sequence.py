"""Slices of reference sequences that are stored in tiles, and how far indels can move in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.functions import shift
from junctura.operators.durable import checkpoint
from junctura.sources.sections import TILE

WINDOW, WIDEST = 64, 4096  # bases that the first round looks at; each further round looks at four times as many, up to the widest


def slices(asked: DataFrame, tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """asked (chr, s, e, 1-based and closed, and others) with seq, the bases from s to e; shorter where the sequence ends, empty if e is before s or chr is unknown.

    An equi-join on (chr, tile): a slice meets the tiles that it touches, two if it is shorter than a tile, and is put together from their pieces.
    Equal requests are looked up once.
    """
    key = ["chr", "s", "e"]
    span = F.sequence(F.expr(f"CAST((s - 1) div {tile} AS BIGINT)"), F.expr(f"CAST((e - 1) div {tile} AS BIGINT)"))
    wanted = asked.where("s <= e and s > 0").select(*key).distinct().select(*key, F.explode(span).alias("tile"))
    first = F.greatest(F.col("s") - 1, F.col("tile") * tile)
    piece = F.col("seq").substr((first - F.col("tile") * tile + 1).cast("int"), (F.least(F.col("e").cast("long"), (F.col("tile") + 1) * tile) - first).cast("int"))
    found = wanted.join(tiles, ["chr", "tile"]).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("tile", piece.alias("seq")))).alias("x"))
    return asked.join(found, key, "left").withColumn("seq", F.coalesce(F.array_join(F.transform("x", lambda p: p["seq"]), ""), F.lit(""))).drop("x")


def _turned(event: Column, by: Column) -> Column:
    """A cyclic sequence that begins `by` bases later."""
    k = by % F.length(event)
    return F.concat(event.substr(k + 1, F.length(event)), event.substr(F.lit(1), k))


def _extended(events: DataFrame, tiles: DataFrame, tile: int) -> DataFrame:
    """id and n, how many bases of the reference repeat the event: to the right from `at` up to `bound`, or to the left (down) from `at` down to `bound`.

    Each round looks at one more window; only events whose window repeats to its end ask for another one.
    """
    active, done, window = events.withColumn("n", F.lit(0)), None, WINDOW
    while True:
        reach = F.least(F.lit(window), F.when(F.col("down"), F.col("at") - F.col("bound") + 1).otherwise(F.col("bound") - F.col("at") + 1))
        w = active.withColumn("reach", F.greatest(reach, F.lit(0)))
        w = w.withColumn("s", F.when(F.col("down"), F.col("at") - F.col("reach") + 1).otherwise(F.col("at"))).withColumn("e", F.when(F.col("down"), F.col("at")).otherwise(F.col("at") + F.col("reach") - 1))
        w = slices(w, tiles, tile)
        here = F.when(F.col("down"), F.reverse("seq")).otherwise(F.col("seq"))
        extent = F.when(F.col("reach") > 0, shift.right_shift(here, _turned(F.col("event"), F.col("n")))).otherwise(0)
        w = checkpoint(w.withColumn("extent", extent).withColumn("seen", F.length("seq")).drop("seq"))
        more = (F.col("extent") == F.col("reach")) & (F.col("seen") == F.col("reach")) & (F.col("reach") == window)
        ended = w.where(~more).select("id", "down", (F.col("n") + F.col("extent")).alias("n"))
        done = ended if done is None else done.union(ended)
        step = F.when(F.col("down"), -F.col("reach")).otherwise(F.col("reach"))
        active = w.where(more).withColumns({"n": F.col("n") + F.col("reach"), "at": F.col("at") + step}).select(*events.columns, "n")
        if active.isEmpty():
            return done
        window = min(4 * window, WIDEST)


def indel_shifts(indels: DataFrame, tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """chr, op, t, size, ls and rs of indels (chr, s, e, pos, size, seq): the region s to e, the bases of it before the indel, the signed size and the inserted or
    deleted bases (null in a deletion: those of the reference). How far each can move to the left and right within its region.

    A deletion that differs from the reference, or bases that do not fit the size, are errors. Equal indels in different regions are followed once,
    as far as the widest of their regions reaches; each region then bounds its own.
    """
    key = ["chr", "op", "t", "size", "given"]
    x = indels.select("chr", F.greatest("s", F.lit(1)).alias("low"), F.col("e").alias("high"), (F.col("s") + F.col("pos")).alias("t"), F.abs("size").alias("size"), F.when(F.col("size") < 0, "D").otherwise("I").alias("op"), F.upper("seq").alias("given"))
    after = F.col("t") + F.when(F.col("op") == "D", F.col("size")).otherwise(0)
    k = x.groupBy(*key).agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumn("s", F.col("t")).withColumn("e", after - 1)
    k = slices(k, tiles, tile)
    at = F.concat(F.lit(" at "), F.col("chr"), F.lit(":"), F.col("t").cast("string"))
    event = F.when(F.col("op") == "D", F.col("seq")).otherwise(F.col("given"))
    differs = (F.col("op") == "D") & F.col("given").isNotNull() & (F.col("given") != F.col("seq"))
    unfit = F.coalesce(F.length(event), F.lit(-1)) != F.col("size")
    event = F.when(unfit, F.raise_error(F.concat(F.lit("the bases of an indel do not fit its size"), at)).cast("string")).when(differs, F.raise_error(F.concat(F.lit("a deletion differs from the reference"), at)).cast("string")).otherwise(event)
    k = checkpoint(k.withColumn("event", event).withColumn("id", F.monotonically_increasing_id()).select("id", *key, "low", "high", "event"))
    right = k.select("id", "chr", F.lit(False).alias("down"), after.alias("at"), F.col("high").alias("bound"), "event")
    left = k.select("id", "chr", F.lit(True).alias("down"), (F.col("t") - 1).alias("at"), F.col("low").alias("bound"), F.reverse("event").alias("event"))
    n = _extended(right.union(left), tiles, tile)
    side = lambda down, name: F.max(F.when(F.col("down") == down, F.col("n"))).alias(name)
    far = k.join(n.groupBy("id").agg(side(True, "ls"), side(False, "rs")), "id").select(*[F.col(c).alias("_" + c) for c in key], "ls", "rs")
    met = F.lit(True)
    for c in key:
        met = met & F.col(c).eqNullSafe(F.col("_" + c))
    within = lambda c, room: F.least(c, F.greatest(room, F.lit(0))).cast("int").alias(c)
    return x.distinct().join(far, met).select("chr", "op", "t", "size", within("ls", F.col("t") - F.col("low")), within("rs", F.col("high") - after + 1))


def intron_indels(introns: DataFrame) -> DataFrame:
    """Short introns (chr, s1, e1, s2, e2) as deletions in the region of their two exons, as indel_shifts takes them."""
    return introns.select("chr", F.col("s1").alias("s"), F.col("e2").alias("e"), (F.col("e1") - F.col("s1") + 1).alias("pos"), (F.col("e1") - F.col("s2") + 1).alias("size"), F.lit(None).cast("string").alias("seq"))
