"""Ratios, cumulative curves and summaries of count tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return a.cast("double") / F.nullif(b, F.lit(0))


def at_least(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Replaces counts at k by counts at k or more. Windows run over a histogram, which is small for any input."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.sum(c).over(w) for c in columns})


def up_to(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.sum(c).over(w) for c in columns})


def collapsed(df: DataFrame, by: list[str], key: str, most: int, columns: list[str]) -> DataFrame:
    """Rows with a key of `most` or more are summed into one."""
    return df.groupBy(*by, F.least(key, F.lit(most)).alias(key)).agg(*[F.sum(c).alias(c) for c in columns])


def f_score(p: Column, r: Column) -> Column:
    return 2 * p * r / F.nullif(p + r, F.lit(0.0))


def runs_above(df: DataFrame, pos: str, value: str, cutoff: float) -> DataFrame:
    """Maximal runs of consecutive positions with a value above the cutoff: s, e."""
    w = Window.orderBy(pos)
    high = df.where(F.col(value) > cutoff).withColumn("g", F.col(pos) - F.row_number().over(w))
    return high.groupBy("g").agg(F.min(pos).alias("s"), F.max(pos).alias("e")).select("s", "e")


def variation(value: Column) -> Column:
    return F.stddev_pop(value) / F.nullif(F.avg(value), F.lit(0.0))


BUCKETS = 4096  # to a range that is looked at


def _located(x: DataFrame, low: float, high: float, ranks: list[int]) -> dict[int, float]:
    """The values at ranks (from 0) of a column v of finite numbers from low to high. Each round counts the values of all open ranges in one scan; BUCKETS rows for each open range reach the driver.

    A range is cut into equal parts (its smallest value from the rest, where parts would be empty); a part that holds a rank becomes a range of its own
    from its smallest to its largest value. The smallest and the largest value of a range never share a part, so each round narrows.
    """
    found: dict[int, float] = {}
    open_ = {(low, high): [(k, k) for k in ranks]}  # range: (rank within it, rank asked for)
    while open_:
        for bounds in [b for b in open_ if b[0] == b[1]]:
            found |= {asked: bounds[0] for _, asked in open_.pop(bounds)}
        if not open_:
            break
        bucket = F.lit(None).cast("struct<r:int,b:int>")
        ranges = sorted(open_)
        for i, (a, b) in enumerate(ranges):
            width = b / BUCKETS - a / BUCKETS
            at = F.floor((F.col("v") / BUCKETS - a / BUCKETS) / width * BUCKETS) if width > 0 else F.when(F.col("v") > a, BUCKETS - 1).otherwise(0)
            inside = F.col("v").between(a, b)
            bucket = F.when(inside, F.struct(F.lit(i).alias("r"), F.least(F.greatest(at, F.lit(0)), F.lit(BUCKETS - 1)).cast("int").alias("b"))).otherwise(bucket)
        rows = x.withColumn("x", bucket).where("x is not null").groupBy("x.r", "x.b").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        narrower: dict[tuple[float, float], list[tuple[int, int]]] = {}
        for i, bounds in enumerate(ranges):
            below = 0
            for r in sorted((r for r in rows if r["r"] == i), key=lambda r: r["b"]):
                inside = [(k - below, asked) for k, asked in open_[bounds] if below <= k < below + r["n"]]
                if inside:
                    part = (r["low"], r["high"])
                    if part == bounds:
                        raise ValueError(f"the range {bounds} does not narrow")
                    narrower.setdefault(part, []).extend(inside)
                below += r["n"]
        open_ = narrower
    return found


def order_statistics(df: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """The values at ranks (from 0) of a column in ascending order, without sorting it: -infinity first, then numbers, infinity, NaN. Nulls are left out.

    All ranks are looked for at once, so the input is read once for the bounds and once for each narrowing of the ranges.
    """
    v = F.col(value).cast("double")
    x = df.where(v.isNotNull()).select(v.alias("v"))
    inf = float("inf")
    finite = ~F.isnan("v") & (F.abs("v") < inf)
    one = lambda c: F.count(F.when(c, 1))
    lows, numbers, highs, low, high = x.agg(one(F.col("v") == -inf), one(finite), one(F.col("v") == inf), F.min(F.when(finite, F.col("v"))), F.max(F.when(finite, F.col("v")))).first()
    inner = sorted({k - lows for k in ranks if lows <= k < lows + numbers})
    found = _located(x.where(finite), low, high, inner) if inner else {}
    return [-inf if k < lows else found[k - lows] if k < lows + numbers else inf if k < lows + numbers + highs else float("nan") for k in ranks]


def order_statistic(df: DataFrame, value: str, k: int) -> float:
    """The k-th smallest value (from 0), as order_statistics has it."""
    return order_statistics(df, value, [k])[0]


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, interpolated between neighbours; null and NaN are left out. No task sees all distinct values."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    n = known.count()
    if not n:
        return [None] * len(shares)
    at = [(n - 1) * share for share in shares]
    ranks = sorted({f(a) for a in at for f in (math.floor, math.ceil)})
    v = dict(zip(ranks, order_statistics(known, value, ranks)))
    between = lambda a, lo, hi: lo if lo == hi else lo + (hi - lo) * (a - math.floor(a))
    return [between(a, v[math.floor(a)], v[math.ceil(a)]) for a in at]


def tertile(value: Column, low: Column, high: Column) -> Column:
    return F.when(value <= low, 1).when(value <= high, 2).otherwise(3)


def dense(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A histogram with a row for every key from 0 to its largest, zeros where there was none. It has as many rows as keys, not as counts."""
    spine = df.agg(F.max(key).cast("long").alias("top")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias(key))
    return spine.join(df.select(F.col(key).cast("long").alias(key), *columns), key, "left").na.fill(0, columns)


def histogram(df: DataFrame, value: str, most: int) -> DataFrame:
    """value and n for every whole number from 0 to `most`, zeros included; a value outside is an error."""
    bad = F.raise_error(F.concat(F.lit(f"not between 0 and {most}: "), F.coalesce(F.col(value).cast("string"), F.lit("null")))).cast("long")
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    known = counts.select(F.when(F.col(value).between(0, most), F.col(value).cast("long")).otherwise(bad).alias(value), "n")
    spine = df.sparkSession.range(most + 1).select(F.col("id").alias(value))
    return known.join(spine, value, "full").na.fill(0, ["n"]).select(value, "n")  # full, so that no value is passed over


def wide(df: DataFrame, by: list[str], kind: str, kinds: tuple[str, ...], value: str) -> DataFrame:
    """A column for each of the kinds with the sum of its values, 0 where there is none."""
    return df.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(value))), F.lit(0)).cast("long").alias(k) for k in kinds])


def percent(part: Column, whole: Column, most: float = 100.0) -> Column:
    """Per cent of the whole, 0 where there is none of it, at most `most`."""
    return F.least(F.coalesce(100 * ratio(part, whole), F.lit(0.0)), F.lit(float(most)))


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The smallest and the largest value of each group: low, high."""
    return df.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
