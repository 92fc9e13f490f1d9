"""Ranks and running sums over whole tables, without a window that one task must hold."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from junctura.operators.durable import checkpoint

POINTS = 10_000  # of a grid


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df in the order of `order`, dealt to tasks by ranges, with _at: the number of the task and of the row in it. Written, so that all that follows sees the same ranges."""
    return checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))


def _with_sums(x: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Adds, for each {new: old}, the sum of old over the rows up to this one: running sums within each task, moved by the sums of the tasks below.

    The driver sees one row for each task, whatever the number of rows.
    """
    x = x.withColumn("_task", F.shiftright("_at", 33))
    tasks = x.groupBy("_task").agg(*[F.sum(old).alias(new) for new, old in sums.items()])
    kinds = ", ".join(["_task bigint", *[f"`_below_{f.name}` {f.dataType.simpleString()}" for f in tasks.schema.fields[1:]]])
    below, rows = [type_(0) for type_ in [_zero(f) for f in tasks.schema.fields[1:]]], []
    for task, *here in sorted(tuple(r) for r in tasks.collect()):
        rows.append((task, *below))
        below = [a + (b or 0) for a, b in zip(below, here)]
    moved = F.broadcast(x.sparkSession.createDataFrame(rows, kinds))  # a row for each task
    within = Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("*", *[F.coalesce(F.sum(old).over(within), F.lit(0)).alias("_in_" + new) for new, old in sums.items()]).join(moved, "_task")
    return x.withColumns({new: F.col("_below_" + new) + F.col("_in_" + new) for new in sums}).drop("_task", *["_in_" + n for n in sums], *["_below_" + n for n in sums])


def _zero(field: StructField) -> type:
    return {"double": float, "bigint": int}.get(field.dataType.simpleString(), Decimal)


def numbered(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with the place of each row in `order`, from 1; equal rows have places beside each other."""
    return _with_sums(_ranged(df, order).withColumn("_one", F.lit(1).cast("long")), {name: "_one"}).drop("_one", "_at")


def dense_ids(df: DataFrame, key: list[str], name: str = "id") -> DataFrame:
    """df with numbers from 1 for the distinct values of key, in their order (nulls first). The values are numbered apart and joined back, so a frequent one is no task of its own."""
    ids = numbered(df.select(*key).distinct(), key, name)
    names = {c: "_k_" + c for c in key}
    met = None
    for c in key:
        one = df[c].eqNullSafe(F.col(names[c]))
        met = one if met is None else met & one
    return df.join(ids.withColumnsRenamed(names), met).drop(*names.values())


def cumulative(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with running sums {new: old} in `order` (distinct values)."""
    return _with_sums(_ranged(df, order), sums).drop("_at")


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """value and share, the part of the rows at or below it, for every distinct value; null and NaN are left out."""
    x = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(value).agg(F.count("*").alias("n"))
    steps = cumulative(x, [value], {"upto": "n"})
    total = steps.agg(F.max("upto").alias("total"))
    return steps.crossJoin(F.broadcast(total)).select(value, (F.col("upto") / F.col("total")).alias("share"))  # one row


def sampled(steps: DataFrame, value: str, grid: list[float]) -> DataFrame:
    """x and share for each point of a grid: the share at or below it, 0 below the smallest value. The grid is a parameter of a curve, POINTS long at most.

    Each step goes to the first point at or above it, by halving; the largest share of each point, one row each, reaches the driver.
    """
    xs = sorted({float(x) for x in grid})
    if len(xs) > POINTS:
        raise ValueError(f"a grid has at most {POINTS} points")
    spark = steps.sparkSession
    held = F.broadcast(spark.createDataFrame([(xs,)], "xs array<double>"))  # POINTS numbers at most
    halved = f"""aggregate(sequence(1, {max(1, len(xs)).bit_length() + 1}), named_struct('lo', 0L, 'hi', CAST(size(xs) AS BIGINT)), (b, i) ->
        CASE WHEN b.lo >= b.hi THEN b WHEN xs[CAST((b.lo + b.hi) div 2 AS INT)] < CAST({value} AS DOUBLE) THEN named_struct('lo', (b.lo + b.hi) div 2 + 1, 'hi', b.hi) ELSE named_struct('lo', b.lo, 'hi', (b.lo + b.hi) div 2) END, b -> b.lo)"""
    best = dict(steps.join(held, how="cross").select(F.expr(halved).alias("k"), "share").groupBy("k").agg(F.max("share")).collect())
    rows, upto = [], 0.0
    for k, x in enumerate(xs):
        upto = max(upto, best.get(k, 0.0))
        rows.append((x, upto))
    return spark.createDataFrame(rows, "x double, share double")


def exponential_grid(low: float, high: float, points: int) -> list[float]:
    """Points from low to high at equal ratios."""
    ratio = (high / low) ** (1 / (points - 1)) if points > 1 else 1.0
    return [low * ratio**k for k in range(points)]
