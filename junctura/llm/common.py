"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


LOT = 1024  # rows summed up together in `before`

#: Empties what an operator remembers in a worker process beyond a task.
FORGET: list[Callable[[], None]] = []


def forget() -> None:
    """Gives back what earlier tasks, of other operators too, left in this worker process.

    Spark reuses worker processes, and all memory they hold counts against their executor.
    """
    for clear in FORGET:
        clear()
    give_back()


def give_back() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can reach, as a URI without a trailing slash.

    It is what the cluster names in spark.checkpoint.dir. Where that is unset and Spark runs in one process (tests on
    one machine), a new local folder is taken and set; on a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return (found if re.match(r"\w+:", found) else f"file://{found}").rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, at most `rows` rows pass between Spark and Python at a time."""
    before = spark.conf.get(_BATCH)
    least = [n for n in (int(before), rows) if n > 0]  # 0 and less: no bound
    spark.conf.set(_BATCH, min(least))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows; one number reaches the driver."""
    return docs.select(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def pieces(total: int, each: int, least: int) -> int:
    """How many parts of about `each` bytes hold `total` bytes, `least` at the fewest."""
    return max(least, -(-total // each))


def strings(column: pa.Array, rows: int = 512) -> Iterator[str]:
    """The texts of a column, null as empty; no more than `rows` of them are taken out at a time."""
    for lo in range(0, len(column), rows):
        for t in column.slice(lo, rows).to_pylist():
            yield t or ""


def row_and_text(docs: DataFrame) -> DataFrame:
    """Two columns: row, a struct of all columns but text, so that no name can clash, and text."""
    rest = [docs[c] for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("row") if rest else F.struct(F.lit(None).cast("string").alias("none")).alias("row"), docs["text"].cast("string").alias("text"))


def before(counts: DataFrame, by: list[str], order: Column, lot: Column) -> DataFrame:
    """counts with `before`, the sum of `here` over the rows of `by` that stand before in `order`.

    lot does not fall where order rises; windows run within a lot and over the lots, so neither sees all rows.
    """
    x = counts.withColumn("_lot", lot)
    lots = x.groupBy(*by, "_lot").agg(F.sum("here").alias("_all"))
    w = lambda on, by_: Window.partitionBy(*on).orderBy(by_).rowsBetween(Window.unboundedPreceding, -1)
    lots = lots.select(*by, "_lot", F.coalesce(F.sum("_all").over(w(by, F.col("_lot"))), F.lit(0)).alias("_first"))
    inner = x.withColumn("_inner", F.coalesce(F.sum("here").over(w([*by, "_lot"], order)), F.lit(0)))
    return inner.join(lots, [*by, "_lot"]).withColumn("before", F.col("_first") + F.col("_inner")).drop("_lot", "_first", "_inner")


def ranked(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with `idx`, the place of a row among those of `by` in `order` (from 0, nulls first), and `size`, their number.

    Rows are dealt by ranges of (by, order), so a group of any size is many tasks; the rows of a task are numbered as they
    stand, and sums over the tasks of a group, one row each, move the numbers. Rows equal in `order` stand in any order.
    """
    keys = [F.col(c) for c in (*by, *order)]
    x = checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    runs = x.groupBy(*by, task.alias("_task")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    above = F.coalesce(F.sum("_n").over(w.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(*[F.col(c).alias("_" + c) for c in by], "_task", (above - F.col("_first")).alias("_move"), F.sum("_n").over(w).alias("size"))
    met = F.shiftright(x["_at"], 33) == runs["_task"]
    for c in by:
        met = met & x[c].eqNullSafe(runs["_" + c])
    return x.join(runs, met).withColumn("idx", F.col("_at") + F.col("_move")).drop("_at", "_task", "_move", *["_" + c for c in by])


STRETCH = 1024  # rows of a group that stand in one task of `running`


def running(df: DataFrame, by: list[str], position: str, columns: dict[str, str], xor: bool = False, downward: bool = False) -> DataFrame:
    """df with the running sums (or exclusive ors) of columns, {new: old}, along position within by, the row itself included.

    A group is worked on by stretches of STRETCH positions; the sums of whole stretches, one row each, are joined to the rest.
    """
    f, join = (F.bit_xor, lambda a, b: a.bitwiseXOR(b)) if xor else (F.sum, lambda a, b: a + b)
    sort = lambda c: F.col(c).desc() if downward else F.col(c)
    x = df.withColumn("_lot", F.floor(F.col(position) / STRETCH))
    key = [*by, "_lot"]
    lots = x.groupBy(*key).agg(*[f(old).alias("_" + new) for new, old in columns.items()])
    w = Window.partitionBy(*by).orderBy(sort("_lot")).rowsBetween(Window.unboundedPreceding, -1)
    lots = lots.select(*key, *[F.coalesce(f("_" + new).over(w), F.lit(0)).alias("_" + new) for new in columns])
    w = Window.partitionBy(*key).orderBy(sort(position)).rowsBetween(Window.unboundedPreceding, 0)
    inner = x.select("*", *[f(old).over(w).alias("_in_" + new) for new, old in columns.items()])
    out = inner.join(lots, key)
    return out.select(*df.columns, *[join(F.col("_in_" + new), F.col("_" + new)).alias(new) for new in columns])
