"""Result files of an evaluation, many to a family, read back as one long table.

Files of a family may differ in their rows and columns. The values come as (keys of the file name, row, label, column, value); what a file does not
have is absent in the long table, and null where `stacked` fills the cube of all labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.sources.text import numbered_lines

#: family.team.dataset_number.txt, or team/dataset_number.family.txt
BY_FAMILY, BY_TEAM = r"([^/.]+)\.([^/]+)\.([^/.]+)_([0-9]+)\.txt$", r"([^/]+)/([^/.]+)_([0-9]+)\.([^/]+)\.txt$"
KEYS = ["family", "team", "dataset", "number"]


def _keys(file: Column, by_team: bool) -> list[Column]:
    at = {"team": 1, "dataset": 2, "number": 3, "family": 4} if by_team else {"family": 1, "team": 2, "dataset": 3, "number": 4}
    part = lambda k: F.regexp_extract(file, BY_TEAM if by_team else BY_FAMILY, at[k])
    known = F.when(part("team") == "", F.raise_error(F.concat(F.lit("no family, team, data set and number in "), file)).cast("string")).otherwise(part("team"))
    return [part("family").alias("family"), known.alias("team"), part("dataset").alias("dataset"), part("number").cast("int").alias("number")]


def dataset_of(path: Column) -> Column:
    """The data set that a path names: what stands in its last part before _number and the suffix, without family and team; null if there is none."""
    return F.nullif(F.regexp_extract(path, r"(?:^|[/.])([^/.]+)_[0-9]+(?:\.[^/]*)?$", 1), F.lit(""))


def lines(spark: SparkSession, path: str, by_team: bool = False) -> DataFrame:
    """family, team, dataset, number, i (number of the line, from 0) and value of the files of a glob."""
    return numbered_lines(spark, path).select(*_keys(F.col("file"), by_team), "i", "value")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """The number on the first line of each file: family, team, dataset, number, total."""
    return lines(spark, path).where("i = 0").select(*KEYS, F.col("value").cast("long").alias("total"))


def scan(spark: SparkSession, path: str, labels: int = 1, preamble: int = 0, header: bool = True, by_team: bool = False) -> DataFrame:
    """family, team, dataset, number, row (from 1), label (the first `labels` cells, joined by a blank; the row's number if there are none), column and value of tab-separated files.

    The header stands after `preamble` lines; without one, columns are named by their place, from 1. Cells of a row are put under the header of their own file.
    A row of another length than its header is an error. NA and empty cells are null.
    """
    x = lines(spark, path, by_team).withColumn("cells", F.split("value", "\t"))
    body = x.where((F.col("i") > preamble) if header else (F.col("i") >= preamble)).where(F.length("value") > 0)
    row = (F.col("i") - preamble + (0 if header else 1)).alias("row")
    if header:
        heads = x.where(F.col("i") == preamble).select(*KEYS, F.col("cells").alias("names"))
        body = body.join(heads, KEYS)
    else:
        body = body.withColumn("names", F.transform(F.sequence(F.lit(1), F.size("cells")), lambda k: k.cast("string")))
    where = F.concat_ws(".", *KEYS)
    ragged = F.raise_error(F.concat(F.lit("a row and its header differ in length in "), where)).cast("array<string>")
    cells = F.when(F.size("cells") != F.size("names"), ragged).otherwise(F.col("cells"))
    label = F.array_join(F.slice("cells", 1, labels), " ") if labels else (F.col("i") - preamble).cast("string")
    pairs = F.slice(F.arrays_zip(F.col("names").alias("column"), cells.alias("value")), labels + 1, 1 << 20)
    long = body.select(*KEYS, row, label.alias("label"), F.inline(pairs).alias("column", "value"))
    return long.withColumn("value", F.when(F.col("value").isin("NA", ""), None).otherwise(F.col("value")))


def counts(long: DataFrame) -> DataFrame:
    """The long table with numbers for values; anything else is an error."""
    return long.withColumn("value", F.col("value").cast("double"))


def checked(long: DataFrame, labels: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """long, if every file has exactly these labels in this order and these columns, each once in each row. Else an error that names a file.

    One aggregation by file; the labels of a row are compared with their place, so no order is needed.
    """
    bad = F.lit(False)
    if labels is not None:
        want = F.array(*map(F.lit, labels))
        bad = bad | F.coalesce(F.get(want, (F.col("row") - 1).cast("int")) != F.col("label"), F.lit(True))
    if columns is not None:
        bad = bad | ~F.col("column").isin(*columns)
    per = long.groupBy(*KEYS).agg(F.count(F.when(bad, 1)).alias("bad"), F.count("*").alias("n"), F.countDistinct("row").alias("rows"), F.countDistinct("row", "column").alias("places"), F.countDistinct("column").alias("columns"))
    wrong = (F.col("bad") > 0) | (F.col("n") != F.col("places")) | (F.col("n") != F.col("rows") * F.col("columns"))
    wrong = wrong | (F.col("rows") != len(labels)) if labels is not None else wrong
    wrong = wrong | (F.col("columns") != len(columns)) if columns is not None else wrong
    found = per.where(wrong).select(F.concat_ws(".", *KEYS)).first()
    if found:
        raise ValueError(f"rows or columns are not as they should be in {found[0]}")
    return long


def stacked(long: DataFrame) -> DataFrame:
    """family, team, dataset, number, label, column and value for every file, every label and every column that any file has; null where a file lacks it.

    The cube has as many rows as the files would have if they had all labels, which result files are small enough for.
    """
    files, labels, columns = long.select(*KEYS).distinct(), long.select("label").distinct(), long.select("column").distinct()
    spine = files.join(labels, how="cross").join(columns, how="cross")  # of names only
    return spine.join(long.select(*KEYS, "label", "column", "value"), [*KEYS, "label", "column"], "left")


def square(long: DataFrame, value: str, by: tuple[str, str]) -> DataFrame:
    """family, team, dataset, number, i and counts (array, by j) of tables that list a square matrix row by row: the columns named by `by` hold i and j, `value` the count.

    i and j must run from 0 to n - 1 in this order, n * n rows in all; else an error.
    """
    one = lambda c: F.max(F.when(F.col("column") == c, F.col("value"))).cast("long")
    cells = long.groupBy(*KEYS, "row").agg(one(by[0]).alias("i"), one(by[1]).alias("j"), one(value).alias("n"))
    per = cells.groupBy(*KEYS).agg((F.max("i") + 1).alias("size"), F.count("*").alias("rows"))
    met = cells.join(per, KEYS)
    off = (F.col("rows") != F.col("size") * F.col("size")) | (F.col("i") != F.floor((F.col("row") - 1) / F.col("size"))) | (F.col("j") != (F.col("row") - 1) % F.col("size")) | F.col("n").isNull()
    bad = F.raise_error(F.concat(F.lit("not a square matrix in order: "), F.concat_ws(".", *KEYS))).cast("bigint")
    met = met.withColumn("i", F.when(F.coalesce(off, F.lit(True)), bad).otherwise(F.col("i")))
    return met.groupBy(*KEYS, "i").agg(F.sort_array(F.collect_list(F.struct("j", "n"))).alias("x")).select(*KEYS, "i", F.transform("x", lambda s: s["n"]).alias("counts"))


def with_methods(found: DataFrame, methods: DataFrame) -> DataFrame:
    """found with the columns of its method (team, number, name, ...); files of unknown methods go."""
    return found.join(methods.withColumn("number", F.col("number").cast("int")), ["team", "number"])


def wide(long: DataFrame, by: list[str], column: str, value: str, most: int = 10_000) -> DataFrame:
    """A column for each kind found in the data, in two passes: the kinds, at most `most`, reach the driver, then the sums are pivoted. Null where there is none."""
    kinds = sorted(r[0] for r in long.select(column).distinct().limit(most + 1).collect() if r[0] is not None)
    if len(kinds) > most:
        raise ValueError(f"{column} has more than {most} kinds")
    return long.groupBy(*by).pivot(column, kinds).agg(F.first(value))
