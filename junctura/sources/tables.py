"""Small tables of a study, and alignments, annotation and shifts written as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.sources.text import SAM, numbered_lines


def ids(spark: SparkSession, path: str) -> DataFrame:
    """id: the distinct values of the first column of a tab-separated table without a header."""
    return spark.read.csv(path, sep="\t").select(F.col("_c0").alias("id")).distinct()


def datasets(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """The rows of a table with an id column, only those whose id holds the pattern if one is given."""
    t = spark.read.csv(path, sep="\t", header=True)
    return t.where(F.col("id").rlike(pattern)) if pattern else t


def methods(spark: SparkSession, path: str, styles: str) -> DataFrame:
    """Methods with the columns of their style; a method whose style is unknown is an error."""
    t = spark.read.csv(path, sep="\t", header=True)
    s = spark.read.csv(styles, sep="\t", header=True).withColumn("_known", F.lit(True))
    checked = F.when(F.col("_known").isNull(), F.raise_error(F.concat(F.lit("no style "), F.coalesce("style", F.lit("null")))).cast("string")).otherwise(F.col("style"))
    return t.join(s, "style", "left").withColumn("style", checked).drop("_known")


#: The header of a table of expression levels.
EXPRESSION = "id string, size long, exons int, `reads.exonic` long, `reads.intronic` long, fpkm double"


def expression(spark: SparkSession, path: str, schema: str = EXPRESSION) -> DataFrame:
    """A table with a header; another header than the schema's is an error. Dots in names become underscores."""
    t = spark.read.schema(schema).option("enforceSchema", False).csv(path, sep="\t", header=True)
    return t.toDF(*[c.replace(".", "_") for c in t.columns])


def expressed_ids(levels: DataFrame, mature_only: bool = False) -> DataFrame:
    """tx_id of the transcripts of `expression` that reads fall on, within exons, or without mature_only within introns too."""
    n = F.coalesce("reads_exonic", F.lit(0)) + (F.lit(0) if mature_only else F.coalesce("reads_intronic", F.lit(0)))
    return levels.where(n > 0).select(F.col("id").alias("tx_id")).distinct()


def spliced_levels(levels: DataFrame) -> DataFrame:
    """The rows of `expression` of expressed transcripts with introns."""
    return levels.where((F.col("exons") > 1) & (F.col("fpkm") > 0))


def after_preamble(spark: SparkSession, path: str, rows: int = 1) -> DataFrame:
    """A tab-separated table whose header comes after some rows, the same in every file; all columns are strings."""
    lines = numbered_lines(spark, path)
    header = lines.where(F.col("i") == rows).select("value").first()
    if header is None:
        raise ValueError(f"no header after {rows} rows")
    f = F.split("value", "\t")
    return lines.where(F.col("i") > rows).select(*[F.get(f, F.lit(k)).alias(c) for k, c in enumerate(header[0].split("\t"))])


def flags(spark: SparkSession, path: str) -> DataFrame:
    """id and known of a table with a header; ids that are not 1 to the number of rows are an error."""
    t = spark.read.schema("id long, known int").csv(path, sep="\t", header=True).select("id", (F.col("known") != 0).alias("known"))
    n, low, high, kinds = t.agg(F.count("*"), F.min("id"), F.max("id"), F.countDistinct("id")).first()
    if n and (low, high, kinds) != (1, n, n):
        raise ValueError("ids are not 1 to the number of rows")
    return t


def invalid_ids(counts: DataFrame, key: str = "target") -> DataFrame:
    """The distinct ids that are not valid, from tables of counts with `valid`."""
    return counts.where(~F.col("valid")).select(key).distinct()


def sam_text(alignments: DataFrame) -> DataFrame:
    """value: a SAM line for each row of the columns of text.sam. Numbers that are null become 0, other nulls *."""
    kinds = dict(alignments.dtypes)
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0" if kinds[c] in ("int", "bigint") else "*"))
    return alignments.select(F.concat_ws("\t", *map(cell, SAM), "tags").alias("value"))


def write_sam(alignments: DataFrame, path: str) -> None:
    sam_text(alignments).write.text(path)


def write_shifts(shifts: DataFrame, path: str) -> None:
    """The table that text.shifts reads, only of indels that can move."""
    moved = shifts.where((F.col("ls") > 0) | (F.col("rs") > 0))
    moved.select("chr", "t", F.when(F.col("op") == "D", -F.col("size")).otherwise(F.col("size")).alias("size"), "ls", "rs").write.csv(path, sep="\t")


def expressed_lines(spark: SparkSession, path: str, expressed: DataFrame) -> DataFrame:
    """value: the lines of an annotation, as they are, whose transcript is among those of expressed (tx_id)."""
    lines = spark.read.text(path).withColumn("tx_id", F.regexp_extract("value", r'\btranscript_id\s+"?([^";]+)"?', 1))
    return lines.join(expressed.select("tx_id"), "tx_id", "left_semi").select("value")
