"""Junction counts over alignments that keep arriving: the batch operators on a stream of SAM text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.operators import gaps


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming DataFrame of reads for each junction; write it in update or complete mode. State is one row a junction."""
    f = F.split("value", "\t")
    lines = spark.readStream.text(folder).where(~F.col("value").startswith("@"))
    return gaps.junction_counts(lines.select(F.get(f, F.lit(1)).cast("int").alias("flag"), F.get(f, F.lit(2)).alias("chr"), F.get(f, F.lit(3)).cast("int").alias("pos"), F.get(f, F.lit(5)).alias("cigar")))
