"""A training corpus from documents: four stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.llm import near_dedup, packing, suffix_dedup, toxicity
from junctura.llm.common import fresh_path, table
from junctura.llm.queries import WORD_BPE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, trained on the labelled documents of the corpus, scores at one half or more go.

    A null text counts as empty and is scored; repeated rows are judged each; other columns stay; an empty table stays empty.
    """
    tagger = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, tagger)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Null and empty texts are linked with nothing and stay. Other columns stay, whatever their names; an empty table stays empty.
    """
    return near_dedup.dedup(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under a 50-byte string that an earlier document holds are cut; n_chars follows the text.

    A null text becomes empty. Rows stay, repeated ones too, and so do other columns; an empty table stays empty.
    """
    cut = suffix_dedup.cut(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents in sequences of packing.CAPACITY tokens; what a null or empty text becomes, packing.pack says. An empty table has no places."""
    return packing.pack(packing.measured(docs, WORD_BPE))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("suffix_dedup", cut_repeats), ("packing", pack)]

#: The tagger and the tokenizer are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


#: Rows that pass between Spark and Python at a time; whole texts make large batches, which both sides hold.
BATCH_ROWS = 2048
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        for name, stage in STAGES:
            path = fresh_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(_BATCH, rows)
    return docs
