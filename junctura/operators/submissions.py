"""Several predicted sets of transcripts graded against one reference in one plan.

Rows of all sets carry the columns of `by`, which name their set; a set without transcripts is known from `sets` only and has zeros. A pattern is the
introns of a spliced transcript with its strand. Grades: 3 the reference has the pattern, 2 a pattern of the reference holds the whole chain, 1 one shares an intron, 0 none.

stranded: whether strands must agree, for spliced and for unspliced transcripts. Where spliced ones must, a prediction without a strand (.) has no pattern; where both
must, it is left out altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from junctura.operators import order, reconstruction
from junctura.sources.text import gtf, transcripts

HIT = {3: "corr", 2: "part", 1: "wrong"}


def from_folders(spark: SparkSession, folders: dict[str, str], name: str = "transcripts.gtf") -> tuple[DataFrame, DataFrame]:
    """submission with tx_id, gene_id, type, chr, strand and exons of the annotation in each folder, and the table of all submissions. A folder without the file has no transcripts."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = None
    for submission, folder in folders.items():  # one entry for each set that is compared
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(conf).exists(path):
            one = transcripts(gtf(spark, f"{folder}/{name}")).withColumn("submission", F.lit(submission))
            found = one if found is None else found.unionByName(one)
    if found is None:
        exons = "array<struct<s:int,e:int>>"
        found = spark.createDataFrame([], f"tx_id string, gene_id string, type string, chr string, strand string, exons {exons}, submission string")
    return found, spark.createDataFrame([(s,) for s in folders], "submission string")


def _key(introns: Column) -> Column:
    """A chain as text in which a part of it is a substring between colons."""
    return F.concat(F.lit(":"), F.concat_ws(":", F.transform(introns, lambda x: F.concat_ws("-", x["left"], x["right"]))), F.lit(":"))


def _usable(predicted: DataFrame, stranded: tuple[bool, bool]) -> DataFrame:
    return predicted.where("strand != '.'") if all(stranded) else predicted


def reference_patterns(reference: DataFrame) -> DataFrame:
    """pattern_id (from 1, without gaps), chr, strand and introns of the distinct patterns."""
    return order.numbered(reconstruction.chains(reference).select("chr", "strand", "introns").distinct(), ["chr", "strand", "introns"], "pattern_id")


def matches(patterns: DataFrame, predicted: DataFrame, by: list[str], stranded: tuple[bool, bool] = (True, True)) -> DataFrame:
    """by, chr, strand and introns of each predicted pattern (once in a set) with pattern_id and hit of every pattern of the reference that shares an intron with it; both null if none does.

    Patterns meet on their introns, in all sets at once; a pair that shares several is graded once.
    """
    spliced = stranded[0]
    p = _usable(predicted, stranded).where(F.size("exons") > 1)
    p = p.where("strand != '.'") if spliced else p
    chain = reconstruction.chains(p.withColumn("tx_id", F.struct(*by)))
    own = chain.select(*[F.col("tx_id")[c].alias(c) for c in by], "chr", "strand", "introns").distinct()
    end = ["chr", "strand"] if spliced else ["chr"]
    ref = patterns.select("pattern_id", *end, F.explode("introns").alias("j"), F.col("introns").alias("r_introns"))
    pairs = own.select("*", F.explode("introns").alias("j")).join(ref, [*end, "j"]).select(*own.columns, "pattern_id", "r_introns").distinct()
    hit = F.when(F.col("introns") == F.col("r_introns"), 3).when(F.contains(_key(F.col("r_introns")), _key(F.col("introns"))), 2).otherwise(1)
    return own.join(pairs.withColumn("hit", hit).drop("r_introns"), own.columns, "left")


def matrix(patterns: DataFrame, found: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """The match matrix in long form: pattern_id, by and the best hit (0 if none) for every pattern of the reference and every set, empty ones too."""
    best = found.where("pattern_id is not null").groupBy(*by, "pattern_id").agg(F.max("hit").alias("hit"))
    every = patterns.select("pattern_id").join(F.broadcast(sets.select(*by)), how="cross")  # patterns by sets, which the matrix has as rows
    return every.join(best, [*by, "pattern_id"], "left").na.fill(0, ["hit"])


def matrix_wide(long: DataFrame, by: str, most: int = 1000) -> DataFrame:
    """pattern_id and a column for each set, named as it is found in the data; `most` names at most reach the driver."""
    names = sorted(r[0] for r in long.select(by).distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} sets")
    return long.groupBy("pattern_id").pivot(by, names).agg(F.max("hit"))


def report(reference: DataFrame, predicted: DataFrame, sets: DataFrame, by: list[str], known: DataFrame | None = None, stranded: tuple[bool, bool] = (True, True), share: float = 0.6) -> DataFrame:
    """A row for each set: ref_tx and pred_tx with _corr, _part and _wrong; ref_exons, _known, _corr, _corr_known; pred_exons, _corr, _corr_known. known: transcripts of an annotation."""
    patterns = reference_patterns(reference)
    found = matches(patterns, predicted, by, stranded)
    count = lambda kind: [F.count(F.when(F.col("hit") == h, 1)).alias(f"{kind}_{name}") for h, name in HIT.items()]
    ref = matrix(patterns, found, sets, by).groupBy(*by).agg(F.count("*").alias("ref_tx"), *count("ref_tx"))
    own = found.groupBy(*by, "chr", "strand", "introns").agg(F.coalesce(F.max("hit"), F.lit(0)).alias("hit"))
    pred = own.groupBy(*by).agg(F.count("*").alias("pred_tx"), *count("pred_tx"))
    exons = reconstruction.typed_exons(reference)
    exons = reconstruction.known_exons(exons, reconstruction.typed_exons(known), stranded=stranded, share=share) if known is not None else exons.withColumn("known", F.lit(False))
    each = _usable(predicted, stranded).select(*by, "chr", "strand", F.inline("exons")).distinct()
    pairs = reconstruction.exon_pairs(each, exons, share=share, stranded=stranded)
    one = lambda c: F.count(F.when(c, 1))
    hit = pairs.groupBy(*each.columns).agg(F.max("r_known").alias("k"))
    p = each.join(hit, each.columns, "left").groupBy(*by).agg(F.count("*").alias("pred_exons"), F.count("k").alias("pred_exons_corr"), one(F.col("k")).alias("pred_exons_corr_known"))
    met = pairs.select(*by, "chr", *[F.col("r_" + c).alias("r_" + c) for c in ("strand", "s", "e", "kind", "known")]).distinct()
    r = met.groupBy(*by).agg(F.count("*").alias("ref_exons_corr"), one(F.col("r_known")).alias("ref_exons_corr_known"))
    total = exons.agg(F.count("*").alias("ref_exons"), one(F.col("known")).alias("ref_exons_known"))
    out = sets.select(*by).join(ref, by, "left").join(pred, by, "left").join(p, by, "left").join(r, by, "left").join(F.broadcast(total), how="cross").na.fill(0)  # one row
    return out.select(*by, "ref_tx", *[f"ref_tx_{k}" for k in HIT.values()], "pred_tx", *[f"pred_tx_{k}" for k in HIT.values()], "ref_exons", "ref_exons_known", "ref_exons_corr", "ref_exons_corr_known", "pred_exons", "pred_exons_corr", "pred_exons_corr_known")


def rates(stats: DataFrame) -> DataFrame:
    """stats with tx_sens, tx_prec, exon_sens and exon_prec; null where nothing was there to be found or predicted."""
    r = lambda a, b: F.col(a).cast("double") / F.nullif(F.col(b), F.lit(0))
    return stats.withColumns({"tx_sens": r("ref_tx_corr", "ref_tx"), "tx_prec": r("pred_tx_corr", "pred_tx"), "exon_sens": r("ref_exons_corr", "ref_exons"), "exon_prec": r("pred_exons_corr", "pred_exons")})


def compared(stats: DataFrame, by: list[str], kind: str, first: str, second: str) -> DataFrame:
    """Two kinds of the same sets side by side: by, each rate of both kinds, and the difference (second minus first). One grouping, no join."""
    rated = rates(stats)
    of = lambda c, k: F.max(F.when(F.col(kind) == k, F.col(c)))
    names = ("tx_sens", "tx_prec", "exon_sens", "exon_prec")
    return rated.groupBy(*by).agg(*[x for c in names for x in (of(c, first).alias(f"{c}_{first}"), of(c, second).alias(f"{c}_{second}"), (of(c, second) - of(c, first)).alias(f"{c}_more"))])


def summed_by_pattern(members: DataFrame, levels: DataFrame, value: str) -> DataFrame:
    """pattern_id, transcripts and the sum of a level over the transcripts of each splice form; a transcript without a level adds nothing."""
    return members.join(levels.select("tx_id", value), "tx_id", "left").groupBy("pattern_id").agg(F.count("*").alias("transcripts"), F.coalesce(F.sum(value), F.lit(0.0)).alias(value))


def known_flags(patterns: DataFrame, annotation: DataFrame, stranded: bool = True) -> DataFrame:
    """id and known (1 or 0) of every pattern of `reference_patterns`: whether a transcript of an annotation has its introns, on its strand or, if not stranded, on any."""
    key = ["chr", "strand", "introns"] if stranded else ["chr", "introns"]
    held = reconstruction.chains(annotation).select(*key).distinct().withColumn("known", F.lit(1))
    return patterns.join(held, key, "left").select(F.col("pattern_id").alias("id"), F.coalesce("known", F.lit(0)).alias("known"))
