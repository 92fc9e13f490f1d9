"""Named queries for wide reports, curves by set of junctions, and patterns with their members. They join those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from junctura.operators import annotation, gaps, metrics, quality, reconstruction
from junctura.plans import adapters as A
from junctura.plans.queries import _INC, _TRUE_FALSE, CAP, FIRST, ORACLE_SQL, _incorporated, _query, _true_false, op_count_per_read, op_size_distribution, pair_yield
from junctura.plans.scoring import _EXON_ACCURACY, exon_accuracy

_SIZES, _COUNTS = ("D", "D0", "D1", "I", "I0", "I1", "N", "S0", "S1"), ("D", "I", "N")


def _wide(kind: str, kinds: tuple[str, ...], value: str) -> str:
    return ", ".join(f"CAST(coalesce(sum(CASE WHEN {kind} = '{k}' THEN {value} END), 0) AS BIGINT) AS {k}" for k in kinds)


@_query(f"WITH {_INC} SELECT is_true, least(reads, {CAP}) AS depth, CAST(count(CASE WHEN predicted THEN 1 END) AS DOUBLE) / nullif(count(*), 0) AS rate FROM inc GROUP BY ALL")
def incorporation_by_depth(spark, d):
    """The share of true and false junctions of each depth that the annotation holds."""
    by = _incorporated(spark, d).groupBy("is_true", F.least("reads", F.lit(CAP)).alias("depth"))
    return by.agg(metrics.ratio(F.count(F.when(F.col("predicted"), 1)), F.count("*")).alias("rate"))


@_query(f"SELECT size, {_wide('class', _SIZES, 'n')} FROM ({ORACLE_SQL['op_size_distribution']}) GROUP BY size")
def op_size_report(spark, d):
    return metrics.wide(op_size_distribution(spark, d), ["size"], "class", _SIZES, "n")


@_query(f"""WITH c AS ({ORACLE_SQL['op_count_per_read']}), spine AS (SELECT unnest(range((SELECT max(k) FROM c) + 1)) AS k)
    SELECT CAST(spine.k AS BIGINT) AS k, {_wide('op', _COUNTS, 'reads')} FROM spine LEFT JOIN c ON c.k = spine.k GROUP BY spine.k""")
def op_count_report(spark, d):
    """Reads by their number of deletions, insertions and introns, a row for each number up to the largest."""
    return metrics.dense(metrics.wide(op_count_per_read(spark, d), ["k"], "op", _COUNTS, "reads"), "k", list(_COUNTS))


@_query(f"""WITH {_TRUE_FALSE}, {A.exons_sql('e1', FIRST)}, {A.splices_sql('s1', 'e1')}, k AS (SELECT n.*, EXISTS (SELECT 1 FROM s1 s WHERE s.chr = n.chr AND s.lft = n.start - 1 AND s.rgt = n.start + n.len) AS known FROM named n),
    sets AS (SELECT 'all' AS which, is_true, reads FROM k UNION ALL SELECT CASE WHEN known THEN 'known' ELSE 'novel' END, is_true, reads FROM k),
    h AS (SELECT which, is_true, least(reads, {CAP}) AS depth, count(*) AS junctions FROM sets GROUP BY ALL)
    SELECT which, is_true, depth, CAST(sum(junctions) OVER (PARTITION BY which, is_true ORDER BY depth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS junctions FROM h""")
def true_false_curve_sets(spark, d):
    """True and false junctions by least depth: all, those the annotation knows, and the others."""
    named = annotation.classify(_true_false(spark, d), annotation.introns(A.transcripts(spark, d, FIRST)))
    h = gaps.capped_histogram(named.withColumn("known", F.col("class1") == annotation.CLASSES[0]), ["known", "is_true"], CAP)
    sets = h.withColumn("which", F.explode(F.array(F.lit("all"), F.when(F.col("known"), "known").otherwise("novel"))))
    sums = sets.groupBy("which", "is_true", "depth").agg(F.sum("junctions").alias("junctions"))
    return metrics.at_least(sums, ["which", "is_true"], "depth", ["junctions"])


@_query(f"""WITH {A.exons_sql()}, k AS (SELECT tx_id, chr, strand, string_agg(e || '-' || nxt, ':' ORDER BY s) AS key FROM (SELECT *, lead(s) OVER (PARTITION BY tx_id ORDER BY s, e) AS nxt FROM exons) WHERE nxt IS NOT NULL GROUP BY ALL)
    SELECT tx_id, min(tx_id) OVER (PARTITION BY chr, strand, key) AS pattern FROM k""")
def pattern_members(spark, d):
    return reconstruction.pattern_members(A.transcripts(spark, d))


@_query(f"""WITH {_EXON_ACCURACY} SELECT CAST(reference_known_met AS DOUBLE) / nullif(reference_known, 0) AS sensitivity_known, CAST(reference_met - reference_known_met AS DOUBLE) / nullif(reference - reference_known, 0) AS sensitivity_novel,
    CAST(correct - correct_known AS DOUBLE) / nullif(predicted - correct_known, 0) AS precision_novel FROM acc""")
def exon_novelty(spark, d):
    """Exon sensitivity for known and novel exons, and precision without what is right and known."""
    c, r = F.col, metrics.ratio
    return exon_accuracy(spark, d).select(
        r(c("reference_known_met"), c("reference_known")).alias("sensitivity_known"),
        r(c("reference_met") - c("reference_known_met"), c("reference") - c("reference_known")).alias("sensitivity_novel"),
        r(c("correct") - c("correct_known"), c("predicted") - c("correct_known")).alias("precision_novel"),
    )


@_query(f"WITH {A.READS_SQL} SELECT CAST(((frag * 3 + mate) % 41 + frag % 41) // 2 AS INTEGER) AS q, count(*) AS reads FROM reads GROUP BY ALL")
def quality_distribution(spark, d):
    """Reads by mean quality; the two halves of a read have qualities of their own."""
    made = A.reads(spark, d).selectExpr("concat(repeat(char(33 + (frag * 3 + mate) % 41), 38), repeat(char(33 + frag % 41), 38)) AS qual")
    return quality.quality_distribution(made)


@_query(f"""SELECT CAST(sum(CASE WHEN class <> 'NN' THEN fragments ELSE 0 END) AS DOUBLE) / sum(fragments) AS fragments_aligned,
    (CAST(sum(CASE WHEN class IN ('UU', 'MM', 'UM') THEN fragments ELSE 0 END) AS DOUBLE) + CAST(sum(CASE WHEN class IN ('UN', 'MN') THEN fragments ELSE 0 END) AS DOUBLE) / 2) / sum(fragments) AS reads_aligned FROM ({ORACLE_SQL['pair_yield']})""")
def pair_yield_total(spark, d):
    """Share of fragments with an aligned mate, and of reads: a fragment with one aligned mate counts half."""
    of = lambda *k: F.sum(F.when(F.col("class").isin(*k), F.col("fragments")).otherwise(0)).cast("double")
    both, one, all_ = of("UU", "MM", "UM"), of("UN", "MN"), F.sum("fragments")
    return pair_yield(spark, d).agg(metrics.ratio(both + one, all_).alias("fragments_aligned"), metrics.ratio(both + one / 2, all_).alias("reads_aligned"))
