"""Queries over several predicted sets: the match matrix, reports of sets, all alignments against primary ones, levels of splice forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from junctura.operators import metrics, reconstruction, submissions
from junctura.plans import adapters as A
from junctura.plans.queries import FIRST, _query
from junctura.plans.scoring import ANNOTATED

#: Three sets of predictions, each from all and from primary reads only; the last one is empty. Some transcripts have no strand, some an exon less.
SETS = ("ace", "bee", "cow")
_ROWS = "(m = 'ace' AND p_partkey % 10 > 3 OR m = 'bee' AND p_partkey % 10 IN (0, 2, 5, 8, 9)) AND (k = 'all' OR p_partkey % 4 <> 2)"
PREDICTED = {
    "method": "m", "reads": "k", **A.EXON,
    "strand": "CASE WHEN p_partkey % 12 = 5 THEN '.' WHEN m = 'bee' AND p_partkey % 10 = 9 THEN CASE WHEN p_partkey % 3 = 0 THEN '+' ELSE '-' END WHEN p_partkey % 3 = 0 THEN '-' ELSE '+' END",
}
_SHORTER = "NOT (m = 'bee' AND p_partkey % 20 = 15 AND x = 2)"


def _predicted(spark, d):
    part = A._table(spark, d, "part").select("p_partkey", F.explode(F.array(*map(F.lit, range(3)))).alias("x")).where(A.EXON_ROWS)
    sets = part.select("*", F.explode(F.array(*map(F.lit, SETS))).alias("m")).select("*", F.explode(F.array(F.lit("all"), F.lit("pri"))).alias("k"))
    e = A._select(sets.where(f"({_ROWS}) AND {_SHORTER}"), PREDICTED)
    return e.groupBy("method", "reads", "tx_id", "gene_id", "chr", "strand").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("exons"))


def _sets(spark):
    return spark.createDataFrame([(m, k) for m in SETS for k in ("all", "pri")], "method string, reads string")


def _report(spark, d, stranded):
    return submissions.report(A.transcripts(spark, d, FIRST), _predicted(spark, d), _sets(spark), ["method", "reads"], A.transcripts(spark, d, ANNOTATED), stranded)


def _typed(name: str, source: str, by: str = "") -> str:
    return f"{name} AS (SELECT DISTINCT {by} chr, strand, s, e, CASE WHEN n = 1 THEN 'single' WHEN i = 1 THEN 'first' WHEN i = n THEN 'last' ELSE 'internal' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY {by} tx_id ORDER BY s, e) AS i, count(*) OVER (PARTITION BY {by} tx_id) AS n FROM {source}))"


def _chains(name: str, source: str, by: str = "") -> str:
    return f"{name} AS (SELECT {by} tx_id, chr, strand, list({{'left': e, 'right': nxt}} ORDER BY s) AS introns, ':' || string_agg(e || '-' || nxt, ':' ORDER BY s) || ':' AS key FROM (SELECT *, lead(s) OVER (PARTITION BY {by} tx_id ORDER BY s, e) AS nxt FROM {source}) WHERE nxt IS NOT NULL GROUP BY {by} tx_id, chr, strand)"


def _sql(stranded: bool) -> str:
    same = "p.strand = r.strand" if stranded else "true"
    agrees = lambda p, r: f"{p}.chr = {r}.chr AND {p}.s <= {r}.e AND {p}.e >= {r}.s AND {f'{p}.strand = {r}.strand' if stranded else 'true'} AND CASE {r}.kind WHEN 'single' THEN least({p}.e, {r}.e) - greatest({p}.s, {r}.s) + 1 >= 0.6 * ({r}.e - {r}.s) WHEN 'internal' THEN {p}.s = {r}.s AND {p}.e = {r}.e WHEN 'first' THEN {p}.e = {r}.e ELSE {p}.s = {r}.s END"
    usable = "WHERE strand <> '.'" if stranded else ""
    return f"""{A.exons_sql('e1', FIRST)}, {A.exons_sql('e3', ANNOTATED)},
    e2 AS (SELECT {A._sql(PREDICTED)} FROM part CROSS JOIN (VALUES (0), (1), (2)) a(x) CROSS JOIN (VALUES {', '.join(f"('{m}')" for m in SETS)}) b(m) CROSS JOIN (VALUES ('all'), ('pri')) c(k) WHERE ({A.EXON_ROWS}) AND ({_ROWS}) AND {_SHORTER}),
    used AS (SELECT * FROM e2 {usable}), sets AS (SELECT * FROM (VALUES {', '.join(f"('{m}')" for m in SETS)}) b(method) CROSS JOIN (VALUES ('all'), ('pri')) c(reads)),
    {_chains('c1', 'e1')}, {_chains('c2', 'used', 'method, reads,')},
    ref AS (SELECT *, row_number() OVER (ORDER BY chr, strand, introns) AS pattern_id FROM (SELECT DISTINCT chr, strand, introns, key FROM c1)),
    pred AS (SELECT DISTINCT method, reads, chr, strand, introns, key FROM c2),
    ri AS (SELECT *, unnest(introns) AS j FROM ref), pi AS (SELECT *, unnest(introns) AS j FROM pred),
    met AS (SELECT DISTINCT p.method, p.reads, p.chr, p.strand, p.key, r.pattern_id, CASE WHEN p.key = r.key THEN 3 WHEN contains(r.key, p.key) THEN 2 ELSE 1 END AS hit FROM pi p JOIN ri r ON p.chr = r.chr AND p.j = r.j AND {same}),
    best AS (SELECT method, reads, pattern_id, max(hit) AS hit FROM met GROUP BY ALL),
    matrix AS (SELECT s.method, s.reads, r.pattern_id, coalesce(hit, 0) AS hit FROM sets s CROSS JOIN ref r LEFT JOIN best USING (method, reads, pattern_id)),
    rt AS (SELECT method, reads, count(*) AS ref_tx, count(CASE WHEN hit = 3 THEN 1 END) AS ref_tx_corr, count(CASE WHEN hit = 2 THEN 1 END) AS ref_tx_part, count(CASE WHEN hit = 1 THEN 1 END) AS ref_tx_wrong FROM matrix GROUP BY ALL),
    ph AS (SELECT p.method, p.reads, p.key, p.chr, p.strand, coalesce(max(hit), 0) AS hit FROM pred p LEFT JOIN met USING (method, reads, chr, strand, key) GROUP BY ALL),
    pt AS (SELECT method, reads, count(*) AS pred_tx, count(CASE WHEN hit = 3 THEN 1 END) AS pred_tx_corr, count(CASE WHEN hit = 2 THEN 1 END) AS pred_tx_part, count(CASE WHEN hit = 1 THEN 1 END) AS pred_tx_wrong FROM ph GROUP BY ALL),
    {_typed('x1', 'e1')}, {_typed('x3', 'e3')}, k1 AS (SELECT r.*, EXISTS (SELECT 1 FROM x3 a WHERE {agrees('r', 'a')}) AS known FROM x1 r),
    px AS (SELECT DISTINCT method, reads, chr, strand, s, e FROM used),
    pe AS (SELECT method, reads, count(*) AS pred_exons, count(CASE WHEN EXISTS (SELECT 1 FROM k1 r WHERE {agrees('p', 'r')}) THEN 1 END) AS pred_exons_corr, count(CASE WHEN EXISTS (SELECT 1 FROM k1 r WHERE r.known AND {agrees('p', 'r')}) THEN 1 END) AS pred_exons_corr_known FROM px p GROUP BY ALL),
    re AS (SELECT s.method, s.reads, count(*) AS ref_exons, count(CASE WHEN r.known THEN 1 END) AS ref_exons_known, count(CASE WHEN EXISTS (SELECT 1 FROM px p WHERE p.method = s.method AND p.reads = s.reads AND {agrees('p', 'r')}) THEN 1 END) AS ref_exons_corr,
        count(CASE WHEN r.known AND EXISTS (SELECT 1 FROM px p WHERE p.method = s.method AND p.reads = s.reads AND {agrees('p', 'r')}) THEN 1 END) AS ref_exons_corr_known FROM sets s CROSS JOIN k1 r GROUP BY ALL),
    stats AS (SELECT method, reads, ref_tx, ref_tx_corr, ref_tx_part, ref_tx_wrong, coalesce(pred_tx, 0) AS pred_tx, coalesce(pred_tx_corr, 0) AS pred_tx_corr, coalesce(pred_tx_part, 0) AS pred_tx_part, coalesce(pred_tx_wrong, 0) AS pred_tx_wrong,
        ref_exons, ref_exons_known, ref_exons_corr, ref_exons_corr_known, coalesce(pred_exons, 0) AS pred_exons, coalesce(pred_exons_corr, 0) AS pred_exons_corr, coalesce(pred_exons_corr_known, 0) AS pred_exons_corr_known
        FROM rt JOIN re USING (method, reads) LEFT JOIN pt USING (method, reads) LEFT JOIN pe USING (method, reads))"""


_WIDE = ", ".join(f"max(CASE WHEN method = '{m}' THEN hit END) AS {m}" for m in SETS)


@_query(f"WITH {_sql(True)} SELECT pattern_id, {_WIDE} FROM matrix WHERE reads = 'all' GROUP BY pattern_id")
def match_matrix(spark, d):
    """Every pattern of the reference by every submission, the empty one too: the best grade of a prediction."""
    p = submissions.reference_patterns(A.transcripts(spark, d, FIRST))
    by = ["method", "reads"]
    long = submissions.matrix(p, submissions.matches(p, _predicted(spark, d), by), _sets(spark), by)
    return submissions.matrix_wide(long.where("reads = 'all'"), "method")


@_query(f"WITH {_sql(True)} SELECT * FROM stats")
def submission_report(spark, d):
    """What of each set is right, by transcripts and exons; strands must agree."""
    return _report(spark, d, (True, True))


@_query(f"WITH {_sql(False)} SELECT * FROM stats")
def submission_report_unstranded(spark, d):
    """The same where strands need not agree, predictions without one among them."""
    return _report(spark, d, (False, False))


_RATES = {"tx_sens": ("ref_tx_corr", "ref_tx"), "tx_prec": ("pred_tx_corr", "pred_tx"), "exon_sens": ("ref_exons_corr", "ref_exons"), "exon_prec": ("pred_exons_corr", "pred_exons")}
_SIDES = ", ".join(f"max(CASE WHEN reads = '{k}' THEN {c} END) AS {c}_{k}" for c in _RATES for k in ("all", "pri")) + ", " + ", ".join(f"max(CASE WHEN reads = 'pri' THEN {c} END) - max(CASE WHEN reads = 'all' THEN {c} END) AS {c}_more" for c in _RATES)


@_query(f"WITH {_sql(True)}, rated AS (SELECT *, " + ", ".join(f"CAST({a} AS DOUBLE) / nullif({b}, 0) AS {c}" for c, (a, b) in _RATES.items()) + f" FROM stats) SELECT method, {_SIDES} FROM rated GROUP BY method")
def primary_against_all(spark, d):
    """Sensitivity and precision of transcripts and exons built from all and from primary reads, side by side; both kinds are graded in one plan."""
    return submissions.compared(_report(spark, d, (True, True)), ["method"], "reads", "all", "pri")


@_query(f"WITH {A.exons_sql()}, {_chains('c', 'exons')}, n AS (SELECT tx_id, dense_rank() OVER (ORDER BY chr, strand, introns) AS pattern_id FROM c) SELECT pattern_id, count(*) AS transcripts, coalesce(sum(CAST(p_size AS DOUBLE)), 0) AS level FROM n LEFT JOIN part ON p_partkey = tx_id GROUP BY pattern_id")
def level_by_pattern(spark, d):
    """The level of expression of each splice form, summed over its transcripts; the size of a part stands for the level."""
    level = A._table(spark, d, "part").select(F.col("p_partkey").alias("tx_id"), F.col("p_size").cast("double").alias("level"))
    return submissions.summed_by_pattern(reconstruction.pattern_ids(A.transcripts(spark, d)), level, "level")


@_query(f"WITH {_sql(True)}, hits AS (SELECT unnest(range(4)) AS hit) SELECT hits.hit, count(m.hit) AS n FROM hits LEFT JOIN matrix m ON m.hit = hits.hit GROUP BY hits.hit")
def hit_histogram(spark, d):
    """How often the match matrix holds each grade, from 0 to 3."""
    p = submissions.reference_patterns(A.transcripts(spark, d, FIRST))
    by = ["method", "reads"]
    long = submissions.matrix(p, submissions.matches(p, _predicted(spark, d), by), _sets(spark), by)
    return metrics.histogram(long, "hit", 3)
