"""Reports with a row for every size or number up to the largest, in both categories, and reports by class, novelty and tertile."""

from __future__ import annotations

from pyspark.sql import functions as F

from junctura.operators import accuracy, metrics, submissions
from junctura.plans import adapters as A
from junctura.plans.queries import _LONG, _ONE, _PROFILE, FIRST, SECOND, _classed, _query, pos_profile
from junctura.plans.scoring import ANNOTATED
from junctura.plans.grading import _chains

EVENTS = ("correct", "missed", "wrong")
_INDEL_COLUMNS = tuple(f"{c}_{k}_{e}" for c in ("uni", "amb") for k in ("del", "ins") for e in EVENTS)
_MULTI_COLUMNS = tuple(f"{c}_{u}_{w}" for c in ("uni", "amb") for u in ("read", "pair") for w in ("actual", "reported", "correct"))


def _filled(long, columns):
    """A row for each i from 0 to the largest and a column for each name, zeros where there is nothing. As many rows as sizes."""
    return metrics.dense(metrics.wide(long, ["i"], "name", columns, "n"), "i", list(columns))


def _filled_sql(columns) -> str:
    cells = ", ".join(f"CAST(coalesce(sum(CASE WHEN name = '{c}' THEN n END), 0) AS BIGINT) AS {c}" for c in columns)
    return f"spine AS (SELECT CAST(unnest(range((SELECT max(i) FROM long) + 1)) AS BIGINT) AS i) SELECT spine.i, {cells} FROM spine LEFT JOIN long ON long.i = spine.i GROUP BY spine.i"


_CAT = "CASE WHEN amb THEN 'amb' ELSE 'uni' END"


def _category():
    return F.when(F.col("amb"), "amb").otherwise("uni")


_INDELS_SQL = f"""{A.READS_SQL}, {A.REPORT_SQL}, {A.ops_sql('top', 'reads')}, {A.ops_sql('rop', 'report')},
    ti AS (SELECT frag, mate, amb, chr, CASE WHEN op = 'I' THEN 'ins' ELSE 'del' END AS op, q, t, l FROM top WHERE (op = 'I' OR {A.SHORT_GAP}) AND i > 0 AND i < n - 1),
    ri AS (SELECT frag, mate, amb AS r_amb, chr, CASE WHEN op = 'I' THEN 'ins' ELSE 'del' END AS op, q, t, l FROM rop WHERE (op = 'I' OR {A.SHORT_GAP}) AND i > 0 AND i < n - 1),
    ev AS (SELECT coalesce(amb, r_amb) AS amb, op, l, CASE WHEN r_amb IS NULL THEN 'missed' WHEN amb IS NULL THEN 'wrong' ELSE 'correct' END AS event FROM ti FULL JOIN ri USING (frag, mate, chr, op, q, t, l)),
    long AS (SELECT l AS i, concat({_CAT}, '_', op, '_', event) AS name, count(*) AS n FROM ev GROUP BY ALL)"""


@_query(f"WITH {_INDELS_SQL}, {_filled_sql(_INDEL_COLUMNS)}")
def indel_table(spark, d):
    """Deletions and insertions by size, right, missed and wrong, of unique and ambiguous reads: a row for every size from 0."""
    c = accuracy.indel_accuracy(A.reads(spark, d), A.report(spark, d), ambiguity=True)
    long = c.unpivot(["amb", "kind", "size"], list(EVENTS), "event", "n")
    name = F.concat_ws("_", _category(), F.when(F.col("kind") == "I", "ins").otherwise("del"), "event")
    return _filled(long.select(F.col("size").alias("i"), name.alias("name"), "n"), _INDEL_COLUMNS)


def _units(unit: str, by: str) -> str:
    """SQL for counts of units by their introns: rows of i, name, n."""
    minus = "(flag & 16) <> 0" if unit == "read" else "false"
    return f"""{unit}_t AS (SELECT DISTINCT {by}, chr, {minus} AS minus, start, len FROM tlong), {unit}_r AS (SELECT DISTINCT {by}, chr, {minus} AS minus, start, len FROM rlong), {unit}_u AS (SELECT {by}, max(amb) AS amb FROM reads GROUP BY {by}),
    {unit}_k AS (SELECT amb, coalesce(a.k, 0) AS actual, coalesce(r.k, 0) AS reported, coalesce(c.k, 0) AS correct FROM {unit}_u LEFT JOIN (SELECT {by}, count(*) AS k FROM {unit}_t GROUP BY ALL) a USING ({by}) LEFT JOIN (SELECT {by}, count(*) AS k FROM {unit}_r GROUP BY ALL) r USING ({by})
        LEFT JOIN (SELECT {by}, count(*) AS k FROM {unit}_t JOIN {unit}_r USING ({by}, chr, minus, start, len) GROUP BY ALL) c USING ({by}))"""


_MULTI_LONG = " UNION ALL ".join(f"SELECT {w} AS i, concat({_CAT}, '_{u}_{w}') AS name, count(*) AS n FROM {u}_k GROUP BY ALL" for u in ("read", "pair") for w in ("actual", "reported", "correct"))


@_query(f"WITH {_LONG}, {_units('read', 'frag, mate')}, {_units('pair', 'frag')}, long AS ({_MULTI_LONG}), {_filled_sql(_MULTI_COLUMNS)}")
def multi_intron_table(spark, d):
    """Reads and pairs by their true, reported and right introns, of unique and ambiguous fragments: a row for every number from 0."""
    long = None
    for unit, by in (("read", ["frag", "mate"]), ("pair", ["frag"])):
        c = accuracy.multi_intron(A.reads(spark, d), A.report(spark, d), by, ambiguity=True).unpivot(["amb", "k"], ["actual", "reported", "correct"], "what", "n")
        one = c.select(F.col("k").alias("i"), F.concat_ws("_", _category(), F.lit(unit), "what").alias("name"), "n")
        long = one if long is None else long.union(one)
    return _filled(long, _MULTI_COLUMNS)


@_query(f"WITH {_ONE} SELECT len, class, count(*) AS junctions, CAST(sum(reads) AS BIGINT) AS reads FROM c1 GROUP BY ALL")
def intron_size_by_class(spark, d):
    """Sizes of introns in reads, by the class of the junction."""
    return _classed(spark, d, FIRST, "class").groupBy("len", "class").agg(F.count("*").alias("junctions"), F.sum("reads").alias("reads"))


@_query(f"WITH {A.exons_sql('e1', FIRST)}, {A.exons_sql('e3', ANNOTATED)}, {_chains('c1', 'e1')}, {_chains('c3', 'e3')}, ref AS (SELECT *, row_number() OVER (ORDER BY chr, strand, introns) AS id FROM (SELECT DISTINCT chr, strand, introns, key FROM c1)) SELECT id, CAST(EXISTS (SELECT 1 FROM c3 WHERE c3.chr = ref.chr AND c3.strand = ref.strand AND c3.key = ref.key) AS INTEGER) AS known FROM ref")
def pattern_flags(spark, d):
    """Which patterns of the reference an annotation knows: a flag for every id."""
    ref = submissions.reference_patterns(A.transcripts(spark, d, FIRST))
    return submissions.known_flags(ref, A.transcripts(spark, d, ANNOTATED))


@_query(f"WITH {_PROFILE}, total AS (SELECT count(*) AS n FROM reads) SELECT pos, " + ", ".join(f"100 * (CAST({c} AS DOUBLE) / n) AS {c}" for c in ("introns", "deletions", "insertions")) + " FROM profile, total")
def pos_profile_percent(spark, d):
    """The profile along the read in per cent of the reads."""
    total = A.reads(spark, d).agg(F.count("*").alias("n"))
    return pos_profile(spark, d).join(F.broadcast(total), how="cross").select("pos", *[metrics.percent(F.col(c), F.col("n"), 1e9).alias(c) for c in ("introns", "deletions", "insertions")])  # one row


@_query(f"""WITH {A.exons_sql('e1', FIRST)}, {A.exons_sql('e2', SECOND)}, {A.exons_sql('e3', ANNOTATED)}, {_chains('c1', 'e1')}, {_chains('c2', 'e2')}, {_chains('c3', 'e3')},
    x AS (SELECT p_retailprice AS v, EXISTS (SELECT 1 FROM c2 WHERE c2.chr = c1.chr AND c2.strand = c1.strand AND c2.key = c1.key) AS found, EXISTS (SELECT 1 FROM c3 WHERE c3.chr = c1.chr AND c3.strand = c1.strand AND c3.key = c1.key) AS known FROM c1 JOIN part ON p_partkey = tx_id),
    q AS (SELECT quantile_cont(v, 1.0 / 3) AS a, quantile_cont(v, 2.0 / 3) AS b FROM x)
    SELECT CASE WHEN v <= a THEN 1 WHEN v <= b THEN 2 ELSE 3 END AS tertile, known, count(*) AS transcripts, CAST(count(CASE WHEN found THEN 1 END) AS DOUBLE) / count(*) AS sensitivity FROM x, q GROUP BY ALL""")
def sensitivity_by_tertile_and_novelty(spark, d):
    """Share of the reference's spliced transcripts that are predicted, by tertile of expression crossed with whether the annotation knows their pattern."""
    from junctura.operators.reconstruction import chains

    key = ["chr", "strand", "introns"]
    of = lambda rows, name: chains(A.transcripts(spark, d, rows)).select(*key).distinct().withColumn(name, F.lit(True))
    level = A._table(spark, d, "part").select(F.col("p_partkey").alias("tx_id"), F.col("p_retailprice").alias("v"))
    x = chains(A.transcripts(spark, d, FIRST)).join(level, "tx_id")
    low, high = metrics.quantiles(x, "v", [1 / 3, 2 / 3])
    told = x.join(of(SECOND, "found"), key, "left").join(of(ANNOTATED, "known"), key, "left")
    return told.groupBy(metrics.tertile(F.col("v"), F.lit(low), F.lit(high)).alias("tertile"), F.coalesce("known", F.lit(False)).alias("known")).agg(F.count("*").alias("transcripts"), metrics.ratio(F.count("found"), F.count("*")).alias("sensitivity"))
