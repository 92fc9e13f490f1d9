"""Named queries over the operators on aligned reads, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from junctura.functions import cigar, tags
from junctura.operators import accuracy, annotation, gaps, intervals, metrics
from junctura.plans import adapters as A

QUERIES, ORACLE_SQL = {}, {}
CAP = 10
FIRST, SECOND = "p_partkey % 10 < 6", "p_partkey % 10 > 3"


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _hist(by: str, source: str) -> str:
    return ", ".join([f"CAST(coalesce(sum(reads), 0) AS BIGINT) AS reads"] + [f"count(CASE WHEN reads IS NOT NULL AND least(reads, {CAP}) = {k} THEN 1 END) AS n{k}" for k in range(1, CAP + 1)])


_CLASSES = "classes(class) AS (VALUES " + ", ".join(f"('{c}')" for c in annotation.CLASSES) + ")"


def _classify(name: str, splices: str) -> str:
    return f"""{name} AS (SELECT j.*, CASE
        WHEN EXISTS (SELECT 1 FROM {splices} s WHERE s.chr = j.chr AND s.lft = j.start - 1 AND s.rgt = j.start + j.len) THEN 'Known splice'
        WHEN EXISTS (SELECT 1 FROM {splices} s JOIN {splices} r ON s.gene_id = r.gene_id AND s.chr = r.chr WHERE s.chr = j.chr AND s.lft = j.start - 1 AND r.rgt = j.start + j.len) THEN 'Same gene'
        WHEN EXISTS (SELECT 1 FROM {splices} s WHERE s.chr = j.chr AND s.lft = j.start - 1) AND EXISTS (SELECT 1 FROM {splices} s WHERE s.chr = j.chr AND s.rgt = j.start + j.len) THEN 'Different genes'
        WHEN EXISTS (SELECT 1 FROM {splices} s WHERE s.chr = j.chr AND s.lft = j.start - 1) OR EXISTS (SELECT 1 FROM {splices} s WHERE s.chr = j.chr AND s.rgt = j.start + j.len) THEN 'One novel'
        ELSE 'Both novel' END AS class FROM junctions j)"""


_ONE = f"{A.JUNCTIONS_SQL}, {A.exons_sql('e1', FIRST)}, {A.splices_sql('s1', 'e1')}, {_classify('c1', 's1')}"


def _junctions(spark, d):
    return gaps.junction_counts(A.reads(spark, d))


def _classed(spark, d, rows=FIRST, name="class"):
    return annotation.classify(_junctions(spark, d), annotation.introns(A.transcripts(spark, d, rows)), name)


@_query(f"WITH {A.JUNCTIONS_SQL} SELECT least(reads, 10) AS depth, count(*) AS junctions FROM junctions GROUP BY ALL")
def junction_depth_hist(spark, d):
    return gaps.capped_histogram(_junctions(spark, d), [], CAP)


@_query(f"WITH {A.JUNCTIONS_SQL} SELECT chr, start - 1 AS left_base, start + len AS right_base, reads FROM junctions")
def junction_coverage(spark, d):
    return _junctions(spark, d).select("chr", (F.col("start") - 1).alias("left_base"), (F.col("start") + F.col("len")).alias("right_base"), "reads")


@_query(f"WITH {A.JUNCTIONS_SQL} SELECT len, count(*) AS junctions, CAST(sum(reads) AS BIGINT) AS reads FROM junctions GROUP BY ALL")
def intron_size_hist(spark, d):
    return _junctions(spark, d).groupBy("len").agg(F.count("*").alias("junctions"), F.sum("reads").alias("reads"))


_CLASS = """CASE WHEN op IN ('D', 'I', 'S') AND (CASE WHEN (flag & 16) <> 0 THEN i = n - 1 ELSE i = 0 END) THEN op || '0'
    WHEN op IN ('D', 'I', 'S') AND (CASE WHEN (flag & 16) <> 0 THEN i = 0 ELSE i = n - 1 END) THEN op || '1'
    WHEN i > 0 AND i < n - 1 AND op IN ('D', 'I', 'N') THEN op END"""


@_query(f"WITH {A.READS_SQL}, {A.ops_sql('ops', 'reads')} SELECT class, l AS size, count(*) AS n FROM (SELECT {_CLASS} AS class, l FROM ops) WHERE class IS NOT NULL GROUP BY ALL")
def op_size_distribution(spark, d):
    return gaps.size_distribution(A.reads(spark, d))


@_query(f"""WITH {A.READS_SQL}, {A.ops_sql('ops', 'reads')}, k AS (SELECT frag, mate, o.op, count(CASE WHEN ops.op = o.op AND i > 0 AND i < n - 1 THEN 1 END) AS k FROM ops CROSS JOIN (VALUES ('D'), ('I'), ('N')) o(op) GROUP BY ALL)
    SELECT op, CAST(k AS INTEGER) AS k, count(*) AS reads FROM k GROUP BY ALL""")
def op_count_per_read(spark, d):
    return gaps.counts_per_read(A.reads(spark, d))


@_query(f"WITH {A.exons_sql()}, {A.splices_sql('s', 'exons')} SELECT size, count(*) AS introns FROM (SELECT DISTINCT chr, lft, rgt, rgt - lft - 1 AS size FROM s) GROUP BY ALL")
def annotated_intron_sizes(spark, d):
    s = annotation.introns(A.transcripts(spark, d)).select("chr", "left", "right").distinct()
    return s.groupBy((F.col("right") - F.col("left") - 1).alias("size")).agg(F.count("*").alias("introns"))


@_query(f"WITH {_ONE}, {_CLASSES} SELECT class, {_hist('class', 'c1')} FROM classes LEFT JOIN c1 USING (class) GROUP BY class")
def intron_class_one_index(spark, d):
    classes = spark.createDataFrame([(c,) for c in annotation.CLASSES], "class string")
    return gaps.pivoted_histogram(_classed(spark, d), classes, ["class"], CAP)


@_query(f"""WITH {_ONE}, {A.exons_sql('e2', SECOND)}, {A.splices_sql('s2', 'e2')}, {_classify('c2', 's2')}, {_CLASSES},
    both_ AS (SELECT c1.class AS class1, c2.class AS class2, c1.reads FROM c1 JOIN c2 USING (chr, start, len)),
    pairs AS (SELECT a.class AS class1, b.class AS class2 FROM classes a CROSS JOIN classes b)
    SELECT class1, class2, {_hist('', '')} FROM pairs LEFT JOIN both_ USING (class1, class2) GROUP BY class1, class2""")
def intron_class_two_index(spark, d):
    two = annotation.classify(_classed(spark, d, FIRST, "class1"), annotation.introns(A.transcripts(spark, d, SECOND)), "class2")
    classes = spark.createDataFrame([(a, b) for a in annotation.CLASSES for b in annotation.CLASSES], "class1 string, class2 string")
    return gaps.pivoted_histogram(two, classes, ["class1", "class2"], CAP)


@_query(f"""WITH {_ONE}, h AS (SELECT class = 'Known splice' AS known, least(reads, {CAP}) AS depth, count(*) AS junctions FROM c1 GROUP BY ALL)
    SELECT known, depth, CAST(sum(junctions) OVER (PARTITION BY known ORDER BY depth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS junctions FROM h""")
def known_vs_novel_curve(spark, d):
    known = _classed(spark, d).withColumn("known", F.col("class") == "Known splice")
    return metrics.at_least(gaps.capped_histogram(known, ["known"], CAP), ["known"], "depth", ["junctions"])


_TRUE_FALSE = f"""{A.JUNCTIONS_SQL}, {A.REPORT_SQL}, {A.ops_sql('rops', 'report')}, {A.introns_sql('rgap', 'rops')}, found AS (SELECT chr, start, len, count(*) AS reads FROM rgap GROUP BY ALL),
    named AS (SELECT f.*, j.reads IS NOT NULL AS is_true FROM found f LEFT JOIN junctions j USING (chr, start, len))"""


def _true_false(spark, d):
    truth = _junctions(spark, d).select("chr", "start", "len", F.lit(True).alias("hit"))
    return gaps.junction_counts(A.report(spark, d)).join(truth, ["chr", "start", "len"], "left").select("chr", "start", "len", "reads", F.col("hit").isNotNull().alias("is_true"))


@_query(f"""WITH {_TRUE_FALSE}, h AS (SELECT is_true, least(reads, {CAP}) AS depth, count(*) AS junctions FROM named GROUP BY ALL)
    SELECT is_true, depth, CAST(sum(junctions) OVER (PARTITION BY is_true ORDER BY depth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS junctions FROM h""")
def true_false_curve(spark, d):
    return metrics.at_least(gaps.capped_histogram(_true_false(spark, d), ["is_true"], CAP), ["is_true"], "depth", ["junctions"])


_INC = f"{_TRUE_FALSE}, {A.exons_sql()}, {A.splices_sql('s', 'exons')}, inc AS (SELECT n.*, EXISTS (SELECT 1 FROM s WHERE s.chr = n.chr AND s.lft = n.start - 1 AND s.rgt = n.start + n.len) AS predicted FROM named n)"


def _incorporated(spark, d):
    s = annotation.introns(A.transcripts(spark, d)).select("chr", (F.col("left") + 1).alias("start"), (F.col("right") - F.col("left") - 1).alias("len"), F.lit(True).alias("p")).distinct()
    return _true_false(spark, d).join(s, ["chr", "start", "len"], "left").withColumn("predicted", F.col("p").isNotNull()).drop("p")


@_query(f"WITH {_INC} SELECT is_true, predicted, least(reads, {CAP}) AS depth, count(*) AS junctions FROM inc GROUP BY ALL")
def junction_incorporation(spark, d):
    return gaps.capped_histogram(_incorporated(spark, d), ["is_true", "predicted"], CAP)


@_query(f"WITH {_INC} SELECT is_true, CAST(count(CASE WHEN predicted THEN 1 END) AS DOUBLE) / nullif(count(*), 0) AS rate FROM inc GROUP BY ALL")
def incorporation_rate(spark, d):
    return _incorporated(spark, d).groupBy("is_true").agg(metrics.ratio(F.count(F.when(F.col("predicted"), 1)), F.count("*")).alias("rate"))


@_query(f"""WITH {A.READS_SQL}, {A.ops_sql('ops', 'reads')}, x AS (SELECT frag, mate, sum(CASE WHEN op IN ('M', 'D', 'N') THEN l ELSE 0 END) AS span, sum(CASE WHEN op IN ('M', 'I', 'S') THEN l ELSE 0 END) AS qlen FROM ops GROUP BY ALL)
    SELECT CAST(span AS INTEGER) AS span, CAST(qlen AS INTEGER) AS qlen, count(*) AS reads FROM x GROUP BY ALL""")
def span_and_query_length(spark, d):
    r = A.reads(spark, d).select(cigar.target_span(F.col("cigar")).alias("span"), cigar.query_length(F.col("cigar")).alias("qlen"))
    return r.groupBy("span", "qlen").agg(F.count("*").alias("reads"))


def _union_sql(name: str, source: str) -> str:
    return f"""{name}_a AS (SELECT DISTINCT chr, s, e FROM {source}),
        {name}_b AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM {name}_a),
        {name}_c AS (SELECT *, sum(new) OVER (PARTITION BY chr ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM {name}_b),
        {name} AS (SELECT chr, min(s) AS s, max(e) AS e FROM {name}_c GROUP BY chr, island)"""


@_query(f"WITH {A.REPEATS_SQL}, {_union_sql('u', 'repeats')} SELECT chr, s, e FROM u")
def interval_union(spark, d):
    return intervals.union(A.repeats(spark, d))


@_query(f"WITH {A.REPEATS_SQL}, {_union_sql('u', 'repeats')}, g AS (SELECT chr, e + 1 AS s, lead(s) OVER (PARTITION BY chr ORDER BY s) - 1 AS e FROM u) SELECT chr, s, e FROM g WHERE e >= s")
def interval_complement(spark, d):
    return intervals.gaps(intervals.union(A.repeats(spark, d)))


def _territory(rows: str) -> str:
    return f"""{A.exons_sql('ex', rows)}, spans AS (SELECT chr, min(s) AS s, max(e) AS e FROM ex GROUP BY tx_id, chr), {_union_sql('genic', 'spans')},
    bases AS (SELECT chr, unnest(range(s, e + 1)) AS b FROM genic), inside AS (SELECT DISTINCT chr, unnest(range(s, e + 1)) AS b FROM ex),
    free AS (SELECT chr, b FROM bases EXCEPT SELECT chr, b FROM inside),
    runs AS (SELECT chr, b, b - row_number() OVER (PARTITION BY chr ORDER BY b) AS g FROM free),
    territory AS (SELECT chr, CAST(min(b) AS INTEGER) AS s, CAST(max(b) AS INTEGER) AS e FROM runs GROUP BY chr, g)"""


@_query(f"WITH {_territory('true')} SELECT chr, s, e FROM territory")
def intron_territory(spark, d):
    return intervals.intron_territory(A.exons(spark, d))


@_query(f"WITH {_territory('true')} SELECT chr, s, e FROM territory")
def intron_territory_whole(spark, d):
    return intervals.intron_territory(A.exons(spark, d))


@_query(f"""WITH {A.REPEATS_SQL}, {_union_sql('u', 'repeats')}, {A.exons_sql()}, w AS (SELECT tx_id, min(s) AS s, max(e) AS e, chr FROM exons GROUP BY tx_id, chr)
    SELECT w.tx_id, w.s, w.e, CAST(coalesce(sum(CASE WHEN u.s IS NOT NULL THEN least(w.e, u.e) - greatest(w.s, u.s) + 1 END), 0) AS BIGINT) AS covered FROM w LEFT JOIN u ON u.chr = w.chr AND u.s <= w.e AND u.e >= w.s GROUP BY ALL""")
def overlap_length(spark, d):
    w = A.exons(spark, d).groupBy("tx_id", "chr").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return intervals.covered(w, ["tx_id"], intervals.union(A.repeats(spark, d)))


_VERDICT = f"""{A.READS_SQL}, {A.REPORT_SQL}, {A.ops_sql('top', 'reads')}, {A.ops_sql('rop', 'report')},
    tb AS (SELECT frag, mate, q + k AS j, CASE op WHEN 'I' THEN 2 * t - 1 WHEN 'M' THEN 2 * (t + k) END AS c FROM (SELECT *, unnest(range(l)) AS k FROM top WHERE op IN ('M', 'I', 'S'))),
    rb AS (SELECT frag, mate, q + k AS j, CASE op WHEN 'I' THEN 2 * t - 1 WHEN 'M' THEN 2 * (t + k) END AS c FROM (SELECT *, unnest(range(l)) AS k FROM rop WHERE op IN ('M', 'I', 'S'))),
    gapped AS (SELECT DISTINCT frag, mate FROM top WHERE {A.LONG_GAP} AND i > 0 AND i < n - 1),
    pair AS (SELECT r.frag, r.mate, r.amb, EXISTS (SELECT 1 FROM gapped g WHERE g.frag = r.frag AND g.mate = r.mate) AS spliced, (p.flag & 4) = 0 AS aligned,
        (p.flag & 4) = 0 AND r.chr = p.chr AND (r.flag & 16) = (p.flag & 16) AS same,
        (p.flag & 4) = 0 AND r.chr = p.chr AND (r.flag & 16) = (p.flag & 16) AND r.pos = p.pos AND r.cigar = p.cigar AS equal FROM reads r JOIN report p USING (frag, mate)),
    hits AS (SELECT frag, mate, count(*) AS n FROM tb JOIN rb USING (frag, mate, j) WHERE tb.c = rb.c GROUP BY ALL),
    placed AS (SELECT frag, mate, count(c) AS n FROM rb GROUP BY ALL),
    meets AS (SELECT DISTINCT tb.frag, tb.mate FROM tb JOIN rb ON tb.frag = rb.frag AND tb.mate = rb.mate AND tb.c = rb.c),
    v0 AS (SELECT pair.*, CASE WHEN equal THEN 76 WHEN same THEN coalesce(hits.n, 0) ELSE 0 END AS base_right, coalesce(placed.n, 0) AS placed_n, meets.frag IS NOT NULL AS met
        FROM pair LEFT JOIN hits USING (frag, mate) LEFT JOIN placed USING (frag, mate) LEFT JOIN meets USING (frag, mate)),
    v AS (SELECT *, CASE WHEN equal THEN 0 ELSE placed_n - base_right END AS base_wrong, CASE WHEN base_right = 76 THEN 'perfect' WHEN base_right > 0 THEN 'partial' WHEN same AND met THEN 'overlap' ELSE 'none' END AS verdict FROM v0),
    acc AS (SELECT amb, spliced, CAST(sum(base_right) AS BIGINT) AS bases_right, CAST(sum(base_wrong) AS BIGINT) AS bases_wrong, count(CASE WHEN aligned THEN 1 END) AS aln, count(CASE WHEN verdict = 'overlap' THEN 1 END) AS overlap,
        count(CASE WHEN verdict = 'partial' THEN 1 END) AS some_right, count(CASE WHEN verdict = 'perfect' THEN 1 END) AS perfect, count(*) AS total_reads FROM v GROUP BY ALL)"""


def _accuracy(spark, d):
    return accuracy.read_accuracy(accuracy.read_verdicts(accuracy.paired(A.reads(spark, d), A.report(spark, d)), A.LENGTH))


@_query(f"WITH {_VERDICT} SELECT * FROM acc")
def read_accuracy(spark, d):
    return _accuracy(spark, d)


def _sum(c):
    return F.sum(c)


@_query(f"""WITH {_VERDICT} SELECT spliced, CAST(sum(aln) AS DOUBLE) / nullif(sum(total_reads), 0) AS aligned, CAST(sum(perfect) AS DOUBLE) / nullif(sum(total_reads), 0) AS perfect,
    CAST(sum(bases_right) AS DOUBLE) / nullif(sum(total_reads) * 76, 0) AS bases FROM acc GROUP BY spliced""")
def accuracy_fractions(spark, d):
    r = lambda a, b: metrics.ratio(F.sum(a), b)
    return _accuracy(spark, d).groupBy("spliced").agg(r("aln", F.sum("total_reads")).alias("aligned"), r("perfect", F.sum("total_reads")).alias("perfect"), r("bases_right", F.sum("total_reads") * A.LENGTH).alias("bases"))


@_query(f"WITH {_VERDICT} SELECT spliced, CAST(sum(CASE WHEN amb THEN aln ELSE 0 END) AS DOUBLE) / nullif(sum(aln), 0) AS ambiguous FROM acc GROUP BY spliced")
def ambiguity_fractions(spark, d):
    return _accuracy(spark, d).groupBy("spliced").agg(metrics.ratio(F.sum(F.when(F.col("amb"), F.col("aln")).otherwise(0)), F.sum("aln")).alias("ambiguous"))


@_query(f"WITH {_VERDICT} SELECT amb, spliced, perfect, some_right, overlap, aln - perfect - some_right - overlap AS elsewhere, total_reads - aln AS unmapped FROM acc")
def placement_breakdown(spark, d):
    return _accuracy(spark, d).select("amb", "spliced", "perfect", "some_right", "overlap", (F.col("aln") - F.col("perfect") - F.col("some_right") - F.col("overlap")).alias("elsewhere"), (F.col("total_reads") - F.col("aln")).alias("unmapped"))


def _mirror(q: str, flag: str) -> str:
    return f"CASE WHEN ({flag} & 16) <> 0 THEN 76 - ({q}) - 2 ELSE {q} END"


_LONG = f"{_TRUE_FALSE}, {A.introns_sql('tlong', 'ops', A.LONG_GAP)}, {A.introns_sql('rlong', 'rops', A.LONG_GAP)}"
_EVENTS = f"""{_LONG},
    t AS (SELECT frag, mate, amb, chr, (flag & 16) <> 0 AS minus, start, len, {_mirror('q - 1', 'flag')} AS p FROM tlong),
    r AS (SELECT frag, mate, amb AS r_amb, chr, (flag & 16) <> 0 AS minus, start, len, {_mirror('q - 1', 'flag')} AS r_p FROM rlong),
    ev AS (SELECT chr, start, len, CASE WHEN r_p IS NULL THEN 'fn' WHEN p IS NULL THEN 'fp' ELSE 'tp' END AS event, coalesce(amb, r_amb) AS amb, CAST(coalesce(p, r_p) AS INTEGER) AS p FROM t FULL JOIN r USING (frag, mate, chr, minus, start, len)),
    events_ AS (SELECT event, amb, p, CAST(CASE WHEN reads IS NULL THEN 0 ELSE least(reads, 20) END AS BIGINT) AS coverage FROM ev LEFT JOIN junctions USING (chr, start, len))"""


def _events(spark, d):
    return accuracy.intron_events(A.reads(spark, d), A.report(spark, d), _junctions(spark, d), A.LENGTH)


@_query(f"WITH {_EVENTS} SELECT event, amb, p, coverage, count(*) AS introns FROM events_ GROUP BY ALL")
def intron_tp_fn_fp(spark, d):
    return _events(spark, d).groupBy("event", "amb", "p", "coverage").agg(F.count("*").alias("introns"))


@_query(f"""WITH {_EVENTS}, band AS (SELECT unnest(range(1, 31)) AS i), h AS (SELECT p, event, count(*) AS n FROM events_ GROUP BY ALL)
    SELECT CAST(i AS INTEGER) AS i, CAST(sum(CASE WHEN event = 'tp' THEN n ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN event IN ('tp', 'fn') THEN n ELSE 0 END), 0) AS recall,
    CAST(sum(CASE WHEN event = 'fp' THEN n ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN event IN ('tp', 'fp') THEN n ELSE 0 END), 0) AS fdr FROM band JOIN h ON p + 1 BETWEEN i AND 76 - i GROUP BY i""")
def splice_recall_fdr_band(spark, d):
    h = _events(spark, d).groupBy("p", "event").agg(F.count("*").alias("n"))
    one = lambda *k: F.sum(F.when(F.col("event").isin(*k), F.col("n")).otherwise(0))
    at = F.col("p") + 1
    wide = h.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(30)))).where(at.between(F.col("i"), 76 - F.col("i")))  # the histogram has at most 4 x 76 rows
    return wide.groupBy("i").agg(metrics.ratio(one("tp"), one("tp", "fn")).alias("recall"), metrics.ratio(one("fp"), one("tp", "fp")).alias("fdr"))


@_query(f"""WITH {_EVENTS}, h AS (SELECT coverage, count(CASE WHEN event = 'tp' THEN 1 END) AS tp, count(CASE WHEN event = 'fn' THEN 1 END) AS fn FROM events_ WHERE coverage > 0 GROUP BY ALL)
    SELECT coverage, CAST(sum(tp) OVER w AS DOUBLE) / nullif(sum(tp + fn) OVER w, 0) AS recall FROM h WINDOW w AS (ORDER BY coverage ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def splice_recall_by_coverage(spark, d):
    one = lambda k: F.count(F.when(F.col("event") == k, 1))
    h = _events(spark, d).where("coverage > 0").groupBy("coverage").agg(one("tp").alias("tp"), one("fn").alias("fn"))
    c = metrics.up_to(h, [], "coverage", ["tp", "fn"])
    return c.select("coverage", metrics.ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def _multi(by: str) -> str:
    minus = "(flag & 16) <> 0" if "mate" in by else "false"
    return f"""{_LONG}, ut AS (SELECT DISTINCT {by}, chr, {minus} AS minus, start, len FROM tlong), ur AS (SELECT DISTINCT {by}, chr, {minus} AS minus, start, len FROM rlong), units AS (SELECT DISTINCT {by} FROM reads),
    ca AS (SELECT {by}, count(*) AS k FROM ut GROUP BY ALL), cr AS (SELECT {by}, count(*) AS k FROM ur GROUP BY ALL), cc AS (SELECT {by}, count(*) AS k FROM ut JOIN ur USING ({by}, chr, minus, start, len) GROUP BY ALL),
    w AS (SELECT 'actual' AS what, coalesce(k, 0) AS k FROM units LEFT JOIN ca USING ({by}) UNION ALL SELECT 'reported', coalesce(k, 0) FROM units LEFT JOIN cr USING ({by}) UNION ALL SELECT 'correct', coalesce(k, 0) FROM units LEFT JOIN cc USING ({by})),
    multi AS (SELECT k, count(CASE WHEN what = 'actual' THEN 1 END) AS actual, count(CASE WHEN what = 'reported' THEN 1 END) AS reported, count(CASE WHEN what = 'correct' THEN 1 END) AS correct FROM w GROUP BY k)"""


@_query(f"WITH {_multi('frag, mate')} SELECT * FROM multi")
def multi_intron_read(spark, d):
    return accuracy.multi_intron(A.reads(spark, d), A.report(spark, d), ["frag", "mate"])


@_query(f"WITH {_multi('frag')} SELECT * FROM multi")
def multi_intron_pair(spark, d):
    return accuracy.multi_intron(A.reads(spark, d), A.report(spark, d), ["frag"])


@_query(f"""WITH {_multi('frag')}, c AS (SELECT k, sum(actual) OVER w AS a, sum(reported) OVER w AS r, sum(correct) OVER w AS c FROM multi WINDOW w AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT k, CAST(c AS DOUBLE) / nullif(r, 0) AS precision_, CAST(c AS DOUBLE) / nullif(a, 0) AS recall FROM c WHERE k > 0""")
def multi_intron_precision_recall(spark, d):
    m = metrics.at_least(multi_intron_pair(spark, d), [], "k", ["actual", "reported", "correct"]).where("k > 0")
    return m.select("k", metrics.ratio(F.col("correct"), F.col("reported")).alias("precision_"), metrics.ratio(F.col("correct"), F.col("actual")).alias("recall"))


_INDEL = f"""{A.READS_SQL}, {A.REPORT_SQL}, {A.ops_sql('top', 'reads')}, {A.ops_sql('rop', 'report')},
    ti AS (SELECT frag, mate, chr, CASE WHEN op = 'I' THEN 'I' ELSE 'D' END AS op, q, t, l, 1 AS a FROM top WHERE (op = 'I' OR {A.SHORT_GAP}) AND i > 0 AND i < n - 1),
    ri AS (SELECT frag, mate, chr, CASE WHEN op = 'I' THEN 'I' ELSE 'D' END AS op, q, t, l, 1 AS b FROM rop WHERE (op = 'I' OR {A.SHORT_GAP}) AND i > 0 AND i < n - 1),
    indel AS (SELECT op AS kind, l AS size, count(CASE WHEN a = 1 AND b = 1 THEN 1 END) AS correct, count(CASE WHEN a = 1 AND b IS NULL THEN 1 END) AS missed, count(CASE WHEN a IS NULL AND b = 1 THEN 1 END) AS wrong FROM ti FULL JOIN ri USING (frag, mate, chr, op, q, t, l) GROUP BY ALL)"""


@_query(f"WITH {_INDEL} SELECT kind, size, correct, missed, wrong FROM indel")
def indel_accuracy(spark, d):
    return accuracy.indel_accuracy(A.reads(spark, d), A.report(spark, d))


@_query(f"""WITH {_INDEL}, c AS (SELECT kind, size, sum(correct) OVER w AS c, sum(missed) OVER w AS m, sum(wrong) OVER w AS f FROM indel WINDOW w AS (PARTITION BY kind ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    pr AS (SELECT kind, size, CAST(c AS DOUBLE) / nullif(c + f, 0) AS p, CAST(c AS DOUBLE) / nullif(c + m, 0) AS r FROM c) SELECT kind, size, p AS precision_, r AS recall, 2 * p * r / nullif(p + r, 0) AS f_score FROM pr""")
def indel_prf(spark, d):
    c = metrics.at_least(indel_accuracy(spark, d), ["kind"], "size", ["correct", "missed", "wrong"])
    p, r = metrics.ratio(F.col("correct"), F.col("correct") + F.col("wrong")), metrics.ratio(F.col("correct"), F.col("correct") + F.col("missed"))
    return c.select("kind", "size", p.alias("precision_"), r.alias("recall"), metrics.f_score(p, r).alias("f_score"))


_PROFILE = f"""{A.READS_SQL}, {A.ops_sql('ops', 'reads')}, inner_ AS (SELECT * FROM ops WHERE i > 0 AND i < n - 1),
    at_ AS (SELECT {_mirror('q - 1', 'flag')} AS pos, op FROM inner_ WHERE op IN ('N', 'D') UNION ALL SELECT CASE WHEN (flag & 16) <> 0 THEN 75 - b ELSE b END, op FROM (SELECT flag, op, unnest(range(q, q + l)) AS b FROM inner_ WHERE op = 'I')),
    profile AS (SELECT CAST(s.pos AS INTEGER) AS pos, count(CASE WHEN op = 'N' THEN 1 END) AS introns, count(CASE WHEN op = 'D' THEN 1 END) AS deletions, count(CASE WHEN op = 'I' THEN 1 END) AS insertions FROM (SELECT unnest(range(76)) AS pos) s LEFT JOIN at_ ON at_.pos = s.pos GROUP BY s.pos)"""


@_query(f"WITH {_PROFILE} SELECT * FROM profile")
def pos_profile(spark, d):
    return gaps.position_profile(A.reads(spark, d), A.LENGTH)


@_query(f"WITH {_PROFILE} SELECT round(stddev_pop(deletions + insertions) / nullif(avg(deletions + insertions), 0), 9) AS cv FROM profile")
def indel_cv(spark, d):
    return pos_profile(spark, d).agg(F.round(metrics.variation(F.col("deletions") + F.col("insertions")), 9).alias("cv"))


@_query(f"WITH {_PROFILE}, high AS (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM profile WHERE insertions > 0) SELECT min(pos) AS s, max(pos) AS e FROM high GROUP BY g")
def saturated_ranges(spark, d):
    return metrics.runs_above(pos_profile(spark, d), "pos", "insertions", 0)


@_query(f"WITH {A.READS_SQL}, {A.REPORT_SQL}, {A.ops_sql('ops', 'report')} SELECT op, count(*) AS n, CAST(sum(l) AS BIGINT) AS bases FROM ops GROUP BY ALL")
def cigar_op_counts(spark, d):
    return gaps.operations(A.report(spark, d), []).groupBy("op").agg(F.count("*").alias("n"), F.sum("l").alias("bases"))


@_query(f"WITH {A.READS_SQL}, {A.REPORT_SQL} SELECT chr AS target, chr IN ('chr1', 'chr2', 'chr3', 'chr4', 'chr5', 'chr6') AS valid, count(*) AS alignments FROM report WHERE (flag & 4) = 0 GROUP BY ALL")
def target_counts_validity(spark, d):
    r = A.report(spark, d).where(~tags.has(F.col("flag"), tags.UNMAPPED))
    known = A.reads(spark, d).select("chr").distinct().withColumn("ok", F.lit(True))
    return r.groupBy("chr").agg(F.count("*").alias("alignments")).join(known, "chr", "left").select(F.col("chr").alias("target"), F.col("ok").isNotNull().alias("valid"), "alignments")


_GRID = f"""{A.READS_SQL}, {A.REPORT_SQL}, all_ AS (SELECT * FROM report UNION ALL SELECT * FROM report WHERE frag % 7 = 0 AND mate = 2),
    per AS (SELECT frag, count(CASE WHEN mate = 1 AND (flag & 4) = 0 THEN 1 END) AS mate1, count(CASE WHEN mate = 2 AND (flag & 4) = 0 THEN 1 END) AS mate2 FROM all_ GROUP BY frag),
    grid AS (SELECT least(mate1, 100) AS mate1, least(mate2, 100) AS mate2, count(*) AS fragments FROM per GROUP BY ALL)"""


def _grid(spark, d):
    r = A.report(spark, d)
    mapped = r.union(r.where("frag % 7 = 0 AND mate = 2")).withColumn("m", ~tags.has(F.col("flag"), tags.UNMAPPED))
    per = mapped.groupBy("frag").agg(*[F.count(F.when((F.col("mate") == k) & F.col("m"), 1)).alias(f"mate{k}") for k in (1, 2)])
    return per.groupBy(*[F.least(f"mate{k}", F.lit(100)).alias(f"mate{k}") for k in (1, 2)]).agg(F.count("*").alias("fragments"))


@_query(f"WITH {_GRID} SELECT * FROM grid")
def pair_count_grid(spark, d):
    return _grid(spark, d)


@_query(f"""WITH {_GRID}, a AS (SELECT unnest(range(101)) AS mate1), b AS (SELECT unnest(range(101)) AS mate2)
    SELECT CAST(a.mate1 AS BIGINT) AS mate1, CAST(b.mate2 AS BIGINT) AS mate2, coalesce(fragments, 0) AS fragments FROM a CROSS JOIN b LEFT JOIN grid ON grid.mate1 = a.mate1 AND grid.mate2 = b.mate2""")
def pair_count_grid_full(spark, d):
    """All 101 x 101 places, zeros included."""
    return gaps.filled(_grid(spark, d), {"mate1": 101, "mate2": 101}, ["fragments"])


@_query(f"""WITH {_EVENTS}, h AS (SELECT event, amb, p, coverage, count(*) AS introns FROM events_ GROUP BY ALL), ps AS (SELECT unnest(range(75)) AS p), cs AS (SELECT unnest(range(21)) AS coverage),
    es AS (SELECT * FROM (VALUES ('tp'), ('fn'), ('fp')) e(event) CROSS JOIN (VALUES (true), (false)) m(amb))
    SELECT event, amb, CAST(p AS BIGINT) AS p, CAST(coverage AS BIGINT) AS coverage, coalesce(introns, 0) AS introns FROM es CROSS JOIN ps CROSS JOIN cs LEFT JOIN h USING (event, amb, p, coverage)""")
def intron_matrices(spark, d):
    """Position by coverage, 75 x 21 places for each event and ambiguity, zeros included."""
    h = intron_tp_fn_fp(spark, d)
    kinds = spark.createDataFrame([(e, a) for e in ("tp", "fn", "fp") for a in (True, False)], "event string, amb boolean")
    return gaps.filled(h, {"p": 75, "coverage": 21}, ["introns"], kinds)


@_query(f"""WITH {_GRID}, c AS (SELECT CASE WHEN mate1 = 1 AND mate2 = 1 THEN 'UU' WHEN mate1 > 1 AND mate2 > 1 THEN 'MM' WHEN mate1 > 0 AND mate2 > 0 THEN 'UM' WHEN mate1 + mate2 = 1 THEN 'UN' WHEN mate1 + mate2 > 1 THEN 'MN' ELSE 'NN' END AS class, fragments FROM grid)
    SELECT class, CAST(sum(fragments) AS BIGINT) AS fragments, CAST(sum(fragments) AS DOUBLE) / (SELECT sum(fragments) FROM grid) AS share FROM c GROUP BY class""")
def pair_yield(spark, d):
    a, b = F.col("mate1"), F.col("mate2")
    kind = F.when((a == 1) & (b == 1), "UU").when((a > 1) & (b > 1), "MM").when((a > 0) & (b > 0), "UM").when(a + b == 1, "UN").when(a + b > 1, "MN").otherwise("NN")
    sums = _grid(spark, d).groupBy(kind.alias("class")).agg(F.sum("fragments").alias("fragments"))
    from pyspark.sql import Window

    return sums.withColumn("share", metrics.ratio(F.col("fragments"), F.sum("fragments").over(Window.partitionBy())))  # six rows


@_query(f"WITH {A.exons_sql()}, n AS (SELECT *, count(*) OVER (PARTITION BY tx_id) AS n, row_number() OVER (PARTITION BY tx_id ORDER BY s, e) AS i FROM exons) SELECT CASE WHEN n = 1 THEN 'single' WHEN CASE WHEN strand = '-' THEN i = n ELSE i = 1 END THEN 'first' WHEN CASE WHEN strand = '-' THEN i = 1 ELSE i = n END THEN 'last' ELSE 'internal' END AS kind, count(*) AS exons FROM n GROUP BY ALL")
def exon_kinds(spark, d):
    return annotation.exons(A.transcripts(spark, d)).groupBy("kind").agg(F.count("*").alias("exons"))


_PATTERN = "SELECT chr, strand, key, count(*) AS transcripts FROM (SELECT tx_id, chr, strand, string_agg(e || '-' || nxt, ':' ORDER BY s) AS key FROM (SELECT *, lead(s) OVER (PARTITION BY tx_id ORDER BY s, e) AS nxt FROM {0}) WHERE nxt IS NOT NULL GROUP BY ALL) GROUP BY ALL"


def _patterns(spark, d, rows="true"):
    chain = F.transform(F.sequence(F.lit(1), F.size("exons") - 1), lambda i: F.concat_ws("-", F.get("exons", i - 1)["e"], F.get("exons", i)["s"]))
    t = A.transcripts(spark, d, rows).where(F.size("exons") > 1).select("chr", "strand", F.concat_ws(":", chain).alias("key"))
    return t.groupBy("chr", "strand", "key").agg(F.count("*").alias("transcripts"))


@_query(f"WITH {A.exons_sql()} {_PATTERN.format('exons')}")
def splice_patterns(spark, d):
    return _patterns(spark, d)


_MATCH = f"""{A.exons_sql('e1', FIRST)}, {A.exons_sql('e2', SECOND)}, ref AS ({_PATTERN.format('e1')}), pred AS ({_PATTERN.format('e2')}),
    ri AS (SELECT chr, strand, key, unnest(string_split(key, ':')) AS j FROM ref), pi AS (SELECT chr, strand, key, unnest(string_split(key, ':')) AS j FROM pred),
    met AS (SELECT DISTINCT pi.chr, pi.strand, pi.key, ri.key AS rkey FROM pi JOIN ri USING (chr, strand, j)),
    hit AS (SELECT pred.chr, pred.strand, pred.key, max(CASE WHEN rkey IS NULL THEN 0 WHEN rkey = key THEN 3 WHEN contains(':' || rkey || ':', ':' || key || ':') THEN 2 ELSE 1 END) AS hit FROM pred LEFT JOIN met USING (chr, strand, key) GROUP BY ALL)"""


@_query(f"WITH {_MATCH} SELECT hit, count(*) AS patterns FROM hit GROUP BY ALL")
def pattern_match(spark, d):
    """3: a reference pattern is equal; 2: one holds the chain; 1: one shares an intron; 0: none."""
    split = lambda t: t.select("chr", "strand", "key", F.explode(F.split("key", ":")).alias("j"))
    pred = _patterns(spark, d, SECOND)
    met = split(pred).join(split(_patterns(spark, d, FIRST)).withColumnRenamed("key", "rkey"), ["chr", "strand", "j"]).select("chr", "strand", "key", "rkey").distinct()
    inside = F.expr("instr(concat(':', rkey, ':'), concat(':', key, ':')) > 0")
    grade = F.when(F.col("rkey").isNull(), 0).when(F.col("rkey") == F.col("key"), 3).when(inside, 2).otherwise(1)
    best = pred.join(met, ["chr", "strand", "key"], "left").groupBy("chr", "strand", "key").agg(F.max(grade).alias("hit"))
    return best.groupBy("hit").agg(F.count("*").alias("patterns"))


@_query("SELECT p_partkey % 97 AS gene_id, min(p_type) AS type, count(DISTINCT p_type) AS n_types FROM part GROUP BY ALL")
def gene_types(spark, d):
    return annotation.gene_types(spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey % 97 AS gene_id", "p_type AS type"))


@_query("""WITH q AS (SELECT quantile_cont(p_retailprice, 1.0 / 3) AS a, quantile_cont(p_retailprice, 2.0 / 3) AS b FROM part)
    SELECT CASE WHEN p_retailprice <= a THEN 1 WHEN p_retailprice <= b THEN 2 ELSE 3 END AS tertile, count(*) AS transcripts FROM part, q GROUP BY ALL""")
def expression_tertiles(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet").select("p_retailprice")
    low, high = metrics.quantiles(part, "p_retailprice", [1 / 3, 2 / 3])
    return part.groupBy(metrics.tertile(F.col("p_retailprice"), F.lit(low), F.lit(high)).alias("tertile")).agg(F.count("*").alias("transcripts"))


@_query(f"WITH {A.exons_sql()} SELECT chr, count(*) AS exons, count(DISTINCT tx_id) AS transcripts FROM exons JOIN part ON p_partkey = tx_id WHERE p_retailprice > 910 GROUP BY ALL")
def expressed_tx_filter(spark, d):
    """Exons of transcripts that are expressed; the price of a part stands for its expression."""
    level = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("tx_id"), F.col("p_retailprice").alias("level"))
    return annotation.expressed(A.exons(spark, d), level, "level", 910).groupBy("chr").agg(F.count("*").alias("exons"), F.countDistinct("tx_id").alias("transcripts"))


@_query(f"""WITH {A.exons_sql('e1', FIRST)}, {A.exons_sql('e2', SECOND)}, pred AS ({_PATTERN.format('e2')}),
    k AS (SELECT tx_id, chr, strand, string_agg(e || '-' || nxt, ':' ORDER BY s) AS key FROM (SELECT *, lead(s) OVER (PARTITION BY tx_id ORDER BY s, e) AS nxt FROM e1) WHERE nxt IS NOT NULL GROUP BY ALL),
    x AS (SELECT p_retailprice AS v, pred.key IS NOT NULL AS found FROM k JOIN part ON p_partkey = tx_id LEFT JOIN pred USING (chr, strand, key)),
    q AS (SELECT quantile_cont(v, 1.0 / 3) AS a, quantile_cont(v, 2.0 / 3) AS b FROM x)
    SELECT CASE WHEN v <= a THEN 1 WHEN v <= b THEN 2 ELSE 3 END AS tertile, count(*) AS transcripts, CAST(count(CASE WHEN found THEN 1 END) AS DOUBLE) / count(*) AS sensitivity FROM x, q GROUP BY ALL""")
def sensitivity_by_tertile(spark, d):
    """Share of the reference's spliced transcripts whose pattern is predicted, by tertile of their expression."""
    chain = F.transform(F.sequence(F.lit(1), F.size("exons") - 1), lambda i: F.concat_ws("-", F.get("exons", i - 1)["e"], F.get("exons", i)["s"]))
    ref = A.transcripts(spark, d, FIRST).where(F.size("exons") > 1).select("tx_id", "chr", "strand", F.concat_ws(":", chain).alias("key"))
    level = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("tx_id"), F.col("p_retailprice").alias("v"))
    hit = _patterns(spark, d, SECOND).select("chr", "strand", "key", F.lit(1).alias("hit"))
    x = ref.join(level, "tx_id")
    low, high = metrics.quantiles(x, "v", [1 / 3, 2 / 3])
    told = x.join(hit, ["chr", "strand", "key"], "left")
    return told.groupBy(metrics.tertile(F.col("v"), F.lit(low), F.lit(high)).alias("tertile")).agg(F.count("*").alias("transcripts"), metrics.ratio(F.count("hit"), F.count("*")).alias("sensitivity"))


_CONTEXT = {
    "before": "translate(CAST(CAST(p_partkey AS BIGINT) * 7919 AS VARCHAR(19)), '0123456789', 'ACAACCACAC')",
    "event": "CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'AC' WHEN 2 THEN 'CA' ELSE 'CAA' END",
    "after": "translate(CAST(CAST(p_partkey AS BIGINT) * 104729 AS VARCHAR(19)), '0123456789', 'CAACACCAAC')",
}


@_query(f"""WITH c AS (SELECT p_partkey, {', '.join(f'{x} AS {name}' for name, x in _CONTEXT.items())} FROM part), k AS (SELECT *, unnest(range(20)) AS n FROM c)
    SELECT p_partkey, CAST(max(CASE WHEN n <= length(after) AND left(after, n) = left(repeat(event, 20), n) THEN n END) AS INTEGER) AS right_shift,
    CAST(max(CASE WHEN n <= length(before) AND right(before, n) = right(repeat(event, 20), n) THEN n END) AS INTEGER) AS left_shift FROM k GROUP BY p_partkey""")
def indel_shift(spark, d):
    """How far deletions can move in contexts made of the digits of a key."""
    from junctura.functions import shift

    x = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", *[f"{x} AS {name}" for name, x in _CONTEXT.items()])
    return x.select("p_partkey", shift.right_shift(F.col("after"), F.col("event")).alias("right_shift"), shift.left_shift(F.col("before"), F.col("event")).alias("left_shift"))
