"""More named queries: ambiguous indels, quality of alignments, reconstructed exons and patterns. They join those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from junctura.functions import tags
from junctura.operators import ambiguity, metrics, quality, reconstruction
from junctura.plans import adapters as A
from junctura.plans.queries import _MATCH, _VERDICT, FIRST, SECOND, _multi, _patterns, _query, _territory, _union_sql, multi_intron_pair

ANNOTATED = "p_partkey % 3 = 0"

_LEFT, _RIGHT = "CAST(t % 3 AS INTEGER)", "CAST(CAST((t - t % 20) / 20 AS INTEGER) % 4 AS INTEGER)"


def _small(name: str, ops: str) -> str:
    return f"{name} AS (SELECT frag, mate, chr, flag & 16 AS st, CASE WHEN op = 'I' THEN 'I' ELSE 'D' END AS op, q - CASE WHEN op = 'I' THEN 0 ELSE 1 END AS q, t, l FROM {ops} WHERE op = 'I' OR ({A.SHORT_GAP}))"


_SHIFTED = f"""{_small('ti0', 'top')}, {_small('ri', 'rop')}, shifts AS (SELECT DISTINCT chr, op, t, l, {_LEFT} AS ls, {_RIGHT} AS rs FROM ti0 WHERE t % 7 <> 0),
    ti AS (SELECT ti0.*, coalesce(ls, 0) AS ls, coalesce(rs, 0) AS rs FROM ti0 LEFT JOIN shifts USING (chr, op, t, l))"""


def _shifts(spark, d):
    placed = A.reads(spark, d).select("flag", "chr", "pos", "cigar").distinct()  # each placement is walked once
    found = ambiguity.indels(placed, ["chr"]).select("chr", "op", "t", F.col("l").alias("size")).distinct().where("t % 7 <> 0")
    return found.select("*", F.expr(_LEFT).alias("ls"), F.expr(_RIGHT).alias("rs"))


_NEAR = "t.frag = r.frag AND t.mate = r.mate AND t.chr = r.chr AND t.st = r.st AND t.op = r.op AND t.l = r.l AND r.q BETWEEN t.q - t.ls AND t.q + t.rs AND r.t BETWEEN t.t - t.ls AND t.t + t.rs"


@_query(f"""WITH {_VERDICT}, {_SHIFTED}, ev AS (
    SELECT op, l, CASE WHEN EXISTS (SELECT 1 FROM ri r WHERE {_NEAR}) THEN 'correct' ELSE 'missed' END AS event FROM ti t WHERE CASE WHEN op = 'D' THEN q - ls >= 0 AND q + rs < 75 ELSE q - ls > 0 AND q + rs + l < 76 END
    UNION ALL SELECT op, l, 'wrong' FROM ri r WHERE NOT EXISTS (SELECT 1 FROM ti t WHERE {_NEAR}) AND CASE WHEN op = 'D' THEN q NOT IN (-1, 75) ELSE q > 0 AND q + l < 76 END)
    SELECT op AS kind, l AS size, count(CASE WHEN event = 'correct' THEN 1 END) AS correct, count(CASE WHEN event = 'missed' THEN 1 END) AS missed, count(CASE WHEN event = 'wrong' THEN 1 END) AS wrong FROM ev GROUP BY ALL""")
def indel_accuracy_shifted(spark, d):
    return ambiguity.indel_verdicts(A.reads(spark, d), A.report(spark, d), _shifts(spark, d), A.LENGTH)


@_query(f"""WITH {_VERDICT}, {_SHIFTED}, js AS (SELECT unnest(range(76)) AS j), steps AS (SELECT unnest(range(1, 5)) AS i), alt AS (
    SELECT frag, mate, j, 2 * (t + l - 1 - q + j) AS c FROM ti, js WHERE op = 'D' AND j > q - ls AND j <= q
    UNION ALL SELECT frag, mate, j, 2 * (t - 1 + j - q) FROM ti, js WHERE op = 'D' AND j > q AND j <= q + rs
    UNION ALL SELECT frag, mate, j, 2 * (t - i) FROM ti, js, steps WHERE op = 'I' AND i <= ls AND j = q - i + l
    UNION ALL SELECT frag, mate, j, 2 * (t - i) - 1 FROM ti, js, steps WHERE op = 'I' AND i <= ls AND j >= q - i AND j < q - i + l
    UNION ALL SELECT frag, mate, j, 2 * (t - 1 + i) FROM ti, js, steps WHERE op = 'I' AND i <= rs AND j = q - 1 + i
    UNION ALL SELECT frag, mate, j, 2 * (t - 1 + i) + 1 FROM ti, js, steps WHERE op = 'I' AND i <= rs AND j > q - 1 + i AND j <= q - 1 + i + l),
    good AS (SELECT frag, mate, count(*) AS n FROM (SELECT frag, mate, j, c FROM rb WHERE c IS NOT NULL INTERSECT (SELECT frag, mate, j, c FROM tb UNION SELECT frag, mate, j, c FROM alt)) GROUP BY ALL)
    SELECT CAST(coalesce(n, 0) AS INTEGER) AS bases, count(*) AS reads FROM pair LEFT JOIN good USING (frag, mate) WHERE same GROUP BY ALL""")
def right_bases_shifted(spark, d):
    found = ambiguity.counted_right_bases(A.reads(spark, d), A.report(spark, d), _shifts(spark, d))
    return found.groupBy(F.col("right").alias("bases")).agg(F.sum("reads").alias("reads"))


#: A report with secondary alignments of some reads and a second primary one of others; seq is the order of arrival.
_MORE = {
    "2": ("frag % 7 = 0 AND frag % 3 <> mate", "flag + 256", "pos + 7"),
    "3": ("frag % 14 = 0", "flag + 256", "pos + 9"),
    "4": ("frag % 9 = 0 AND mate = 1", "flag", "pos + 1"),
}
_MANY = f"{A.READS_SQL}, {A.REPORT_SQL}, many AS (SELECT frag, mate, 1 AS seq, flag, chr, pos, cigar FROM report" + "".join(
    f" UNION ALL SELECT frag, mate, {seq}, {flag}, chr, {pos}, cigar FROM report WHERE (flag & 4) = 0 AND {rows}" for seq, (rows, flag, pos) in _MORE.items()
) + ")"


def _many(spark, d):
    r = A.report(spark, d)
    out = r.selectExpr("frag", "mate", "1 AS seq", "flag", "chr", "pos", "cigar")
    for seq, (rows, flag, pos) in _MORE.items():
        out = out.union(r.where(f"(flag & 4) = 0 AND {rows}").selectExpr("frag", "mate", seq, flag, "chr", pos, "cigar"))
    return out


_PER = f"""{_MANY}, per AS (SELECT frag, count(CASE WHEN mate = 1 THEN 1 END) AS n1, count(CASE WHEN mate = 2 THEN 1 END) AS n2,
    count(CASE WHEN mate = 1 AND (flag & 256) = 0 THEN 1 END) AS pri1, count(CASE WHEN mate = 2 AND (flag & 256) = 0 THEN 1 END) AS pri2 FROM many WHERE (flag & 4) = 0 GROUP BY frag)"""


@_query(f"WITH {_PER} SELECT n1, n2, pri1, pri2, count(*) AS fragments FROM per GROUP BY ALL")
def fragment_alignments(spark, d):
    return quality.per_fragment(_many(spark, d)).groupBy("n1", "n2", "pri1", "pri2").agg(F.count("*").alias("fragments"))


@_query(f"""WITH {_PER} SELECT * FROM (SELECT count(*) AS alignments, count(CASE WHEN cigar LIKE '%N%' THEN 1 END) AS spliced, count(CASE WHEN cigar NOT LIKE '%N%' THEN 1 END) AS unspliced FROM many WHERE (flag & 4) = 0),
    (SELECT CAST(sum(greatest(pri1 - 1, 0) + greatest(pri2 - 1, 0)) AS BIGINT) AS more_primaries, CAST(sum(CASE WHEN n1 > 0 AND pri1 = 0 THEN 1 ELSE 0 END + CASE WHEN n2 > 0 AND pri2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS only_secondary, max(greatest(n1, n2)) AS most FROM per)""")
def alignment_summary(spark, d):
    return quality.summary(_many(spark, d))


@_query(f"""WITH {_MANY}, want AS (SELECT o_orderkey AS frag, mate FROM orders CROSS JOIN (VALUES (1), (2)) m(mate)), kept AS (SELECT * FROM many WHERE frag % 10 <> 4),
    pri AS (SELECT * FROM kept WHERE (flag & 256) = 0 QUALIFY row_number() OVER (PARTITION BY frag, mate ORDER BY seq DESC) = 1), sec AS (SELECT * FROM kept WHERE (flag & 256) <> 0 QUALIFY row_number() OVER (PARTITION BY frag, mate ORDER BY seq) = 1),
    two AS (SELECT DISTINCT frag FROM sec), hits AS (SELECT w.frag, w.mate, 1 AS hi, CASE WHEN two.frag IS NULL THEN 1 ELSE 2 END AS ih FROM want w LEFT JOIN two USING (frag) UNION ALL SELECT w.frag, w.mate, 2, 2 FROM want w JOIN two USING (frag)),
    x AS (SELECT 1 AS hi, * FROM pri UNION ALL SELECT 2, * FROM sec)
    SELECT h.frag, h.mate, h.hi, h.ih, CAST(coalesce(x.flag, 64 * h.mate + 5) AS INTEGER) AS flag, coalesce(x.chr, '*') AS chr, CAST(coalesce(x.pos, 0) AS INTEGER) AS pos, coalesce(x.cigar, '*') AS cigar FROM hits h LEFT JOIN x USING (frag, mate, hi)""")
def hit_tags(spark, d):
    return quality.hit_tags(_many(spark, d).where("frag % 10 <> 4"), A.reads(spark, d))


@_query(f"""WITH {_MANY} SELECT CASE WHEN frag % 10 <> 1 THEN CAST((frag * 3 + mate) % 41 AS INTEGER) END AS q, CAST(frag % 4 AS INTEGER) AS nm, count(*) AS reads FROM many WHERE (flag & 4) = 0 AND (flag & 256) = 0 GROUP BY ALL""")
def mismatches_by_quality(spark, d):
    nm = _many(spark, d).withColumn("nm", F.expr("CAST(frag % 4 AS INT)"))
    known = A.reads(spark, d).where("frag % 10 <> 1").selectExpr("frag", "mate", "repeat(char(33 + (frag * 3 + mate) % 41), 76) AS qual")
    return quality.mismatches_by_quality(nm, known)


_MADE_MD = "concat(CAST(p_partkey % 31 AS VARCHAR(9)), 'A', CAST(p_partkey % 3 AS VARCHAR(9)), '^AC', CAST(p_partkey % 5 AS VARCHAR(9)), 'T0G', CAST(p_partkey % 17 AS VARCHAR(9)))"


@_query(f"""WITH t AS (SELECT p_partkey, regexp_extract_all(regexp_replace({_MADE_MD}, '\\^[A-Z]+', ':', 'g'), '[0-9]+|[A-Z:]') AS a FROM part), tok AS (SELECT p_partkey, i, a[i + 1] AS x FROM (SELECT *, unnest(range(len(a))) AS i FROM t)),
    at_ AS (SELECT x, coalesce(sum(CASE WHEN x = ':' THEN 0 ELSE coalesce(TRY_CAST(x AS INTEGER), 1) END) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM tok)
    SELECT CAST(p AS INTEGER) AS p, x AS base, count(*) AS reads FROM at_ WHERE x IN ('A', 'C', 'G', 'T') GROUP BY ALL""")
def md_mismatches(spark, d):
    """Mismatches by place and base, from MD strings made of a key, with a deletion and neighbouring mismatches."""
    md = spark.read.parquet(f"{d}/part.parquet").selectExpr(f"{_MADE_MD} AS md")
    return md.select(F.explode(tags.mismatches(F.col("md"))).alias("x")).groupBy("x.p", "x.base").agg(F.count("*").alias("reads"))


def _typed(name: str, rows: str) -> str:
    return f"""{A.exons_sql(name + '_e', rows)}, {name} AS (SELECT DISTINCT chr, strand, s, e, CASE WHEN n = 1 THEN 'single' WHEN i = 1 THEN 'first' WHEN i = n THEN 'last' ELSE 'internal' END AS kind
        FROM (SELECT *, count(*) OVER (PARTITION BY tx_id) AS n, row_number() OVER (PARTITION BY tx_id ORDER BY s, e) AS i FROM {name}_e))"""


def _agree(a: str, b: str) -> str:
    return f"""{a}.chr = {b}.chr AND {a}.strand = {b}.strand AND {a}.s <= {b}.e AND {a}.e >= {b}.s AND CASE {b}.kind WHEN 'single' THEN least({a}.e, {b}.e) - greatest({a}.s, {b}.s) + 1 >= 0.6 * ({b}.e - {b}.s)
        WHEN 'internal' THEN {a}.s = {b}.s AND {a}.e = {b}.e WHEN 'first' THEN {a}.e = {b}.e ELSE {a}.s = {b}.s END"""


_EXONS = f"""{_typed('pred0', SECOND)}, {_typed('ref0', FIRST)}, {_typed('ann', ANNOTATED)}, pred AS (SELECT DISTINCT chr, strand, s, e FROM pred0),
    ref AS (SELECT r.*, EXISTS (SELECT 1 FROM ann a WHERE {_agree('r', 'a')}) AS known FROM ref0 r)"""


def _exon_sets(spark, d):
    pred, ref, ann = (reconstruction.typed_exons(A.transcripts(spark, d, rows)) for rows in (SECOND, FIRST, ANNOTATED))
    return pred, reconstruction.known_exons(ref, ann)


@_query(f"WITH {_EXONS} SELECT kind, known, count(*) AS exons FROM ref GROUP BY ALL")
def known_exons(spark, d):
    return _exon_sets(spark, d)[1].groupBy("kind", "known").agg(F.count("*").alias("exons"))


_EXON_ACCURACY = f"""{_EXONS}, p AS (SELECT p.*, EXISTS (SELECT 1 FROM ref r WHERE {_agree('p', 'r')}) AS hit, EXISTS (SELECT 1 FROM ref r WHERE r.known AND {_agree('p', 'r')}) AS k FROM pred p),
    r AS (SELECT r.*, EXISTS (SELECT 1 FROM pred p WHERE {_agree('p', 'r')}) AS met FROM ref r),
    acc AS (SELECT * FROM (SELECT count(*) AS predicted, count(CASE WHEN hit THEN 1 END) AS correct, count(CASE WHEN k THEN 1 END) AS correct_known FROM p),
        (SELECT count(*) AS reference, count(CASE WHEN known THEN 1 END) AS reference_known, count(CASE WHEN met THEN 1 END) AS reference_met, count(CASE WHEN known AND met THEN 1 END) AS reference_known_met FROM r))"""


@_query(f"WITH {_EXON_ACCURACY} SELECT * FROM acc")
def exon_accuracy(spark, d):
    pred, ref = _exon_sets(spark, d)
    return reconstruction.exon_accuracy(pred, ref)


@_query(f"""WITH {_EXON_ACCURACY} SELECT CAST(reference_met AS DOUBLE) / nullif(reference, 0) AS sensitivity, CAST(correct AS DOUBLE) / nullif(predicted, 0) AS precision_,
    CAST(correct_known AS DOUBLE) / nullif(correct_known + predicted - correct, 0) AS precision_known FROM acc""")
def exon_sensitivity_precision(spark, d):
    c, r = F.col, metrics.ratio
    return exon_accuracy(spark, d).select(r(c("reference_met"), c("reference")).alias("sensitivity"), r(c("correct"), c("predicted")).alias("precision_"), r(c("correct_known"), c("correct_known") + c("predicted") - c("correct")).alias("precision_known"))


_BEST = f"""{_MATCH}, best AS (SELECT ref.chr, ref.strand, ref.key, max(CASE WHEN met.key IS NULL THEN 0 WHEN met.rkey = met.key THEN 3 WHEN contains(':' || met.rkey || ':', ':' || met.key || ':') THEN 2 ELSE 1 END) AS hit
    FROM ref LEFT JOIN met ON met.chr = ref.chr AND met.strand = ref.strand AND met.rkey = ref.key GROUP BY ALL)"""


def _best(spark, d):
    """The patterns of the reference with the best grade that a predicted one has against them."""
    split = lambda t: t.select("chr", "strand", "key", F.explode(F.split("key", ":")).alias("j"))
    ref = _patterns(spark, d, FIRST)
    met = split(ref).join(split(_patterns(spark, d, SECOND)).withColumnRenamed("key", "pkey"), ["chr", "strand", "j"]).select("chr", "strand", "key", "pkey").distinct()
    grade = F.when(F.col("key") == F.col("pkey"), 3).when(F.expr("instr(concat(':', key, ':'), concat(':', pkey, ':')) > 0"), 2).otherwise(1)
    hits = met.groupBy("chr", "strand", "key").agg(F.max(grade).alias("hit"))
    return ref.join(hits, ["chr", "strand", "key"], "left").select("chr", "strand", "key", F.coalesce("hit", F.lit(0)).alias("hit"))


@_query(f"WITH {_BEST} SELECT hit, count(*) AS patterns FROM best GROUP BY ALL")
def reference_best_hit(spark, d):
    return _best(spark, d).groupBy("hit").agg(F.count("*").alias("patterns"))


@_query(f"""WITH {_BEST}, {A.exons_sql('e3', ANNOTATED)}, ann AS (SELECT DISTINCT chr, strand, key FROM (SELECT tx_id, chr, strand, string_agg(e || '-' || nxt, ':' ORDER BY s) AS key FROM (SELECT *, lead(s) OVER (PARTITION BY tx_id ORDER BY s, e) AS nxt FROM e3) WHERE nxt IS NOT NULL GROUP BY ALL)),
    tp AS (SELECT count(CASE WHEN ann.key IS NOT NULL THEN 1 END) AS k, count(CASE WHEN ann.key IS NULL THEN 1 END) AS n FROM best LEFT JOIN ann USING (chr, strand, key) WHERE hit = 3), total AS (SELECT count(*) AS t FROM pred)
    SELECT CAST(k AS DOUBLE) / nullif(t - n, 0) AS known, CAST(n AS DOUBLE) / nullif(t - k, 0) AS novel FROM tp, total""")
def novelty_precision(spark, d):
    """Precision for patterns of the annotation and for others: what is right and of the other kind leaves the denominator."""
    known = _patterns(spark, d, ANNOTATED).select("chr", "strand", "key", F.lit(True).alias("known"))
    tp = _best(spark, d).where("hit = 3").join(known, ["chr", "strand", "key"], "left").agg(F.count("known").alias("k"), (F.count("*") - F.count("known")).alias("n"))
    both = tp.join(F.broadcast(_patterns(spark, d, SECOND).agg(F.count("*").alias("t"))))  # one row each
    return both.select(metrics.ratio(F.col("k"), F.col("t") - F.col("n")).alias("known"), metrics.ratio(F.col("n"), F.col("t") - F.col("k")).alias("novel"))


@_query(f"""WITH {A.READS_SQL}, {_territory('true')}, {A.REPEATS_SQL}, {_union_sql('u', 'repeats')}, {A.ops_sql('ops', 'reads')},
    placed AS (SELECT frag, mate, chr, pos AS s, CAST(max(pos) + sum(CASE WHEN op IN ('M', 'D', 'N') THEN l ELSE 0 END) - 1 AS BIGINT) AS e FROM ops GROUP BY ALL), k AS (SELECT chr, s, e, count(*) AS n FROM placed GROUP BY ALL),
    y AS (SELECT k.chr, k.s, k.e, k.n, coalesce(sum(CASE WHEN t.s IS NOT NULL THEN least(k.e, t.e) - greatest(k.s, t.s) + 1 END), 0) AS bases FROM k LEFT JOIN territory t ON t.chr = k.chr AND t.s <= k.e AND t.e >= k.s GROUP BY ALL),
    x AS (SELECT n, bases = e - s + 1 AS inside, EXISTS (SELECT 1 FROM u WHERE u.chr = y.chr AND u.s <= y.e AND u.e >= y.s) AS touched FROM y)
    SELECT CAST(sum(n) AS BIGINT) AS mapped, CAST(coalesce(sum(CASE WHEN inside AND NOT touched THEN n END), 0) AS BIGINT) AS intronic, CAST(coalesce(sum(CASE WHEN inside AND touched THEN n END), 0) AS BIGINT) AS intronic_repeat FROM x""")
def intronic_counts(spark, d):
    return reconstruction.intronic_counts(A.reads(spark, d), A.exons(spark, d), A.repeats(spark, d))


@_query(f"""WITH {A.READS_SQL}, {_territory('true')}, {A.REPEATS_SQL}, {_union_sql('u', 'repeats')}, {A.ops_sql('ops', 'reads')},
    placed AS (SELECT frag, mate, chr, pos AS s, CAST(max(pos) + sum(CASE WHEN op IN ('M', 'D', 'N') THEN l ELSE 0 END) - 1 AS BIGINT) AS e FROM ops GROUP BY ALL), k AS (SELECT chr, s, e, count(*) AS n FROM placed GROUP BY ALL),
    y AS (SELECT k.chr, k.s, k.e, k.n, coalesce(sum(CASE WHEN t.s IS NOT NULL THEN least(k.e, t.e) - greatest(k.s, t.s) + 1 END), 0) AS bases FROM k LEFT JOIN territory t ON t.chr = k.chr AND t.s <= k.e AND t.e >= k.s GROUP BY ALL),
    x AS (SELECT n, bases = e - s + 1 AS inside, EXISTS (SELECT 1 FROM u WHERE u.chr = y.chr AND u.s <= y.e AND u.e >= y.s) AS touched FROM y)
    SELECT CAST(sum(n) AS BIGINT) AS mapped, CAST(coalesce(sum(CASE WHEN inside AND NOT touched THEN n END), 0) AS BIGINT) AS intronic, CAST(coalesce(sum(CASE WHEN inside AND touched THEN n END), 0) AS BIGINT) AS intronic_repeat FROM x""")
def intronic_counts_whole(spark, d):
    return reconstruction.intronic_counts(A.reads(spark, d), A.exons(spark, d), A.repeats(spark, d))


@_query(f"WITH {_multi('frag')} SELECT least(k, 2) AS k, CAST(sum(actual) AS BIGINT) AS actual, CAST(sum(reported) AS BIGINT) AS reported, CAST(sum(correct) AS BIGINT) AS correct FROM multi GROUP BY ALL")
def multi_intron_collapsed(spark, d):
    return metrics.collapsed(multi_intron_pair(spark, d), [], "k", 2, ["actual", "reported", "correct"])
