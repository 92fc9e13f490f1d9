"""Named queries for soundness checks, filled-up reports and mismatches without N. They join those of `queries`."""

from __future__ import annotations

from pyspark.sql import functions as F

from junctura.functions import tags
from junctura.operators import gaps, metrics, quality
from junctura.plans import adapters as A
from junctura.plans.queries import _INC, CAP, ORACLE_SQL, _hist, _incorporated, _multi, _query, multi_intron_read
from junctura.plans.scoring import _MANY, _many, hit_tags

_KINDS = "kinds(is_true, predicted) AS (VALUES (true, true), (true, false), (false, true), (false, false))"


@_query(f"WITH {_INC}, {_KINDS} SELECT is_true, predicted, {_hist('', '')} FROM kinds LEFT JOIN inc USING (is_true, predicted) GROUP BY is_true, predicted")
def incorporation_report(spark, d):
    """Reads and n1 to n10 of true and false junctions that are and are not in the annotation, zeros included."""
    kinds = spark.createDataFrame([(a, b) for a in (True, False) for b in (True, False)], "is_true boolean, predicted boolean")
    return gaps.pivoted_histogram(_incorporated(spark, d), kinds, ["is_true", "predicted"], CAP)


@_query(f"""WITH {_multi('frag, mate')}, spine AS (SELECT unnest(range((SELECT max(k) FROM multi) + 1)) AS k)
    SELECT CAST(spine.k AS BIGINT) AS k, coalesce(actual, 0) AS actual, coalesce(reported, 0) AS reported, coalesce(correct, 0) AS correct FROM spine LEFT JOIN multi USING (k)""")
def multi_intron_read_full(spark, d):
    return metrics.dense(multi_intron_read(spark, d), "k", ["actual", "reported", "correct"])


_VALID = [f"chr{k}" for k in range(1, 9)]


@_query(f"""WITH {A.READS_SQL}, {A.REPORT_SQL}, c AS (SELECT chr AS target, count(*) AS alignments FROM report WHERE (flag & 4) = 0 GROUP BY ALL), v(target) AS (VALUES {', '.join(f"('{c}')" for c in _VALID)})
    SELECT target, v.target IS NOT NULL AS valid, coalesce(alignments, 0) AS alignments FROM v FULL JOIN c USING (target)""")
def target_counts_full(spark, d):
    """Alignments of every valid target, zeros included, and of targets that are not valid."""
    counts = A.report(spark, d).where(~tags.has(F.col("flag"), tags.UNMAPPED)).groupBy(F.col("chr").alias("target")).agg(F.count("*").alias("alignments"))
    return quality.with_valid_ids(counts, spark.createDataFrame([(c,) for c in _VALID], "target string"), "target", "alignments")


@_query(f"""WITH {_MANY}, kept AS (SELECT * FROM many WHERE frag % 10 <> 4), want AS (SELECT o_orderkey AS frag, mate FROM orders CROSS JOIN (VALUES (1), (2)) m(mate)), second AS (SELECT DISTINCT frag, mate FROM kept WHERE (flag & 256) <> 0)
    SELECT mate, frag IN (SELECT frag FROM second) AS by_fragment, EXISTS (SELECT 1 FROM second s WHERE s.frag = w.frag AND s.mate = w.mate) AS by_read, count(*) AS reads FROM want w GROUP BY ALL""")
def ambiguity_categories(spark, d):
    """Reads whose place is ambiguous, judged by the fragment and by the read itself."""
    return quality.ambiguity(hit_tags(spark, d)).groupBy("mate", "by_fragment", "by_read").agg(F.count("*").alias("reads"))


_QNAME = "concat('RUN', CAST(o_orderkey % 2 AS VARCHAR(9)), ':', CAST(o_orderkey % 4 AS VARCHAR(9)), ':', CAST(o_orderkey AS VARCHAR(19)))"


@_query(f"""WITH {_MANY}, per AS (SELECT frag, count(CASE WHEN mate = 1 THEN 1 END) AS n1, count(CASE WHEN mate = 2 THEN 1 END) AS n2 FROM many WHERE (flag & 4) = 0 GROUP BY frag)
    SELECT split_part({_QNAME}, ':', 1) || ':' || split_part({_QNAME}, ':', 2) AS lane, count(*) AS total, count(CASE WHEN n1 > 0 THEN 1 END) AS mate1, count(CASE WHEN n2 > 0 THEN 1 END) AS mate2 FROM orders LEFT JOIN per ON frag = o_orderkey GROUP BY ALL""")
def lane_counts(spark, d):
    fragments = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey AS frag", f"{_QNAME} AS qname").select("frag", tags.lane(F.col("qname")).alias("lane"))
    return quality.lane_counts(fragments, _many(spark, d))


_LANES = ORACLE_SQL["lane_counts"]


@_query(f"SELECT lane, CASE WHEN total = 0 THEN 0.0 ELSE least(100 * CAST(mate1 AS DOUBLE) / total, 95.0) END AS mate1, CASE WHEN total = 0 THEN 0.0 ELSE least(100 * CAST(mate2 AS DOUBLE) / total, 95.0) END AS mate2 FROM ({_LANES})")
def lane_percent(spark, d):
    """Per cent of the fragments of a lane with each mate aligned, drawn up to 95."""
    return lane_counts(spark, d).select("lane", *[metrics.percent(F.col(f"mate{k}"), F.col("total"), 95).alias(f"mate{k}") for k in (1, 2)])


@_query(f"SELECT split_part(lane, ':', 1) AS run, min(mate1) AS low, max(mate1) AS high FROM ({_LANES}) GROUP BY ALL")
def lane_range(spark, d):
    return metrics.spread(lane_counts(spark, d).withColumn("run", F.substring_index("lane", ":", 1)), ["run"], "mate1")


#: The alignments of a file with some faults: no mate number, no primary row, sequences too short or too long; some tell their strand.
_SAM = {
    "frag": "frag", "mate": "mate",
    "flag": "CASE WHEN frag % 29 = 3 THEN flag - 64 * mate WHEN (flag & 256) = 0 AND (frag % 41 = 9 OR (frag % 37 = 8 AND mate = 1)) THEN flag + 256 ELSE flag END",
    "cigar": "CASE WHEN (flag & 4) <> 0 THEN cigar WHEN frag % 31 = 2 THEN '70M' WHEN frag % 31 = 5 THEN '50M10I20M' ELSE cigar END",
    "fields": "CASE frag % 3 WHEN 0 THEN 'NM:i:1 XS:A:+' WHEN 1 THEN 'NM:i:0' ELSE 'XS:A:-' END",
}
_ITEMS = {
    "Unknown read ID": "(SELECT count(*) FROM k WHERE NOT known)", "Mate number error": "(SELECT count(*) FROM k WHERE known AND NOT mated)", "Non-alignment": "(SELECT count(*) FROM k WHERE known AND mated AND (flag & 4) <> 0)",
    "Extra primary alignment": "(SELECT sum(greatest(p1 - 1, 0) + greatest(p2 - 1, 0)) FROM per)", "Only secondary alignment for mate": "(SELECT count(*) FROM per WHERE n1 > 0 AND p1 = 0 AND p2 > 0)",
    "Only secondary alignment for fragment": "(SELECT count(*) FROM per WHERE n1 > 0 AND p1 = 0 AND p2 = 0)", "Max alignments for any read": "(SELECT max(greatest(n1, n2)) FROM per)", "Short sequence": "(SELECT count(*) FROM good WHERE len < 76)",
    "Long sequence": "(SELECT count(*) FROM good WHERE len > 76)", "Spliced": "(SELECT count(*) FROM good WHERE cigar LIKE '%N%')", "Spliced XS": "(SELECT count(*) FROM good WHERE cigar LIKE '%N%' AND fields LIKE '%XS:A:%')",
    "Unspliced": "(SELECT count(*) FROM good WHERE cigar NOT LIKE '%N%')", "Unspliced XS": "(SELECT count(*) FROM good WHERE cigar NOT LIKE '%N%' AND fields LIKE '%XS:A:%')",
}


@_query(f"""WITH {_MANY}, sam AS (SELECT {', '.join(f'{x} AS {name}' for name, x in _SAM.items())} FROM many), k AS (SELECT *, frag % 19 <> 5 AS known, (flag & 192) IN (64, 128) AS mated FROM sam),
    good AS (SELECT *, list_sum([CAST(x AS INTEGER) FOR x IN regexp_extract_all(cigar, '([0-9]+)[MIS=X]', 1)]) AS len FROM k WHERE known AND mated AND (flag & 4) = 0),
    per AS (SELECT frag, count(CASE WHEN (flag & 64) <> 0 THEN 1 END) AS n1, count(CASE WHEN (flag & 128) <> 0 THEN 1 END) AS n2, count(CASE WHEN (flag & 64) <> 0 AND (flag & 256) = 0 THEN 1 END) AS p1, count(CASE WHEN (flag & 128) <> 0 AND (flag & 256) = 0 THEN 1 END) AS p2 FROM good GROUP BY frag)
    """ + " UNION ALL ".join(f"SELECT '{item}' AS item, CAST(coalesce({x}, 0) AS BIGINT) AS n" for item, x in _ITEMS.items()))
def qc_misc(spark, d):
    sam = _many(spark, d).selectExpr(*[f"{x} AS {name}" for name, x in _SAM.items()]).withColumn("tags", F.split("fields", " "))
    known = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 19 <> 5").select(F.col("o_orderkey").alias("frag"))  # the reads that were sequenced
    return quality.checks(sam, known, A.LENGTH)


_BASES = "CASE frag % 3 WHEN 0 THEN repeat('ACGT', 19) WHEN 1 THEN concat(repeat('ACGT', 5), 'N', repeat('ACGT', 13), 'ACN') ELSE concat('NN', repeat('GATC', 18), 'AN') END"
_MD = "CASE frag % 4 WHEN 0 THEN '76' WHEN 1 THEN '20N40A14' WHEN 2 THEN '0N1N73' ELSE '20N5^NA50' END"


@_query(f"""WITH {A.READS_SQL}, {A.ops_sql('ops', 'reads')}, r AS (SELECT frag, mate, {_BASES} AS bases, {_MD} AS md, CAST(frag % 9 AS INTEGER) AS nm FROM reads),
    clip AS (SELECT frag, mate, max(CASE WHEN i = 0 AND op = 'S' THEN l ELSE 0 END) AS s, sum(CASE WHEN op IN ('I', 'D') THEN l ELSE 0 END) AS indel FROM ops GROUP BY ALL),
    aligned AS (SELECT frag, mate, q + unnest(range(l)) AS j FROM ops WHERE op = 'M'), rn AS (SELECT DISTINCT frag, mate, j - s AS p FROM aligned JOIN r USING (frag, mate) JOIN clip USING (frag, mate) WHERE substr(bases, CAST(j + 1 AS BIGINT), 1) = 'N'),
    mds AS (SELECT md, regexp_extract_all(regexp_replace(md, '\\^[A-Z]+', ':', 'g'), '[0-9]+|[A-Z:]') AS a FROM (SELECT DISTINCT md FROM r)), tok AS (SELECT md, i, a[i + 1] AS x FROM (SELECT md, a, unnest(range(len(a))) AS i FROM mds)),
    at_ AS (SELECT md, x, coalesce(sum(CASE WHEN x = ':' THEN 0 ELSE coalesce(TRY_CAST(x AS INTEGER), 1) END) OVER (PARTITION BY md ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM tok), mn AS (SELECT md, p FROM at_ WHERE x = 'N'),
    own AS (SELECT rn.frag, rn.mate, count(*) AS n FROM rn JOIN r USING (frag, mate) WHERE NOT EXISTS (SELECT 1 FROM mn WHERE mn.md = r.md AND mn.p = rn.p) GROUP BY ALL), ref AS (SELECT md, count(*) AS n FROM mn GROUP BY md)
    SELECT CAST(greatest(nm - indel - coalesce(own.n, 0) - coalesce(ref.n, 0), 0) AS INTEGER) AS mismatches, count(*) AS reads FROM r JOIN clip USING (frag, mate) LEFT JOIN own USING (frag, mate) LEFT JOIN ref USING (md) GROUP BY ALL""")
def mismatches_without_n(spark, d):
    r = A.reads(spark, d).selectExpr("cigar", f"{_BASES} AS bases", f"{_MD} AS md", "CAST(frag % 9 AS INT) AS nm")
    kinds = r.groupBy("cigar", "bases", "md", "nm").agg(F.count("*").alias("n"))  # equal alignments are walked once
    return quality.mismatches_without_n(kinds).groupBy(F.col("nm").alias("mismatches")).agg(F.sum("n").alias("reads"))
