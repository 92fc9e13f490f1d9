"""Queries over reference sequences, indels in them, dense numbers and distribution functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from junctura.operators import annotation, order, placement, reconstruction, sequence
from junctura.plans import adapters as A
from junctura.plans.placements import allowed_sql
from junctura.plans.queries import _query

TILE = 64
#: A sequence for each of five chromosomes, put together from tiles: most are noise, some stretches of several tiles repeat two, three or one bases.
TILES = {
    "chr": "concat('chr', CAST(1 + p_partkey % 5 AS VARCHAR(9)))",
    "tile": "CAST((p_partkey - p_partkey % 5) / 5 AS BIGINT)",
    "seq": "CASE WHEN p_partkey % 70 < 20 THEN repeat('CA', 32) WHEN p_partkey % 70 < 30 THEN repeat('T', 64) ELSE concat(translate(md5(CAST(p_partkey AS VARCHAR(20))), '0123456789abcdef', 'ACGTACGTAACCGGTT'), translate(md5(CAST(p_partkey + 7 AS VARCHAR(20))), '0123456789abcdef', 'ACGTACGTAACCGGTT')) END",
}
#: Indels of the table of orders, in regions of 601 bases. Inserted bases repeat what the stretches hold, or do not.
_SIZE = "CAST(1 + o_orderkey % 5 AS INT)"
INDELS = {
    "frag": "o_orderkey",
    "chr": "concat('chr', CAST(1 + o_custkey % 5 AS VARCHAR(9)))",
    "s": "CAST(1 + (o_orderkey * 31) % 1600 AS INT)",
    "e": "CAST(601 + (o_orderkey * 31) % 1600 AS INT)",
    "pos": "CAST(20 + (o_custkey * 17) % 500 AS INT)",
    "size": f"CASE WHEN o_orderkey % 2 = 0 THEN -{_SIZE} ELSE {_SIZE} END",
    "seq": f"CASE WHEN o_orderkey % 2 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN left('CACACA', {_SIZE}) WHEN o_orderkey % 3 = 1 THEN left('TTTTTT', {_SIZE}) ELSE left('ACGGTA', {_SIZE}) END",
}
#: Where the true reads of those indels are reported: up to four bases further on in the read.
_READ = "CASE WHEN size < 0 THEN concat({a}, 'M', -size, 'D', 76 - {a}, 'M') ELSE concat({a}, 'M', size, 'I', 76 - {a} - size, 'M') END"
TRUE_READ = {"frag": "frag", "mate": "1", "amb": "frag % 7 = 0", "flag": "CAST(65 AS INT)", "chr": "chr", "pos": "CAST(s + pos - 20 AS INT)", "cigar": _READ.format(a="20")}
REPORTED = TRUE_READ | {"cigar": _READ.format(a="CAST(20 + frag % 5 AS INT)")}


def tiles(spark, d):
    return A._select(A._table(spark, d, "part"), TILES)


def indels(spark, d):
    return A._select(A._table(spark, d, "orders"), INDELS)


_SQL = f"""tiles AS (SELECT {A._sql(TILES)} FROM part), genome AS (SELECT chr, string_agg(seq, '' ORDER BY tile) AS seq FROM tiles GROUP BY chr), indel AS (SELECT {A._sql(INDELS)} FROM orders),
    spots AS (SELECT DISTINCT i.chr, CASE WHEN size < 0 THEN 'D' ELSE 'I' END AS op, s + pos AS t, abs(size) AS size, substr(g.seq, s, pos) AS before, substr(g.seq, s + pos + CASE WHEN size < 0 THEN -size ELSE 0 END, e - (s + pos + CASE WHEN size < 0 THEN -size ELSE 0 END) + 1) AS after,
        CASE WHEN size < 0 THEN substr(g.seq, s + pos, -size) ELSE i.seq END AS event FROM indel i JOIN genome g USING (chr)),
    ks AS (SELECT unnest(range(0, 602)) AS k),
    sides AS (SELECT *, repeat(event, 602) AS onward, repeat(reverse(event), 602) AS backward, reverse(before) AS erofeb FROM spots),
    moves AS (SELECT chr, op, t, size, event, length(before) AS lb, length(after) AS la, CAST(max(CASE WHEN k <= length(before) AND left(erofeb, k) = left(backward, k) THEN k END) AS INTEGER) AS ls, CAST(max(CASE WHEN k <= length(after) AND left(after, k) = left(onward, k) THEN k END) AS INTEGER) AS rs FROM sides, ks GROUP BY ALL)"""


@_query(f"WITH {_SQL} SELECT chr, op, t, size, ls, rs, count(*) AS places FROM moves WHERE ls > 0 OR rs > 0 GROUP BY ALL")
def indel_shift_table(spark, d):
    """The indels that can move and how far, from the sequence tiles that they stand in."""
    found = sequence.indel_shifts(indels(spark, d).drop("frag"), tiles(spark, d), TILE)
    return found.where("ls > 0 OR rs > 0").groupBy("chr", "op", "t", "size", "ls", "rs").agg(F.count("*").alias("places"))


@_query(f"""WITH {_SQL}, truth AS (SELECT {A._sql(TRUE_READ)} FROM indel), report AS (SELECT {A._sql(REPORTED)} FROM indel),
    {A.ops_sql('top', 'truth')}, {A.ops_sql('rop0', 'report')}, shifts AS (SELECT DISTINCT chr, op, t, size, least(ls, 60) AS ls, least(rs, 60) AS rs FROM moves),
    {allowed_sql(61)}
    SELECT verdict, CAST(good AS INTEGER) AS bases, count(*) AS reads FROM v GROUP BY ALL""")
def moved_reads_scored(spark, d):
    """Reads whose indels were reported further on, scored with the shifts that the sequence gives: from indel table to score in one plan."""
    i = indels(spark, d)
    found = sequence.indel_shifts(i.drop("frag"), tiles(spark, d), TILE)
    known = found.withColumns({c: F.least(c, F.lit(60)) for c in ("ls", "rs")})  # a read has 76 bases; further moves leave it
    judged = placement.counted_verdicts(placement.met(A._select(i, TRUE_READ), A._select(i, REPORTED)), known, A.LENGTH)
    return judged.groupBy("verdict", F.col("base_right").alias("bases")).agg(F.sum("reads").alias("reads"))


@_query(f"""WITH {_SQL}, asked AS (SELECT DISTINCT chr, s, e FROM indel) SELECT chr, s, e, md5(substr(seq, s, 601)) AS md5, length(substr(seq, s, 601)) AS bases FROM asked JOIN genome USING (chr)""")
def sequence_slices(spark, d):
    """The regions of the indels cut out of the tiles."""
    asked = indels(spark, d).select("chr", "s", "e").distinct()
    return sequence.slices(asked, tiles(spark, d), TILE).select("chr", "s", "e", F.md5("seq").alias("md5"), F.length("seq").cast("long").alias("bases"))


_INTRONS = f"{A.exons_sql()}, k AS (SELECT tx_id, chr, strand, list({{'left': e, 'right': nxt}} ORDER BY s) AS introns FROM (SELECT *, lead(s) OVER (PARTITION BY tx_id ORDER BY s, e) AS nxt FROM exons) WHERE nxt IS NOT NULL GROUP BY ALL)"


@_query(f"WITH {_INTRONS} SELECT tx_id, dense_rank() OVER (ORDER BY chr, strand, introns) AS pattern_id FROM k")
def pattern_ids(spark, d):
    """Splice patterns numbered without gaps, and the transcripts that have each."""
    return reconstruction.pattern_ids(A.transcripts(spark, d))


_SIZES = f"{A.exons_sql()}, {A.splices_sql('splices', 'exons')}, sizes AS (SELECT rgt - lft - 1 AS size FROM splices)"


def _intron_sizes(spark, d):
    return annotation.introns(A.transcripts(spark, d)).select((F.col("right") - F.col("left") - 1).alias("size"))


@_query(f"WITH {_SIZES} SELECT size, CAST(sum(count(*)) OVER (ORDER BY size) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM sizes GROUP BY size")
def intron_size_ecdf(spark, d):
    """The share of annotated introns of each size or less."""
    return order.ecdf(_intron_sizes(spark, d), "size")


GRID = order.exponential_grid(1.0, 5000.0, 40)


@_query(f"WITH {_SIZES}, grid(x) AS (VALUES {', '.join(f'(CAST({x!r} AS DOUBLE))' for x in GRID)}) SELECT x, CAST((SELECT count(*) FROM sizes WHERE size <= x) AS DOUBLE) / (SELECT count(*) FROM sizes) AS share FROM grid")
def intron_size_curve(spark, d):
    """The same at points of equal ratios, as a curve over a logarithmic axis has them."""
    return order.sampled(order.ecdf(_intron_sizes(spark, d), "size"), "size", GRID)
