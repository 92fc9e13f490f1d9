"""Alignments and annotation derived from the star-schema tables, by the same expressions for Spark and for the SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LENGTH = 76
CIGAR = "CASE WHEN o_orderkey % 23 = 4 THEN '30M25D46M' WHEN o_orderkey % 23 = 9 THEN '30M10N46M' WHEN o_orderkey % 23 = 15 THEN '76M40N' ELSE CASE (o_orderkey + 3 * mate) % 6 WHEN 0 THEN '76M' WHEN 1 THEN '30M500N46M' WHEN 2 THEN '20M2D56M' WHEN 3 THEN '40M3I33M' WHEN 4 THEN '5S71M' ELSE '10M100N20M200N46M' END END"
READ = {
    "frag": "o_orderkey",
    "mate": "mate",
    "amb": "o_orderkey % 7 = 0",
    "flag": "CAST(1 + 64 * mate + 16 * ((o_custkey + mate) % 2) AS INT)",
    "chr": "CASE WHEN o_custkey % 11 = 0 THEN 'chr6' ELSE concat('chr', CAST(1 + o_custkey % 5 AS VARCHAR(9))) END",
    "pos": "CAST(1000 + (o_custkey % 37) * 100 AS INT)",
    "cigar": CIGAR,
}
#: What a report makes of a true read: some unmapped, on another chromosome or strand, shifted, or without their gaps.
REPORT = {
    "frag": "frag", "mate": "mate", "amb": "amb",
    "flag": "CASE WHEN frag % 5 = 2 AND mate = 1 THEN flag + 4 WHEN frag % 17 = 6 THEN CASE WHEN (flag & 16) = 0 THEN flag + 16 ELSE flag - 16 END ELSE flag END",
    "chr": "CASE WHEN frag % 5 = 2 AND mate = 1 THEN '*' WHEN frag % 7 = 5 THEN 'chr9' ELSE chr END",
    "pos": "CASE WHEN frag % 5 = 2 AND mate = 1 THEN 0 WHEN frag % 11 = 3 THEN pos + 1 ELSE pos END",
    "cigar": "CASE WHEN frag % 5 = 2 AND mate = 1 THEN '*' WHEN frag % 13 = 4 THEN '76M' ELSE cigar END",
}
#: On chr6 stand few transcripts, so most of their introns lie in no exon. Up to three exons whose inner ends stand where the reads have their gaps.
EXON = {
    "tx_id": "p_partkey",
    "gene_id": "p_partkey % 97",
    "chr": "CASE WHEN p_partkey % 500 = 7 THEN 'chr6' ELSE concat('chr', CAST(1 + p_partkey % 5 AS VARCHAR(9))) END",
    "strand": "CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '+' END",
    "s": "CAST(CASE x WHEN 0 THEN 900 + (p_partkey % 37) * 100 WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 1530 ELSE 1110 END + (p_partkey % 37) * 100 ELSE 1330 + 300 * (p_partkey % 2) + (p_partkey % 37) * 100 END AS INT)",
    "e": "CAST(CASE x WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 1029 ELSE 1009 END + (p_partkey % 37) * 100 WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 1600 ELSE 1129 END + (p_partkey % 37) * 100 ELSE 1400 + 300 * (p_partkey % 2) + (p_partkey % 37) * 100 END AS INT)",
}
EXON_ROWS = "x = 0 OR (x = 1 AND p_partkey % 4 <> 1) OR (x = 2 AND p_partkey % 4 = 3)"
REPEAT = {"chr": "concat('chr', CAST(1 + s_suppkey % 5 AS VARCHAR(9)))", "s": "CAST(1000 + (s_suppkey * 37) % 4000 AS INT)", "e": "CAST(1000 + (s_suppkey * 37) % 4000 + 20 + s_suppkey % 50 AS INT)"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{x} AS {name}" for name, x in columns.items()])


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("mate"))
    return _select(orders, READ)


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(reads(spark, sf_dir), REPORT)


def exons(spark: SparkSession, sf_dir: str, rows: str = "true") -> DataFrame:
    part = _table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(*map(F.lit, range(3)))).alias("x"))
    return _select(part.where(EXON_ROWS).where(rows), EXON)


def transcripts(spark: SparkSession, sf_dir: str, rows: str = "true") -> DataFrame:
    e = exons(spark, sf_dir, rows)
    return e.groupBy("tx_id", "gene_id", "chr", "strand").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("exons"))


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_table(spark, sf_dir, "supplier"), REPEAT)


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {name}" for name, x in columns.items())


READS_SQL = f"reads AS (SELECT {_sql(READ)} FROM orders CROSS JOIN (VALUES (1), (2)) m(mate))"
REPORT_SQL = f"report AS (SELECT {_sql(REPORT)} FROM reads)"


def exons_sql(name: str = "exons", rows: str = "true") -> str:
    return f"{name} AS (SELECT {_sql(EXON)} FROM part CROSS JOIN (VALUES (0), (1), (2)) m(x) WHERE ({EXON_ROWS}) AND ({rows}))"


REPEATS_SQL = f"repeats AS (SELECT {_sql(REPEAT)} FROM supplier)"


def ops_sql(name: str, source: str) -> str:
    """All operations of the mapped rows of source: its keys, i, l, op, q, t, n."""
    q = "CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN l ELSE 0 END"
    t = "CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN l ELSE 0 END"
    return f"""{name}_a AS (SELECT *, regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]') AS a FROM {source} WHERE (flag & 4) = 0),
        {name}_b AS (SELECT frag, mate, amb, flag, chr, pos, len(a) AS n, a, unnest(range(len(a))) AS i FROM {name}_a),
        {name}_c AS (SELECT * EXCLUDE (a), CAST(regexp_extract(a[i + 1], '[0-9]+') AS INTEGER) AS l, right(a[i + 1], 1) AS op FROM {name}_b),
        {name} AS (SELECT *, CAST(coalesce(sum({q}) OVER w, 0) AS INTEGER) AS q, CAST(pos + coalesce(sum({t}) OVER w, 0) AS INTEGER) AS t FROM {name}_c
                   WINDOW w AS (PARTITION BY frag, mate ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def introns_sql(name: str, ops: str, kind: str = "op = 'N'") -> str:
    return f"{name} AS (SELECT frag, mate, amb, flag, chr, t AS start, l AS len, q FROM {ops} WHERE {kind} AND i > 0 AND i < n - 1)"


LONG_GAP, SHORT_GAP = "op IN ('N', 'D') AND l > 18", "op IN ('N', 'D') AND l <= 18"


JUNCTIONS_SQL = f"{READS_SQL}, {ops_sql('ops', 'reads')}, {introns_sql('gap', 'ops')}, junctions AS (SELECT chr, start, len, count(*) AS reads FROM gap GROUP BY ALL)"


def splices_sql(name: str, exons_: str) -> str:
    return f"{name} AS (SELECT DISTINCT chr, gene_id, e AS lft, nxt AS rgt FROM (SELECT *, lead(s) OVER (PARTITION BY tx_id ORDER BY s, e) AS nxt FROM {exons_}) WHERE nxt IS NOT NULL)"
