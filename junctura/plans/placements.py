"""Queries over placements that may move: reads with indels in repeats, clipped reads and insertions at their ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from junctura.operators import placement
from junctura.plans import adapters as A
from junctura.plans.queries import _query

_KIND = "CAST((o_orderkey + 5 * mate) % 11 AS INTEGER)"
#: True placements: movable indels, one beside the other, clipped ends, introns with a deletion, insertions cut off by an end of the read.
_CIGARS = ("76M", "20M2D56M", "40M3I33M", "5S71M", "2I74M", "72M4I", "30M500N46M", "20M2D10M3D46M", "10M2I20M4D44M", "30M10N46M", "15M500N20M2D41M")
_MOVED = ("76M", "22M2D54M", "38M3I35M", "5S71M", "1S1I74M", "72M3I1S", "31M500N45M", "21M2D10M3D45M", "11M2I19M4D44M", "29M10N47M", "15M500N21M2D40M")


def _pick(kinds: tuple[str, ...], kind: str) -> str:
    return "CASE " + kind + " ".join(f" WHEN {k} THEN '{c}'" for k, c in enumerate(kinds)) + " END"


TRUTH = {**A.READ, "kind": _KIND, "cigar": _pick(_CIGARS, _KIND), "chr": "concat('chr', CAST(1 + o_custkey % 5 AS VARCHAR(9)))"}
#: The report is right, moved within the repeat, one base off, clipped, absent, or elsewhere.
REPORT = {
    "frag": "frag", "mate": "mate",
    "flag": "CASE WHEN frag % 29 = 7 THEN flag + 4 WHEN frag % 31 = 8 THEN CASE WHEN (flag & 16) = 0 THEN flag + 16 ELSE flag - 16 END ELSE flag END",
    "chr": "CASE WHEN frag % 29 = 7 THEN '*' WHEN frag % 23 = 5 THEN 'chr9' ELSE chr END",
    "pos": "CASE WHEN frag % 29 = 7 THEN 0 WHEN frag % 17 = 3 THEN pos + 1 WHEN frag % 17 = 4 THEN pos + 2000 ELSE pos END",
    "cigar": "CASE WHEN frag % 29 = 7 THEN '*' WHEN frag % 4 < 2 THEN " + _pick(_MOVED, "kind") + " WHEN frag % 13 = 4 THEN '76M' WHEN frag % 37 = 2 THEN '10S60M6S' ELSE cigar END",
}
_LEFT, _RIGHT = "CAST(t % 4 AS INTEGER)", "CAST(CAST((t - t % 20) / 20 AS INTEGER) % 5 AS INTEGER)"
#: Known shifts of true indels; those at an end of a read are of an insertion that is two bases longer.
_SIZE = "CASE WHEN op = 'I' AND terminal THEN l + 2 ELSE l END"


def truth(spark, d):
    orders = A._table(spark, d, "orders").select("o_orderkey", "o_custkey", F.explode(F.array(F.lit(1), F.lit(2))).alias("mate"))
    return A._select(orders, TRUTH)


def report(spark, d):
    return A._select(truth(spark, d).where("frag % 41 <> 9"), REPORT)


def shifts(spark, d):
    from junctura.operators import ambiguity

    placed = truth(spark, d).select("flag", "chr", "pos", "cigar").distinct()  # each placement is walked once
    found = ambiguity.indels(placed, ["chr"]).where("t % 7 <> 0").selectExpr("chr", "op", "t", f"{_SIZE} AS size").distinct()
    return found.selectExpr("*", f"{_LEFT} AS ls", f"{_RIGHT} AS rs")


def allowed_sql(most: int) -> str:
    """SQL that judges report against truth base by base, with shifts (chr, op, t, size, ls, rs) of fewer than `most` bases: v has a row for each true read."""
    return f"""small AS (SELECT frag, mate, chr, CASE WHEN op = 'I' THEN 'I' ELSE 'D' END AS op, i, q - CASE WHEN op = 'I' THEN 0 ELSE 1 END AS q, t, l, q = 0 OR i = n - 1 AS terminal FROM top WHERE op = 'I' OR ({A.SHORT_GAP})),
    ti AS (SELECT s.frag, s.mate, s.op, s.i, s.q, s.t, s.l, coalesce(max(k.ls), 0) AS ls, coalesce(max(k.rs), 0) AS rs FROM small s
        LEFT JOIN shifts k ON k.chr = s.chr AND k.op = s.op AND k.t = s.t AND (k.size = s.l OR (s.op = 'I' AND s.terminal AND k.size > s.l)) GROUP BY ALL),
    js AS (SELECT unnest(range(76)) AS j), steps AS (SELECT unnest(range(1, {most})) AS i),
    tb AS (SELECT frag, mate, q + k AS j, CASE op WHEN 'I' THEN 2 * t - 1 WHEN 'M' THEN 2 * (t + k) END AS c FROM (SELECT *, unnest(range(l)) AS k FROM top WHERE op IN ('M', 'I', 'S'))),
    rb AS (SELECT frag, mate, q + k AS j, CASE op WHEN 'I' THEN 2 * t - 1 WHEN 'M' THEN 2 * (t + k) END AS c FROM (SELECT *, unnest(range(l)) AS k FROM rop0 WHERE op IN ('M', 'I', 'S'))),
    allowed AS (
        SELECT frag, mate, j, c FROM tb WHERE c IS NOT NULL
        UNION SELECT frag, mate, j, 2 * (t + l - 1 - q + j) FROM ti, js WHERE op = 'D' AND j > q - ls AND j <= q
        UNION SELECT frag, mate, j, 2 * (t - 1 + j - q) FROM ti, js WHERE op = 'D' AND j > q AND j <= q + rs
        UNION SELECT frag, mate, j, 2 * (t - k.i) FROM ti, js, steps k WHERE op = 'I' AND k.i <= ls AND j = q - k.i + l
        UNION SELECT frag, mate, j, 2 * (t - k.i) - 1 FROM ti, js, steps k WHERE op = 'I' AND k.i <= ls AND j >= q - k.i AND j < q - k.i + l
        UNION SELECT frag, mate, j, 2 * (t - 1 + k.i) FROM ti, js, steps k WHERE op = 'I' AND k.i <= rs AND j = q - 1 + k.i
        UNION SELECT frag, mate, j, 2 * (t - 1 + k.i) + 1 FROM ti, js, steps k WHERE op = 'I' AND k.i <= rs AND j > q - 1 + k.i AND j <= q - 1 + k.i + l),
    hits AS (SELECT frag, mate, count(*) AS n FROM rb JOIN allowed USING (frag, mate, j, c) GROUP BY ALL),
    placed AS (SELECT frag, mate, count(c) AS n FROM rb GROUP BY ALL),
    meets AS (SELECT DISTINCT rb.frag, rb.mate FROM rb JOIN allowed a ON a.frag = rb.frag AND a.mate = rb.mate AND a.c = rb.c),
    gapped AS (SELECT DISTINCT frag, mate FROM top WHERE {A.LONG_GAP} AND i > 0 AND i < n - 1),
    pair AS (SELECT t.frag, t.mate, t.amb, gapped.frag IS NOT NULL AS spliced, coalesce((r.flag & 4) = 0, false) AS aligned, coalesce((r.flag & 4) = 0 AND t.chr = r.chr AND (t.flag & 16) = (r.flag & 16), false) AS same, t.pos = r.pos AND t.cigar = r.cigar AS match
        FROM truth t LEFT JOIN report r USING (frag, mate) LEFT JOIN gapped USING (frag, mate)),
    v0 AS (SELECT pair.*, same AND match AS equal, CASE WHEN same AND match THEN 76 WHEN same THEN coalesce(hits.n, 0) ELSE 0 END AS good, coalesce(placed.n, 0) AS placed_n, meets.frag IS NOT NULL AS met
        FROM pair LEFT JOIN hits USING (frag, mate) LEFT JOIN placed USING (frag, mate) LEFT JOIN meets USING (frag, mate)),
    v AS (SELECT *, CASE WHEN equal THEN 0 ELSE placed_n - good END AS bad, CASE WHEN good = 76 THEN 'perfect' WHEN good > 0 THEN 'partial' WHEN same AND met THEN 'overlap' ELSE 'none' END AS verdict FROM v0)"""


_SHIFTS_SQL = f"""known AS (SELECT chr, CASE WHEN op = 'I' THEN 'I' ELSE 'D' END AS op, t, l, q = 0 OR i = n - 1 AS terminal FROM top WHERE op = 'I' OR ({A.SHORT_GAP})),
    shifts AS (SELECT DISTINCT chr, op, t, {_SIZE} AS size, {_LEFT} AS ls, {_RIGHT} AS rs FROM known WHERE t % 7 <> 0)"""
_SQL = f"""truth AS (SELECT {A._sql(TRUTH)} FROM orders CROSS JOIN (VALUES (1), (2)) m(mate)), report AS (SELECT {A._sql(REPORT)} FROM truth WHERE frag % 41 <> 9),
    {A.ops_sql('top', 'truth')}, {A.ops_sql('rop0', "(SELECT *, false AS amb FROM report)")}, {_SHIFTS_SQL}, {allowed_sql(6)}"""


@_query(f"""WITH {_SQL}, cats(cat) AS (VALUES ('uni_contig'), ('uni_spliced'), ('amb_contig'), ('amb_spliced')),
    got AS (SELECT concat(CASE WHEN amb THEN 'amb' ELSE 'uni' END, CASE WHEN spliced THEN '_spliced' ELSE '_contig' END) AS cat, sum(good) AS a, sum(bad) AS b, count(CASE WHEN aligned THEN 1 END) AS c, count(CASE WHEN verdict = 'overlap' THEN 1 END) AS d,
        count(CASE WHEN verdict = 'partial' THEN 1 END) AS e, count(CASE WHEN verdict = 'perfect' THEN 1 END) AS f, count(*) AS g FROM v GROUP BY ALL)
    SELECT cat, CAST(coalesce(a, 0) AS BIGINT) AS bases_right, CAST(coalesce(b, 0) AS BIGINT) AS bases_wrong, coalesce(c, 0) AS aln, coalesce(d, 0) AS overlap, coalesce(e, 0) AS some_right, coalesce(f, 0) AS perfect,
        coalesce(g, 0) AS total_reads, coalesce(g, 0) * 76 AS total_bases FROM cats LEFT JOIN got USING (cat)""")
def general_table_shifted(spark, d):
    """The whole general table, with indels that can move, equal clipped placements and insertions that an end of the read cuts off."""
    return placement.general_table(placement.counted_verdicts(placement.met(truth(spark, d), report(spark, d)), shifts(spark, d), A.LENGTH), A.LENGTH)


@_query(f"""WITH {_SQL} SELECT concat(CASE WHEN v.amb THEN 'amb' ELSE 'uni' END, CASE WHEN spliced THEN '_spliced' ELSE '_contig' END) AS cat, CAST(sum(good) AS BIGINT) AS bases_right, count(CASE WHEN aligned THEN 1 END) AS aln, count(*) AS total_reads
    FROM v JOIN truth t USING (frag, mate) WHERE t.chr <> 'chr3' GROUP BY ALL""")
def general_table_without_a_chromosome(spark, d):
    """The general table without the reads of one chromosome, as one without those of mitochondria is made."""
    both = placement.met(truth(spark, d), report(spark, d), without=("chr3",))
    return placement.general_table(placement.counted_verdicts(both, shifts(spark, d), A.LENGTH), A.LENGTH).select("cat", "bases_right", "aln", "total_reads")


@_query(f"""WITH {_SQL} SELECT cigar, verdict, CAST(good AS INTEGER) AS bases, count(*) AS reads FROM v JOIN truth USING (frag, mate) GROUP BY ALL""")
def verdicts_by_placement(spark, d):
    """How reads of each true placement were judged, and how many of their bases are right."""
    judged = placement.counted_verdicts(placement.met(truth(spark, d), report(spark, d)), shifts(spark, d), A.LENGTH)
    return judged.groupBy("cigar", "verdict", F.col("base_right").alias("bases")).agg(F.sum("reads").alias("reads"))


_FAULTS = {
    "unmapped": "(flag & 4) <> 0",
    "elsewhere": "chr = 'chr9'",
    "large indel at its end": "cigar LIKE '%I1S' OR cigar LIKE '1S%'",
    "backward": "(flag & 16) <> 0",
}


@_query(f"""WITH {_SQL}, bad AS ({' UNION ALL '.join(f"SELECT '{k}' AS kind, chr, pos, frag, mate FROM report WHERE {c}" for k, c in _FAULTS.items())}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY chr, pos, frag, mate) AS rank, count(*) OVER (PARTITION BY kind) AS n FROM bad) SELECT kind, n, rank, chr, pos, frag, mate FROM ranked WHERE rank <= 10""")
def first_faults(spark, d):
    """Reports that look faulty: how many of each kind, and the first ten, in one pass."""
    from junctura.operators import contracts

    found = contracts.first_faults(report(spark, d), {k: F.expr(c) for k, c in _FAULTS.items()}, ["chr", "pos", "frag", "mate"], 10)
    return found.select("kind", "n", F.posexplode("first").alias("i", "x")).select("kind", "n", (F.col("i") + 1).cast("long").alias("rank"), "x.*")
