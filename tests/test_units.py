import tempfile

import numpy as np
import pytest
from junctura.functions import cigar, shift, tags
from junctura.operators import accuracy, ambiguity, intervals, metrics, order, quality
from junctura.plans import scoring  # noqa: F401  adds its queries
from junctura.plans.queries import QUERIES
from junctura.sources import tables, text
from junctura.streaming import junctions
from pyspark.sql import functions as F


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_walk(spark):
    steps = one(spark, cigar.walk(F.lit("10M2D20M500N46M"), F.lit(100)))[0]
    assert [(x["op"], x["q"], x["t"], x["l"]) for x in steps] == [("M", 0, 100, 10), ("D", 10, 110, 2), ("M", 10, 112, 20), ("N", 30, 132, 500), ("M", 30, 632, 46)]
    steps = one(spark, cigar.walk(F.lit("5S30M3I38M"), F.lit(110)))[0]
    assert [(x["op"], x["q"], x["t"]) for x in steps][2] == ("I", 35, 140)
    assert tuple(one(spark, cigar.query_length(F.lit("5S30M3I38M")), cigar.query_length(F.lit("76=")), F.size(cigar.parse(F.lit("76Q"))), F.size(cigar.parse(F.lit("*"))))) == (76, 76, 0, 0)


@pytest.mark.parametrize("before,event,after,left,right", [("AA", "TTT", "TTAA", 0, 2), ("CGTT", "TTT", "", 2, 0), ("CGC", "AC", "ACACA", 1, 5), ("", "A", "", 0, 0)])
def test_shift(spark, before, event, after, left, right):
    got = one(spark, shift.left_shift(F.lit(before), F.lit(event)), shift.right_shift(F.lit(after), F.lit(event)))
    assert tuple(got) == (left, right)


def test_tags_and_md(spark):
    t = F.array(F.lit("NM:i:3"), F.lit("XS:A:+"))
    assert tuple(one(spark, tags.tag(t, "NM", "int"), tags.tag(t, "XS"), tags.tag(t, "MD"))) == (3, "+", None)
    found = one(spark, tags.mismatches(F.lit("10A5^ACG0T3")))[0]
    assert [(x["p"], x["base"]) for x in found] == [(10, "A"), (16, "T")]
    assert one(spark, tags.mean_quality(F.lit("II?"), 33))[0] == 36
    assert one(spark, tags.edits_without_n(F.lit(5), F.lit(2), F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))))[0] == 1


def test_intervals(spark):
    df = spark.createDataFrame([("c", 1, 10), ("c", 5, 12), ("c", 13, 15), ("c", 30, 40)], "chr string, s int, e int")
    u = intervals.union(df)
    assert sorted(tuple(r) for r in u.collect()) == [("c", 1, 15), ("c", 30, 40)]
    assert [tuple(r) for r in intervals.gaps(u).collect()] == [("c", 16, 29)]
    cut = spark.createDataFrame([("c", 3, 4), ("c", 14, 33)], "chr string, s int, e int")
    assert sorted(tuple(r) for r in intervals.subtract(u, cut).collect()) == [("c", 1, 2), ("c", 5, 13), ("c", 34, 40)]


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.sam").write_text("@HD\tVN:1\nr1\t65\tc1\t100\t9\t10M50N20M\t=\t1\t1\tACGT\tIIII\tNM:i:0\tMD:Z:30\nr2\t69\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    s = text.sam(spark, str(tmp_path / "s/a.sam"))
    assert [(r["qname"], r["flag"], len(r["tags"])) for r in s.collect()] == [("r1", 65, 2), ("r2", 69, 0)]
    (tmp_path / "a.gtf").write_text('c1\tcoding\texon\t10\t20\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\nc1\tcoding\texon\t30\t40\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\n')
    (t,) = text.transcripts(text.gtf(spark, str(tmp_path / "a.gtf"))).collect()
    assert (t["tx_id"], t["gene_id"], [tuple(x) for x in t["exons"]]) == ("t1", "g1", [(10, 20), (30, 40)])
    (tmp_path / "a.fq").write_text("@r1/1\nACGT\n+\n@III\n@r2 2:N:0\nGG\n+\nII\n")
    got = sorted((r["id"], r["mate"], r["seq"], r["qual"]) for r in text.fastq(spark, str(tmp_path / "a.fq")).collect())
    assert got == [("r1", 1, "ACGT", "@III"), ("r2", 2, "GG", "II")]
    q = junctions.counts(spark, str(tmp_path / "s")).writeStream.format("memory").queryName("j").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("j").collect()] == [("c1", 110, 50, 1)]


ALIGNED = "frag long, mate int, flag int, chr string, pos int, cigar string, amb boolean"


def test_indels_match_once_and_in_order(spark):
    t = spark.createDataFrame([(1, 1, 65, "c", 100, "10M2D10M2D56M", False), (2, 1, 65, "c", 100, "30M3I43M", False), (3, 1, 65, "c", 100, "20M2D56M", False)], ALIGNED)
    r = spark.createDataFrame([(1, 1, 65, "c", 100, "12M2D64M", False), (2, 1, 81, "c", 100, "30M3I43M", False)], ALIGNED)
    shifts = spark.createDataFrame([("c", "D", 110, 2, 0, 4), ("c", "D", 122, 2, 12, 0)], "chr string, op string, t int, size int, ls int, rs int")
    got = {tuple(x) for x in ambiguity.indel_verdicts(t, r, shifts, 76).collect()}
    assert got == {("D", 2, 1, 2, 0), ("I", 3, 0, 1, 1)}  # both true deletions could be the reported one; the other strand meets nothing
    assert ambiguity.indel_verdicts(t.limit(0), r.limit(0), shifts, 76).count() == 0


def test_alternatives(spark):
    gap = lambda op, q, t, n, ls, rs: F.struct(*[F.lit(v).alias(k) for k, v in (("op", op), ("q", q), ("t", t), ("l", n), ("ls", ls), ("rs", rs))])
    at = lambda g, js: one(spark, F.transform(F.array(*map(F.lit, js)), lambda j: ambiguity.alternatives(j, g)))[0]
    assert at(gap("D", 1, 3, 3, 0, 2), range(5)) == [[], [], [6], [8], []]  # the bases after the gap may stand before it
    assert at(gap("I", 2, 3, 3, 0, 2), range(7)) == [[], [], [6], [7, 8], [7, 9], [7, 9], [9]]


def test_hit_tags(spark):
    a = spark.createDataFrame([(1, 1, 1, 65, "c", 5, "76M"), (1, 1, 2, 65, "c", 6, "76M"), (1, 1, 3, 321, "c", 7, "76M"), (1, 1, 4, 321, "c", 8, "76M"), (2, 2, 1, 129, "c", 9, "76M")], "frag long, mate int, seq int, flag int, chr string, pos int, cigar string")
    got = sorted(tuple(x)[:4] + (x["flag"], x["pos"]) for x in quality.hit_tags(a, spark.range(1, 4).withColumnRenamed("id", "frag")).collect())
    assert got == [(1, 1, 1, 2, 65, 6), (1, 1, 2, 2, 321, 7), (1, 2, 1, 2, 133, 0), (1, 2, 2, 2, 133, 0), (2, 1, 1, 1, 69, 0), (2, 2, 1, 1, 129, 9), (3, 1, 1, 1, 69, 0), (3, 2, 1, 1, 133, 0)]


def test_territory_takes_every_row_of_the_annotation(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    for name, row in (("part", "explode(array(4, 7)) AS p_partkey"), ("orders", "6 AS o_orderkey, 79 AS o_custkey"), ("supplier", "1 AS s_suppkey")):
        spark.sql(f"SELECT {row}").write.parquet(f"{d}/{name}.parquet")
    got = sorted(map(tuple, QUERIES["intron_territory_whole"](spark, d).collect()))
    assert got == [("chr5", 1430, 1929), ("chr6", 1710, 1809), ("chr6", 1830, 2329)]
    assert tuple(QUERIES["intronic_counts_whole"](spark, d).first()) == (2, 2, 0)


def test_long_gaps_are_introns_and_short_ones_deletions(spark):
    t = spark.createDataFrame([(1, 1, 65, "c", 100, "30M25D46M", False), (2, 1, 65, "c", 100, "30M10N46M", False), (3, 1, 65, "c", 100, "76M40N", False), (4, 1, 65, "c", 100, "30M50N46M", False)], ALIGNED)
    r = t.withColumn("flag", F.when(F.col("frag") == 4, 81).otherwise(F.col("flag")))
    got = {x["frag"]: x["spliced"] for x in accuracy.read_verdicts(accuracy.paired(t, r), 76).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}
    by_read = {x["k"]: (x["actual"], x["reported"], x["correct"]) for x in accuracy.multi_intron(t, r, ["frag", "mate"]).collect()}
    by_pair = {x["k"]: (x["actual"], x["reported"], x["correct"]) for x in accuracy.multi_intron(t, r, ["frag"]).collect()}
    assert by_read == {0: (2, 2, 3), 1: (2, 2, 1)} and by_pair == {0: (2, 2, 2), 1: (2, 2, 2)}  # the other strand counts for pairs alone
    assert [tuple(x) for x in accuracy.indel_accuracy(t, r).collect()] == [("D", 10, 1, 0, 0)]


def test_shift_and_coverage_tables(spark, tmp_path):
    (tmp_path / "shifts.txt").write_text("c1\t110\t-2\t0\t4\nc1\t120\t3\t1\t0\n")
    (tmp_path / "cov.txt").write_text("c1:109-160\t45\nhs:x:5-9\t3\n")
    assert sorted(map(tuple, text.shifts(spark, str(tmp_path / "shifts.txt")).collect())) == [("c1", "D", 110, 2, 0, 4), ("c1", "I", 120, 3, 1, 0)]
    assert sorted(map(tuple, text.coverage(spark, str(tmp_path / "cov.txt")).collect())) == [("c1", 110, 50, 20), ("hs:x", 6, 3, 3)]


@pytest.mark.parametrize("values", [[1.0], [5.0] * 9, [1.0, 2.0, 2.0, 7.5, 1e9, -3.0, 0.25], [float(i * i % 101) for i in range(1000)]])
def test_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    assert metrics.quantiles(df, "v", [0, 1 / 3, 0.5, 1]) == pytest.approx(np.quantile(values, [0, 1 / 3, 0.5, 1]).tolist())
    assert metrics.quantiles(df.limit(0), "v", [0.5]) == [None]


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("values", [[1.0, 2.0, NAN], [NAN] * 3, [INF, 1.0, -INF, 2.0, INF, NAN], [-INF] * 4, [INF, -INF], [5e-324, 0.0, -5e-324, 1.7e308, -1.7e308, 1.0, 1.0], [10.0**k for k in range(-300, 300, 7)], [None, None], [7.0] * 50])
def test_order_statistics_end_on_every_input(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = sorted((v for v in values if v is not None), key=lambda v: (v != v, v))
    got = metrics.order_statistics(df, "v", list(range(len(want))))
    assert len(got) == len(want) and all(a == b or (a != a and b != b) for a, b in zip(got, want))
    numbers = [v for v in want if v == v]
    middle = metrics.quantiles(df, "v", [0.5])
    assert middle == [None] if not numbers else len(middle) == 1


def test_ranks_and_running_sums_over_ranges(spark):
    values = [None, *[i * 37 % 11 for i in range(200)]]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int")
    kinds = {v: k + 1 for k, v in enumerate(sorted(set(values), key=lambda v: (v is not None, v or 0)))}
    assert {(r.v, r.i, r.id) for r in order.dense_ids(df, ["v"]).collect()} == {(v, i, kinds[v]) for i, v in enumerate(values)}
    assert [r["rank"] for r in order.numbered(df, ["v", "i"]).orderBy("rank").collect()] == list(range(1, 202))
    assert order.dense_ids(df.limit(0), ["v"]).count() == order.numbered(df.limit(0), ["v"]).count() == 0


def test_distribution_function(spark):
    values = [1.0, 1.0, 2.0, 5.0, 5.0, 5.0, 40.0, NAN, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    steps = order.ecdf(df, "v")
    assert sorted(map(tuple, steps.collect())) == [(1.0, 2 / 7), (2.0, 3 / 7), (5.0, 6 / 7), (40.0, 1.0)]
    grid = [0.5, 1.0, 1.5, 4.999, 5.0, 39.0, 40.0, 1000.0]
    assert [tuple(r) for r in order.sampled(steps, "v", grid).orderBy("x").collect()] == list(zip(grid, [0.0, 2 / 7, 2 / 7, 3 / 7, 6 / 7, 6 / 7, 1.0, 1.0]))
    assert order.ecdf(df.limit(0), "v").count() == 0 and [r.share for r in order.sampled(steps.limit(0), "v", grid[:2]).collect()] == [0.0, 0.0]
    assert order.exponential_grid(1.0, 100.0, 3) == pytest.approx([1, 10, 100])
    with pytest.raises(ValueError):
        order.sampled(steps, "v", list(range(order.POINTS + 1)))
    for plan in (order.ecdf(df, "v"), order.dense_ids(df, ["v"])):
        text_ = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition(_at" not in text_  # each window runs within a task


def test_union_and_gaps_over_stretches(spark):
    import random

    from junctura.operators import intervals

    random.seed(4)
    rows = [(f"chr{random.randrange(3)}", s, s + random.choice((0, 1, 5, 40))) for s in (random.randrange(1, 900) for _ in range(120))]
    rows += [("chr9", 10, 19), ("chr9", 20, 29), ("chr9", 31, 300), ("chr9", 31, 300), ("chr8", 5, 5)]
    table = spark.createDataFrame(rows, "chr string, s int, e int")
    for stretch in (7, 10, 1 << 16):
        made = intervals.union(table, stretch)
        assert [f.dataType.simpleString() for f in made.schema] == ["string", "int", "int"]
        free = intervals.gaps(made, stretch).collect()
        made = made.collect()
        for chr_ in {r[0] for r in rows}:
            held = {b for c, s, e in rows if c == chr_ for b in range(s, e + 1)}
            want = sorted((b, next(x for x in range(b, 2000) if x + 1 not in held)) for b in held if b - 1 not in held)
            assert sorted((r.s, r.e) for r in made if r.chr == chr_) == want
            assert sorted((r.s, r.e) for r in free if r.chr == chr_) == [(a[1] + 1, b[0] - 1) for a, b in zip(want, want[1:])]
    assert intervals.gaps(intervals.union(table.where("s < 0"))).count() == 0


def test_lane_needs_its_fields(spark):
    import pytest

    from junctura.functions import cigar, tags
    from pyspark.sql import functions as F

    x = spark.createDataFrame([("HW_1:3:22:x",)], "q string")
    assert x.select(tags.lane(F.col("q"))).first()[0] == "HW_1:3"
    with pytest.raises(Exception, match="no lane"):
        spark.createDataFrame([("abc",)], "q string").select(tags.lane(F.col("q"))).collect()
    seqs = spark.createDataFrame([("2S3M", "ACGTA"), ("5M", "*"), ("5M", None)], "c string, b string")
    assert [r[0] for r in seqs.select(cigar.checked_length(F.col("c"), F.col("b"))).collect()] == [5, 5, 5]
    with pytest.raises(Exception, match="does not fit"):
        spark.createDataFrame([("3M", "AC")], "c string, b string").select(cigar.checked_length(F.col("c"), F.col("b"))).collect()
    n = spark.createDataFrame([("2S4M1D2M", "NNANGTCN", "1N2^N2")], "c string, b string, md string")
    assert n.select(cigar.read_n(F.col("c"), F.col("b")), tags.reference_n(F.col("md"))).first() == ([1, 5], [1])


def test_checks_of_an_empty_table(spark):
    from junctura.operators import quality

    none = spark.createDataFrame([], "frag long, flag int, cigar string, tags array<string>")
    got = quality.checks(none, spark.createDataFrame([(1,)], "frag long"), 76).collect()
    assert len(got) == 13 and {r.n for r in got} == {0}


def test_fastq_of_files_read_in_many_blocks(spark, tmp_path):
    from junctura.sources import tables, text

    want = set()
    for f, n in (("a", 90), ("b", 7), ("c", 41)):
        rows = [(f"{f}{i}", 1 + i % 2, "ACGTN"[: 1 + i % 5], "@#+I@"[: 1 + i % 5]) for i in range(n)]
        want |= set(rows)
        (tmp_path / f"{f}.fastq").write_text("".join(f"@{i}/{m}\n{s}\n+\n{q}\n" for i, m, s, q in rows))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(x) for x in names]
    try:
        for x, value in zip(names, ("100b", "1b")):
            spark.conf.set(x, value)
        got = [tuple(r) for r in text.fastq(spark, str(tmp_path)).select("id", "mate", "seq", "qual").collect()]
    finally:
        for x, value in zip(names, before):
            spark.conf.set(x, value)
    assert len(got) == len(want) and set(got) == want


def test_small_tables(spark, tmp_path):
    from junctura.sources import tables, text

    put = lambda name, body: ((tmp_path / name).write_text(body), str(tmp_path / name))[1]
    assert {r.id for r in tables.ids(spark, put("ids", "c1\t9\nc2\t8\nc1\t7\n")).collect()} == {"c1", "c2"}
    sets = put("sets", "id\tname\nx1\tA\ny2\tB\n")
    assert [r.name for r in tables.datasets(spark, sets, "^y").collect()] == ["B"] and tables.datasets(spark, sets).count() == 2
    styles = put("styles", "style\tlty\n1\t5\n")
    assert [(r.name, r.lty) for r in tables.methods(spark, put("m", "name\tstyle\na\t1\n"), styles).collect()] == [("a", "5")]
    with pytest.raises(Exception, match="no style 2"):
        tables.methods(spark, put("m2", "name\tstyle\na\t2\n"), styles).collect()
    own = "tx_id string, exonic long, intronic long"
    level = tables.expression(spark, put("e", "tx_id\texonic\tintronic\nt1\t3\t0\n"), own)
    assert [tuple(r) for r in level.collect()] == [("t1", 3, 0)]
    with pytest.raises(Exception):
        tables.expression(spark, put("e2", "tx\tb\tc\nt1\t3\t0\n")).collect()
    got = tables.after_preamble(spark, put("p", "what\na\tb\n1\t2\n3\t4\n"))
    assert got.columns == ["a", "b"] and sorted(map(tuple, got.collect())) == [("1", "2"), ("3", "4")]
    assert [tuple(r) for r in tables.flags(spark, put("f", "id\tknown\n1\t0\n2\t1\n")).orderBy("id").collect()] == [(1, False), (2, True)]
    with pytest.raises(ValueError):
        tables.flags(spark, put("f2", "id\tknown\n1\t0\n3\t1\n"))
    a = 'c1\tx\texon\t1\t9\t.\t+\t.\tgene_id "g"; transcript_id "t1";\n'
    kept = tables.expressed_lines(spark, put("g", a + a.replace("t1", "t2")), level)
    assert [r.value + "\n" for r in kept.collect()] == [a]
    line = "r1\t65\tc1\t100\t9\t10M\t=\t1\t1\tACGT\tIIII\tNM:i:0\tMD:Z:30"
    tables.write_sam(text.sam(spark, put("s", line + "\n")), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == [line]
    moves = spark.createDataFrame([("c", "D", 5, 2, 0, 1), ("c", "I", 6, 3, 0, 0)], "chr string, op string, t int, size int, ls int, rs int")
    tables.write_shifts(moves, str(tmp_path / "sh"))
    assert [tuple(r) for r in text.shifts(spark, str(tmp_path / "sh")).collect()] == [("c", "D", 5, 2, 0, 1)]
    counts = spark.createDataFrame([("a", True), ("b", False), ("b", False)], "target string, valid boolean")
    assert [r.target for r in tables.invalid_ids(counts).collect()] == ["b"]


def test_levels_as_documented_and_mates_by_file_name(spark, tmp_path):
    (tmp_path / "expr.txt").write_text("id\tsize\texons\treads.exonic\treads.intronic\tfpkm\n1\t900\t2\t5\t0\t1.5\n2\t80\t1\t0\t4\t0.2\n3\t70\t3\t0\t0\t0\n")
    level = tables.expression(spark, str(tmp_path / "expr.txt"))
    assert level.columns == ["id", "size", "exons", "reads_exonic", "reads_intronic", "fpkm"]
    assert sorted(r[0] for r in tables.expressed_ids(level).collect()) == ["1", "2"] and [r[0] for r in tables.expressed_ids(level, True).collect()] == ["1"]
    assert [r["id"] for r in tables.spliced_levels(level).collect()] == ["1"]
    for name, head, mate in (("run_1.fastq", "@r", 1), ("run_2.trimmed.fq", "@r", 2), ("run_1.fq", "@r/2", 2), ("run.fq", "@r", None), ("lane_12.fq", "@r", None)):
        (tmp_path / name).write_text(f"{head}\nAC\n+\nII\n")
        assert [tuple(x) for x in text.fastq(spark, str(tmp_path / name)).collect()] == [("r", mate, "AC", "II")]
