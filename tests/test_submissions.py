import pytest
from junctura.operators import accuracy, submissions
from pyspark.sql import functions as F

TX = "submission string, tx_id string, chr string, strand string, exons array<struct<s:int,e:int>>"


def gtf(*exons):
    return "".join(f'c\tx\texon\t{s}\t{e}\t.\t{strand}\t.\tgene_id "g"; transcript_id "{t}";\n' for t, strand, s, e in exons)


def test_folders_without_a_file_have_no_transcripts(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    (tmp_path / "a" / "transcripts.gtf").write_text(gtf(("t", "+", 1, 9), ("t", "+", 20, 30)))
    found, sets = submissions.from_folders(spark, {k: f"{tmp_path}/{k}" for k in ("a", "b", "c")})
    assert [(r.submission, r.tx_id) for r in found.collect()] == [("a", "t")] and sorted(r[0] for r in sets.collect()) == ["a", "b", "c"]
    stats = {r.submission: r for r in submissions.report(found, found, sets, ["submission"]).collect()}
    assert (stats["a"].ref_tx_corr, stats["a"].pred_tx, stats["a"].ref_exons_corr, stats["a"].pred_exons_corr) == (1, 1, 2, 2)
    assert stats["b"].ref_tx == 1 and stats["b"].pred_tx == stats["b"].ref_exons_corr == 0
    assert submissions.rates(submissions.report(found, found, sets, ["submission"])).where("submission = 'c'").first().tx_prec is None
    none, _ = submissions.from_folders(spark, {"b": f"{tmp_path}/b"})
    assert none.count() == 0


def graded(spark, ref, pred, stranded):
    r, p = (spark.createDataFrame([("s", *x) for x in rows], TX) for rows in (ref, pred))
    return submissions.report(r, p, spark.createDataFrame([("s",)], "submission string"), ["submission"], stranded=stranded).first()


REF = [("r1", "c", "+", [(10, 20), (40, 50), (70, 90)]), ("r2", "c", "-", [(200, 300)])]


@pytest.mark.parametrize(
    "pred, stranded, want",  # want: predicted patterns, right, in part, wrong; predicted exons, right ones
    [
        (("+", [(10, 20), (40, 50), (70, 90)]), (True, True), (1, 1, 0, 0, 3, 3)),
        (("-", [(10, 20), (40, 50), (70, 90)]), (True, True), (1, 0, 0, 0, 3, 0)),
        (("-", [(10, 20), (40, 50), (70, 90)]), (False, False), (1, 1, 0, 0, 3, 3)),
        ((".", [(10, 20), (40, 50), (70, 90)]), (True, True), (0, 0, 0, 0, 0, 0)),
        ((".", [(10, 20), (40, 50), (70, 90)]), (True, False), (0, 0, 0, 0, 3, 0)),
        ((".", [(10, 20), (40, 50), (70, 90)]), (False, False), (1, 1, 0, 0, 3, 3)),
        (("+", [(15, 20), (40, 48)]), (True, True), (1, 0, 1, 0, 2, 1)),
        (("+", [(15, 20), (40, 50), (71, 90)]), (True, True), (1, 0, 0, 1, 3, 2)),
        ((".", [(200, 290)]), (True, False), (0, 0, 0, 0, 1, 1)),
        ((".", [(200, 290)]), (False, True), (0, 0, 0, 0, 1, 0)),
        (("-", [(200, 240)]), (True, True), (0, 0, 0, 0, 1, 0)),
    ],
)
def test_strands_and_grades(spark, pred, stranded, want):
    x = graded(spark, REF, [("p", "c", *pred), ("q", "c", *pred)], stranded)
    assert (x.pred_tx, x.pred_tx_corr, x.pred_tx_part, x.pred_tx_wrong, x.pred_exons, x.pred_exons_corr) == want


READ = "frag long, mate int, amb boolean, flag int, chr string, pos int, cigar string"


def test_one_exchange_of_reads_and_errors(spark):
    t = spark.createDataFrame([(1, 1, False, 65, "c", 5, "30M50N46M"), (1, 2, False, 129, "c", 5, "76M")], READ)
    depth = spark.createDataFrame([("c", 35, 50, 3)], "chr string, start int, len int, reads long")
    assert [tuple(r) for r in accuracy.intron_events(t, t, depth, 76, strict=True).collect()] == [("tp", False, 29, 3)]
    assert accuracy.intron_events(t, t.limit(0), depth.limit(0), 76).first().event == "fn"
    with pytest.raises(Exception, match="no coverage for the true junction c:35:50"):
        accuracy.intron_events(t, t, depth.limit(0), 76, strict=True).collect()
    for both in ((t.union(t), t), (t, t.union(t))):
        with pytest.raises(Exception, match="several rows"):
            accuracy.multi_intron(*both, ["frag"]).collect()
    for df in (accuracy.multi_intron(t, t, ["frag"]), accuracy.indel_accuracy(t, t)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(frag") == 1 and "mate" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    assert {r.k: (r.actual, r.reported, r.correct) for r in accuracy.multi_intron(t, t.where(F.col("mate") == 2), ["frag", "mate"]).collect()} == {0: (1, 2, 2), 1: (1, 0, 0)}
