import pytest
from junctura.operators import placement

READ = "frag long, mate int, amb boolean, flag int, chr string, pos int, cigar string"
SHIFT = "chr string, op string, t int, size int, ls int, rs int"


def judge(spark, pairs, shifts=(), length=76):
    """(base_right, base_wrong, verdict) for pairs of (pos, cigar)."""
    t = spark.createDataFrame([(i, 1, False, 65, "c", *a) for i, (a, _) in enumerate(pairs)], READ)
    r = spark.createDataFrame([(i, 1, False, 65, "c", *b) for i, (_, b) in enumerate(pairs) if b], READ)
    found = placement.verdicts(placement.met(t, r), spark.createDataFrame(list(shifts), SHIFT), length)
    return {x["frag"]: (x["base_right"], x["base_wrong"], x["verdict"]) for x in found.collect()}


def test_moved_indels_count_as_right(spark):
    d = [("c", "D", 120, 2, 3, 4), ("c", "I", 140, 3, 2, 0)]
    got = judge(spark, [((100, "20M2D56M"), (100, "23M2D53M")), ((100, "20M2D56M"), (100, "17M2D59M")), ((100, "20M2D56M"), (100, "16M2D60M")), ((100, "40M3I33M"), (100, "38M3I35M")), ((100, "40M3I33M"), (100, "41M3I32M"))], d)
    assert got[0] == got[1] == got[3] == (76, 0, "perfect")
    assert got[2] == (75, 1, "partial")  # one base further than it can move
    assert got[4] == (72, 4, "partial")  # no move to the right is known


def test_equal_clipped_reads_and_other_places(spark):
    got = judge(spark, [((100, "5S71M"), (100, "5S71M")), ((100, "5S71M"), (100, "6S70M")), ((100, "76M"), (101, "76M")), ((100, "76M"), (900, "76M")), ((100, "76M"), None), ((100, "76M"), (110, "10S60M6S")), ((100, "30M500N46M"), (100, "30M501N46M"))])
    assert got == {0: (76, 0, "perfect"), 1: (0, 70, "overlap"), 2: (0, 76, "overlap"), 3: (0, 76, "none"), 4: (0, 0, "none"), 5: (60, 0, "partial"), 6: (30, 46, "partial")}


def test_terminal_insertion_is_part_of_a_longer_one(spark):
    d = [("c", "I", 100, 4, 0, 3), ("c", "I", 200, 4, 0, 3)]
    assert judge(spark, [((100, "2I74M"), (100, "1M2I73M"))], d)[0] == (76, 0, "perfect")
    assert judge(spark, [((160, "40M2I34M"), (160, "41M2I33M"))], d)[0][2] == "partial"  # inside a read its size must be equal


def test_two_indels_whose_moves_overlap_count_a_base_once(spark):
    d = [("c", "D", 110, 2, 5, 5), ("c", "D", 115, 2, 5, 5)]
    right, wrong, _ = judge(spark, [((100, "10M2D3M2D63M"), (100, "12M2D1M2D63M"))], d)[0]
    assert right + wrong == 76 and right == 76


def test_repeated_rows_are_an_error(spark):
    one = spark.createDataFrame([(1, 1, False, 65, "c", 5, "76M")], READ)
    assert placement.met(one, one).count() == 1
    for t, r in ((one.union(one), one), (one, one.union(one))):
        with pytest.raises(Exception, match="a read has several"):
            placement.met(t, r).collect()


def test_plan_has_one_exchange_of_each_side(spark):
    from junctura.plans import placements as P

    plan = placement.met(P.truth(spark, "/root/testdata/sf0.001"), P.report(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
