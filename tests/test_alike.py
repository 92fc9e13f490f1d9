"""Reads that are alike are judged once, with the results that each would have."""

from junctura.operators import accuracy
from pyspark.sql import functions as F

READ = "frag long, mate int, amb boolean, flag int, chr string, pos int, cigar string"


def _sides(spark, times):
    """Three kinds of fragments, each `times` times at other places: right, an indel and an intron missed, on the other strand."""
    t, r = [], []
    for i in range(times):
        for kind in range(3):
            f, at = 3 * i + kind, 1000 + 13 * i
            t += [(f, 1, i % 2 == 0, 65, f"chr{i % 4}", at, "20M2D20M500N36M"), (f, 2, False, 129, f"chr{i % 4}", at, "30M500N46M")]
            r += [(f, 1, False, 65 + 16 * (kind == 2), f"chr{i % 4}", at, "76M" if kind == 1 else "20M2D20M500N36M"), (f, 2, False, 129, f"chr{i % 4}", at + 40 * kind, "30M500N46M")]
    return spark.createDataFrame(t, READ), spark.createDataFrame(r, READ)


def _walked(df):
    """Whether reads are counted by kind before they are judged."""
    return "count(1) AS units" in df._jdf.queryExecution().optimizedPlan().toString()


def test_indels_and_introns_of_alike_reads(spark):
    t, r = _sides(spark, 10)
    found = accuracy.indel_accuracy(t, r, ambiguity=True)
    assert sorted(map(tuple, found.collect())) == [(False, "D", 2, 10, 5, 0), (True, "D", 2, 10, 5, 0)]
    assert _walked(found)
    reads = accuracy.multi_intron(t, r, ["frag", "mate"])
    assert sorted(map(tuple, reads.collect())) == [(0, 0, 10, 40), (1, 60, 50, 20)]
    assert _walked(reads)
    pairs = accuracy.multi_intron(t, r, ["frag"], ambiguity=True)
    assert sorted(map(tuple, pairs.collect())) == [(amb, *row) for amb in (False, True) for row in ((0, 0, 0, 5), (1, 0, 5, 5), (2, 15, 10, 5))]
    assert _walked(pairs)


def test_a_read_that_is_there_twice_is_an_error(spark):
    import pytest

    t, r = _sides(spark, 2)
    with pytest.raises(Exception, match="several rows on a side"):
        accuracy.together(t, r.union(r.where("frag = 1")), F.lit(True)).collect()


def test_placements_that_are_alike(spark):
    from junctura.operators import ambiguity, placement

    t, r = _sides(spark, 6)
    r = r.withColumn("cigar", F.when(F.col("frag") % 3 == 0, "22M2D18M500N36M").otherwise(F.col("cigar")))
    shifts = spark.createDataFrame([(f"chr{i % 4}", "D", 1020 + 13 * i, 2, 1, i % 4) for i in range(6)], "chr string, op string, t int, size int, ls int, rs int")
    key = ["amb", "spliced", "aligned", "base_right", "base_wrong", "verdict"]
    both = placement.met(t, r)
    single = placement.verdicts(both, shifts, 76)
    counted = placement.counted_verdicts(both, shifts, 76)
    assert sorted(map(tuple, single.groupBy(*key).count().collect())) == sorted(map(tuple, counted.groupBy(*key).agg(F.sum("reads")).collect()))
    assert placement.general_table(single, 76).collect() == placement.general_table(counted, 76).collect()
    each = ambiguity.right_bases(t, r, shifts).groupBy("right").count()
    alike = ambiguity.counted_right_bases(t, r, shifts)
    assert sorted(map(tuple, each.collect())) == sorted(map(tuple, alike.groupBy("right").agg(F.sum("reads")).collect()))
    for x in (counted, alike):  # counted once, not again for reads without indels
        assert "Union" not in x._jdf.queryExecution().optimizedPlan().toString()
