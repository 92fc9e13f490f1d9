import datetime
import random

import pytest
from junctura.operators import contracts, metrics, placement, quality
from junctura.sources import results
from junctura.streaming import fragments
from pyspark.sql import functions as F

READ = "frag long, mate int, amb boolean, flag int, chr string, pos int, cigar string"


def test_counts_without_another_scan(spark):
    t = spark.createDataFrame([(i, 1, False, 65, "c", 5, "76M") for i in range(20)], READ)
    r = t.where("frag < 15").withColumn("chr", F.when(F.col("frag") < 3, "d").otherwise(F.col("chr"))).withColumn("flag", F.when(F.col("frag") == 9, 69).otherwise(F.col("flag")))
    plain = placement.met(t, r)
    both, watch = contracts.pairing(plain)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(both) == exchanges(plain) and both.count() == 20
    assert watch.counts() == {"rows": 20, "absent": 5, "unmapped": 1, "elsewhere": 3}
    watch.enforce(absent=5, elsewhere=3)
    with pytest.raises(ValueError, match="5 rows are absent, at most 0 may be; 3 rows are elsewhere, at most 1 may be"):
        watch.enforce(absent=0, elsewhere=1, unmapped=1)


def test_first_faults(spark):
    rows = [(random.Random(1).randint(0, 9) if i % 50 else None, i * 7919 % 1000, "x" * (i % 3)) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int, c string").repartition(13)
    kinds = {"empty": F.col("c") == "", "even": F.col("b") % 2 == 0, "never": F.lit(False), "null": F.col("a").isNull()}
    got = {r.kind: (r.n, [tuple(x) for x in r["first"]]) for r in contracts.first_faults(df, kinds, ["a", "b"], most=4, merge=2).collect()}
    order = lambda x: [(v is not None, v or 0) for v in x]
    want = lambda keep: (sum(map(keep, rows)), sorted([r[:2] for r in rows if keep(r)], key=order)[:4])
    assert got == {"empty": want(lambda r: r[2] == ""), "even": want(lambda r: r[1] % 2 == 0), "null": want(lambda r: r[0] is None)}
    assert contracts.first_faults(df.limit(0), kinds, ["a"]).count() == 0


def test_histogram_within_bounds(spark):
    df = spark.createDataFrame([(0,), (2,), (2,)], "v int")
    assert sorted(map(tuple, metrics.histogram(df, "v", 3).collect())) == [(0, 1), (1, 0), (2, 2), (3, 0)]
    assert metrics.histogram(df.limit(0), "v", 1).count() == 2
    for most in (1, 0):
        with pytest.raises(Exception, match="not between 0"):
            metrics.histogram(df, "v", most).collect()


def test_data_set_of_a_path(spark):
    df = spark.createDataFrame([("/a/iac.T.sim1_2.txt",), ("x/T/mouse_1.misc.txt",), ("sim2_3",), ("none.txt",), (None,)], "p string")
    assert [r[0] for r in df.select(results.dataset_of(F.col("p"))).collect()] == ["sim1", "mouse", "sim2", None, None]


def arrivals(n):
    rng, rows, seq = random.Random(2), [], 0
    for frag in range(n):
        for mate in (1, 2):
            for flag in rng.choice([[65], [65, 321], [], [65, 65], [321, 321, 65]]):
                seq += 1
                rows.append((frag, mate, seq, flag if mate == 1 else flag + 64, "c", rng.randint(1, 99), "76M"))
    return rows


def test_fragments_over_a_stream_are_those_of_the_batch(spark, tmp_path):
    start, rows = datetime.datetime(2024, 1, 1), arrivals(60)
    schema = "frag long, mate int, seq int, flag int, chr string, pos int, cigar string, ts timestamp"
    rng = random.Random(3)
    timed = [(*r, start + datetime.timedelta(minutes=r[0], seconds=rng.randint(0, 200))) for r in rows]  # rows of a fragment within 200 seconds
    rng.shuffle(timed)
    timed.sort(key=lambda r: r[-1] + datetime.timedelta(seconds=rng.randint(0, 200)))  # out of order, less than five minutes late
    end = [(999, 1, 0, 65, "c", 1, "76M", start + datetime.timedelta(days=1))]
    late = [(3, 1, 9999, 65, "c", 1, "76M", start)]
    for k in range(8):
        part = timed[k * len(timed) // 8 : (k + 1) * len(timed) // 8] if k < 8 else []
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for part in (end, late, [(*end[0][:-1], end[0][-1] + datetime.timedelta(days=1))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = fragments.completed(stream, "5 minutes", "5 minutes").writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = sorted(map(tuple, spark.table("hits").where("frag < 999").collect()))
    batch = spark.createDataFrame(rows, schema.rsplit(",", 1)[0])
    want = quality.hit_tags(batch, batch)
    assert got == sorted(map(tuple, want.collect())) and len(got) >= 100
    assert fragments.left_out(query) == 1
