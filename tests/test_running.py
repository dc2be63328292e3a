"""Running totals, quantiles, intervals, batches and picks against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genocohort.functions.genotype import whole
from genocohort.operators import running
from genocohort.operators.intervals import interval_join, lift_positions
from genocohort.operators.mart import pack_batches
from genocohort.operators.picks import first_rows
from genocohort.operators.qc import upper_median
from genocohort.operators.running import ordinal, running_total


def test_running_total_spans_buckets(spark):
    rng = random.Random(1)
    rows = [(k, p, rng.randint(0, 9)) for k in "ab" for p in rng.sample(range(100000), 500)]
    df = spark.createDataFrame(rows, "k string, p long, v int")
    got = {(r.k, r.p): r.t for r in running_total(df, ["k"], whole(F.col("p"), 1000), ["p"], F.col("v"), "t").collect()}
    for k in "ab":
        total = 0
        for _, p, v in sorted(r for r in rows if r[0] == k):
            total += v
            assert got[(k, p)] == total
    places = {(r.k, r.p): r.i for r in ordinal(df, ["k"], whole(F.col("p"), 1000), ["p"], "i").collect()}
    assert places == {(k, p): i for k in "ab" for i, (_, p, _) in enumerate(sorted(r for r in rows if r[0] == k))}


QUANTILE_CASES = [[1.0], [2.0] * 50, [0.0, 1e9] + [1e-6 * i for i in range(200)], [-3.0, 4.0, 4.0, 9.5], [float(i * i % 7919) for i in range(5000)], [5.0] * 3000 + [1.0, 9.0], [10.0**i for i in range(-300, 300)] * 4]


@pytest.mark.parametrize("values", QUANTILE_CASES)
@pytest.mark.parametrize("small", [0, 1024])
def test_sketch_then_select(spark, monkeypatch, values, small):
    """Two groups at once, one part a task, small groups with and without brackets."""
    monkeypatch.setattr(running, "SMALL", small if len(values) > 500 else 1024)
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None)] + [("h", v + 1) for v in values], "g string, v double").repartition(6)
    shares = [0.01, 0.25, 0.5, 0.9, 0.99]
    sketched = df.groupBy("g").agg(F.count("v").alias("_n"), running.sketch_brackets("v", shares).alias("_brackets"))
    got = {r.g: r.q for r in running.select_quantiles(df, sketched, ["g"], "v", shares, "q").collect()}
    for group, more in (("g", 0), ("h", 1)):
        assert got[group] == pytest.approx([np.percentile([v + more for v in values], s * 100) for s in shares])


def test_values_between_brackets_are_only_counted(spark):
    values = [(float(i),) for i in range(20_000)]
    df = spark.createDataFrame(values, "v double").withColumn("g", F.lit(1))
    shares = [0.5]
    sketched = df.groupBy("g").agg(F.count("v").alias("_n"), running.sketch_brackets("v", shares).alias("_brackets"))
    low, high = sketched.first()["_brackets"]
    assert high - low < 3 * running.MARGIN * 20_000 and low < 9_999 < high
    wrong = sketched.withColumn("_brackets", F.array(F.lit(1.0), F.lit(2.0)))
    with pytest.raises(Exception, match="outside its bracket"):
        running.select_quantiles(df, wrong, ["g"], "v", shares, "q").collect()


@pytest.mark.parametrize("values", [[5], [1, 9], [3, 3, 3, 40], [0, 1, 2, 3, 1000]])
def test_upper_median_is_element_n_div_2(spark, values):
    df = spark.createDataFrame([(1, v) for v in values], "s int, v int")
    assert upper_median(df, ["s"], "v", "m").first().m == sorted(values)[len(values) // 2]


@pytest.mark.parametrize("salt", [1, 4])
def test_interval_join_with_all_lengths(spark, salt):
    rng = random.Random(2)
    points = [("1" if i % 3 else "2", rng.randint(1, 60_000_000)) for i in range(300)]
    spans = []
    for i in range(200):
        start = rng.randint(1, 50_000_000)
        spans.append(("1" if i % 2 else "2", start, start + rng.choice([0, 10, 16383, 16384, 500_000, 9_000_000, 70_000_000]), i))
    spans.append(("1", 0, 2_000_000_000, 999))
    p = spark.createDataFrame(points, "chrom string, at long")
    s = spark.createDataFrame(spans, "chrom string, a long, b long, id int")
    got = sorted((r.chrom, r["at"], r.id) for r in interval_join(p, s, "at", "a", "b", salt=salt).collect())
    assert got == sorted((c, x, i) for c, x in points for d, a, b, i in spans if c == d and a <= x <= b)
    semi = {r.id for r in interval_join(p, s, "at", "a", "b", how="left_semi", salt=salt).collect()}
    assert semi == {i for d, a, b, i in spans if any(c == d and a <= x <= b for c, x in points)}


def test_lift_drops_groups_that_hardly_lift(spark):
    v = spark.createDataFrame([("A", "1", 10), ("A", "1", 20), ("B", "1", 10), ("B", "1", 900), ("B", "1", 901)], "g string, chrom string, pos long")
    chain = spark.createDataFrame([("1", 5, 100, 7)], "chrom string, src_start long, src_end long, delta long")
    got = {(r.g, r.old_pos, r.pos) for r in lift_positions(v, chain, ["g"]).collect()}
    assert got == {("A", 10, 17), ("A", 20, 27)}


def test_first_rows(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "k string, v int")
    assert {(r.k, r.v) for r in first_rows(df, ["k"], ["v"]).collect()} == {("a", 1), ("b", 2)}


@pytest.mark.parametrize("budget", [7, 100, 10_000])
def test_pack_batches(spark, budget):
    rng = random.Random(budget)
    rows = [(o, i, rng.choice([0, 1, 3, 9, 30])) for o in (1, 2) for i in sorted(rng.sample(range(5000), 120))]
    df = spark.createDataFrame(rows, "owner int, i long, len long")
    got = {(r.owner, r.i): r.batch_no for r in pack_batches(df, "owner", "i", "len", budget).collect()}
    for owner in (1, 2):
        batch, size, empty = 1, 0, True
        for o, i, n in rows:
            if o != owner:
                continue
            if size + n > budget and not empty:
                batch, size = batch + 1, 0
            size, empty = size + n, False
            assert got[(o, i)] == batch


def test_dense_sites_meet_few_reads_in_vain(spark, monkeypatch):
    """150-base reads and a site every 400 bases: candidate pairs stay below four per match."""
    from pyspark.sql import functions as F

    from genocohort.operators import intervals as I

    sites = spark.range(2000).select(F.lit("1").alias("chrom"), (F.col("id") * 400 + 7).alias("at"))
    reads = spark.range(20_000).select(F.lit("1").alias("chrom"), (F.col("id") * 37 % 800_000).alias("a"), (F.col("id") * 37 % 800_000 + 149).alias("b"), "id")
    matches = interval_join(sites, reads, "at", "a", "b", longest=2048).count()
    near = lambda x: F.floor(F.col(x) / (1 << I.FINEST_BITS))
    bins = reads.select(F.explode(F.sequence(near("a"), near("b"))).alias("bin"))
    candidates = bins.join(sites.select(near("at").alias("bin")), "bin").count()
    assert matches == reads.join(sites, (F.col("at") >= F.col("a")) & (F.col("at") <= F.col("b"))).count()
    assert candidates < 4 * matches


def test_semi_join_keeps_equal_intervals(spark):
    rows = [("1", 5, 9), ("1", 5, 9), ("1", 250, 260), ("1", 100, 90_000), ("2", 5, 9)]
    s = spark.createDataFrame(rows, "chrom string, a long, b long")
    p = spark.createDataFrame([("1", 7), ("1", 257), ("1", 80_000), ("1", 8)], "chrom string, at long")
    got = sorted(tuple(r) for r in interval_join(p, s, "at", "a", "b", how="left_semi").collect())
    assert got == sorted(rows[:4])
