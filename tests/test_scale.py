"""Plans and skew: what reaches the scan, what is broadcast, and results under hot keys."""

import random
import re

from pyspark.sql import functions as F

from genocohort.fixtures import Views
from genocohort.functions import genotype as G
from genocohort.operators import pileup as P
from genocohort.operators import scoring as O
from genocohort.operators.blocks import genotypes_at_targets
from genocohort.operators.degrees import PARTS_FOR_OUTPUT, degree_join
from tests.compare import ROOT

SF = f"{ROOT}/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_and_filters_reach_the_scan(spark):
    v = Views(spark, SF)
    plan = plan_of(v.block.where("chrom = '7'").select("sample_id", "pos"))
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>", plan)
    assert "PushedFilters" in plan


def test_hot_position_and_hot_score(spark):
    """A third of all genotypes at one position, a third of all weights in one score: the sums stay right."""
    rng = random.Random(4)
    g = [(s, "1", 77, "A", "G", rng.randint(0, 2)) for s in range(400)] + [(s, "1", p, "A", "G", rng.randint(0, 2)) for s in range(40) for p in range(100, 120)]
    w = [("HOT", "1", p, "G", "A", 1.0) for p in (77, *range(100, 120))] + [(f"S{i}", "1", 77, "A", "G", 0.5) for i in range(10)]
    gd = spark.createDataFrame(g, "sample_id int, chrom string, pos long, ref string, alt string, dosage int").repartition(8)
    wd = spark.createDataFrame(w, "pgs_id string, chrom string, pos long, effect_allele string, other_allele string, weight double")
    got = {(r.sample_id, r.pgs_id): r.score_sum for r in O.sum_scores(O.match_effect_allele(gd, wd)).collect()}
    want = {}
    for s, _, p, _, _, d in g:
        for i, _, q, e, _, x in w:
            if p == q:
                want[(s, i)] = want.get((s, i), 0.0) + x * (d if e == "G" else 2 - d)
    assert got == want


def test_degree_planned_join_levels_the_output(spark):
    """One position listed by 90 % of the scores and called in all samples: no task holds twice the mean of the joined rows."""
    r = random.Random(5)
    g = [(s, "1", p, "A", "G", r.randint(0, 2)) for s in range(300) for p in range(77, 87)]
    w = [(f"S{i}", "1", 77, "A", "G", 0.5) for i in range(180)] + [(f"S{i % 200}", "1", 78 + i % 9, "G", "A", 1.0) for i in range(20)]
    gd = spark.createDataFrame(g, "sample_id int, chrom string, pos long, ref string, alt string, dosage int").repartition(8)
    wd = spark.createDataFrame(w, "pgs_id string, chrom string, pos long, effect_allele string, other_allele string, weight double")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = degree_join(gd, wd, ["chrom", "pos"], ["sample_id"], ["pgs_id"], pairs=300, entries=64)
        tasks = [x["n"] for x in joined.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        plain = [x["n"] for x in gd.join(wd, ["chrom", "pos"]).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        rows = sorted(map(tuple, joined.select("sample_id", "pos", "pgs_id", "weight").collect()))
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert sum(tasks) == sum(plain) == len(rows) and max(plain) > 5 * sum(plain) / 8
    assert max(tasks) < 2 * sum(tasks) / 8
    assert rows == sorted((s, p, i, x) for s, _, p, _, _, _ in g for i, _, q, _, _, x in w if p == q)


def test_deep_site_keeps_every_read(spark):
    """No depth cap: 9,000 copies of one read all count."""
    reads = spark.range(9000).select(
        F.lit(1).alias("sample_id"), F.lit("1").alias("chrom"), F.lit(10).cast("bigint").alias("start_pos"), F.lit("5M").alias("cigar"),
        F.lit("AACAA").alias("seq"), F.lit("IIIII").alias("quals"), F.lit(60).alias("mapq"), F.lit(0).alias("flag"))
    sites = spark.createDataFrame([("1", 12, "A", "C")], "chrom string, pos long, ref string, alt string")
    r = P.genotype_sites(reads, sites).first()
    assert (r.depth, r.alt_count, r.dosage) == (9000, 9000, 2)


def test_reads_meet_no_more_lists_than_matches(spark):
    """A site every 100 bases, reads of 150: at most 1.5 (read, list) rows a match, no pair outside a read, one shuffle of the reads."""
    start = F.pmod(F.xxhash64("id"), F.lit(500_000)) + 1
    reads = spark.range(4000).select(
        F.lit(1).alias("sample_id"), F.lit("1").alias("chrom"), start.alias("start_pos"), F.when(F.col("id") % 50 == 0, "60M3000N90M").otherwise("150M").alias("cigar"),
        F.repeat(F.lit("A"), 150).alias("seq"), F.repeat(F.lit("I"), 150).alias("quals"), F.lit(60).alias("mapq"), F.lit(0).alias("flag"))
    sites = spark.range(1, 5040).select(F.lit("1").alias("chrom"), (F.col("id") * 100).alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"))
    over = P.reads_over_sites(reads, sites)
    starts = [(r.start_pos, r.start_pos + (3149 if r.cigar != "150M" else 149)) for r in reads.select("start_pos", "cigar").collect()]
    matches = sum(min(b, 503_900) // 100 - (a - 1) // 100 for a, b in starts)
    assert over.count() == matches and over.where("site_pos NOT BETWEEN start_pos AND end_pos").isEmpty()
    assert P.reads_in_blocks(reads, sites).count() <= 1.5 * matches
    # SNVs and indels branch behind the join: the reads are scanned, and so shuffled, once
    assert len(re.findall(r"Range \(0, 4000", plan_of(P.genotype_sites(reads, sites)))) == 1


def test_called_record_beats_block(spark):
    rows = [("s", "1", 100, None, "A", ["G"], "0/1"), ("s", "1", 50, "200", "C", ["<*>"], "0/0"), ("s", "1", 300, "300", "T", ["<*>"], "./.")]
    records = spark.createDataFrame(rows, "sample_id string, chrom string, pos long, info_end string, ref string, alts array<string>, gt string").withColumn("min_dp", F.lit(9))
    sites = spark.createDataFrame([("1", 100, "A"), ("1", 150, "C"), ("1", 300, "T"), ("1", 400, "T")], "chrom string, pos long, ref string")
    alleles = spark.createDataFrame([("1", 100, ["A", "T"]), ("1", 150, ["C", "G", "T"]), ("1", 300, ["A"]), ("1", 400, ["A"])], "chrom string, pos long, alleles array<string>")
    got = {r.pos: (r.ref, r.alt, r.dosage, r.from_block) for r in genotypes_at_targets(records, sites, alleles).collect()}
    assert got == {100: ("A", "G", 1, False), 150: ("C", "G", 0, True), 300: ("T", "A", None, True)}


def test_joins_by_degree_are_dealt_by_output(spark):
    """The bytes of the two sides say nothing about what they make, so the parts are not merged by them."""
    many = spark.range(400).select((F.col("id") % 4).alias("k"), F.col("id").alias("a"))
    listed = spark.range(120).select((F.col("id") % 4).alias("k"), F.col("id").alias("b"))
    joined = degree_join(many, listed, ["k"], ["a"], ["b"], pairs=100, entries=10)
    parts = PARTS_FOR_OUTPUT * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert joined.groupBy("k").count().collect() and joined.count() == 4 * 100 * 30
    assert joined._jdf.queryExecution().executedPlan().toString().count(f"{parts}), REPARTITION_BY_NUM") >= 2


def test_weights_of_reads_are_worked_out_once(spark):
    """Sites, weights and totals come from one pass over whatever the weights are read from."""
    reads = spark.range(40).select(
        F.lit(1).alias("sample_id"), F.lit("1").alias("chrom"), (F.col("id") + 1).alias("start_pos"), F.lit("2S30M1I4M").alias("cigar"),
        F.lit("TT" + "A" * 35).alias("seq"), F.lit("I" * 37).alias("quals"), F.lit(60).alias("mapq"), F.lit(0).alias("flag"))
    plain = spark.createDataFrame([("P", "1", 30, "A", 0.5), ("P", "1", 35, "T", 2.0), ("Q", "1", 900, "A", 1.0)], "pgs_id string, chrom string, pos long, effect_allele string, weight double")
    worked = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            worked.add(batch.num_rows)
            yield batch

    got = P.score_from_reads(reads, plain.mapInArrow(counted, plain.schema)).collect()
    assert [(r.pgs_id, r.score_sum, r.matched, r.total, r.strand_flips) for r in got] == [("P", 5.0, 2, 2, 1)] and worked.value == 3


def test_the_short_walk_finds_the_offsets_of_the_whole_one(spark):
    cigars = ["50M", "5S20M2D25M", "20M2I28M", "10M100N40M", "3H7X3=40M", "*", "", "12", "4M4", "20M20I", None]
    df = spark.createDataFrame([(c,) for c in cigars], "cigar string").withColumn("start_pos", F.lit(100).cast("long")).crossJoin(spark.range(95, 260).select(F.col("id").alias("site_pos")))
    df = df.withColumn("ops", G.parse_cigar(F.col("cigar")))
    whole, short = (w(F.col("ops"), F.col("start_pos"), F.col("site_pos"))["at"] for w in (P.walk, P.base_walk))
    assert df.where(~whole.eqNullSafe(short)).count() == 0 and df.where(short >= 0).count() > 200
    parsed = {r.cigar: [(o.n, o.op) for o in r.ops] for r in df.select("cigar", "ops").where("cigar is not null").distinct().collect()}
    assert parsed["5S20M2D25M"] == [(5, "S"), (20, "M"), (2, "D"), (25, "M")] and parsed["*"] == [] and parsed["4M4"] == [(4, "M")]


def test_a_read_without_a_line_number_has_no_cigar(spark, tmp_path):
    """Such a read covers nothing, wherever Spark works its CIGAR out."""
    row = [(1, 7, n, 30.0, 10.0, "A", "F") for n in (1, None)]
    spark.createDataFrame(row, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, 3, "SMALL", "b")], "p_partkey long, p_size int, p_type string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    v = Views(spark, str(tmp_path))
    over = P.reads_over_sites(v.read, v.variant.select("chrom", "pos"))
    assert [r.cigar for r in over.collect()] == ["50M"]


def test_settled_sides_are_worked_out_once(spark):
    """Degrees and the join read files: what calls and weights come from runs once."""
    worked = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            worked.add(batch.num_rows)
            yield batch

    calls = spark.createDataFrame([(1, "1", 5, "A", "C", 1), (2, "1", 5, "A", "C", None)], "sample_id int, chrom string, pos long, ref string, alt string, dosage int")
    weights = spark.createDataFrame([("P", "1", 5, "C", "A", 0.5)], "pgs_id string, chrom string, pos long, effect_allele string, other_allele string, weight double")
    sides = O.settled(*[t.mapInArrow(counted, t.schema) for t in (calls, weights)])
    got = {r.sample_id: (r.score_sum, r.allele_ct) for r in O.sum_scores(O.match_effect_allele(*sides)).collect()}
    assert got == {1: (0.5, 2), 2: (0.0, 0)} and worked.value == 3
