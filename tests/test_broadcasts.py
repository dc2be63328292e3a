"""Sides that grow with the data are shuffled, however small Spark takes them for."""

from pyspark.sql import functions as F

from genocohort.checks import clinical, distribution, reads
from genocohort.fixtures import Views
from genocohort.operators import distribution as D
from genocohort.operators import lookup as L
from genocohort.operators import pileup as P
from genocohort.operators import scoring as O
from genocohort.operators.blocks import blocks_over_targets, expand_blocks
from tests.compare import ROOT

SF = f"{ROOT}/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def reads_of(spark):
    return spark.range(50).select(
        F.lit(1).alias("sample_id"), F.lit("1").alias("chrom"), (F.col("id") + 1).alias("start_pos"), F.lit("5M").alias("cigar"),
        F.lit("AACAA").alias("seq"), F.lit("IIIII").alias("quals"), F.lit(60).alias("mapq"), F.lit(0).alias("flag"))


def sites_of(spark):
    return spark.createDataFrame([("1", 12, "A", "C"), ("1", 30, "A", "AT")], "chrom string, pos long, ref string, alt string")


def test_sites_of_reads_are_not_broadcast(spark):
    sites = sites_of(spark)
    bases = sites.select("chrom", "pos", F.col("ref").alias("base"))
    called = P.genotype_sites(reads_of(spark), sites, bases)
    assert "Broadcast" not in plan_of(called)
    assert {(r.pos, r.depth) for r in called.collect()} == {(12, 5), (30, 4)}


def test_sites_of_blocks_are_not_broadcast(spark):
    blocks = spark.createDataFrame([(1, "1", 10, 20, "0/0", 9), (2, "1", 13, 29, "0/0", 9)], "sample_id long, chrom string, pos long, end_pos long, gt string, min_dp int")
    for found in (blocks_over_targets(blocks, sites_of(spark)), expand_blocks(blocks, sites_of(spark))):
        assert "Broadcast" not in plan_of(found)
        assert [r.sample_id for r in found.collect()] == [1]


def test_views_do_not_broadcast_variants(spark):
    v = Views(spark, SF)
    for table in (v.read, v.score_raw, v.genotype, clinical.wanted(v), reads.snv_calls(v)):
        assert "Broadcast" not in plan_of(table)


def test_scores_are_summed_once_and_not_joined_with_totals(spark):
    v = Views(spark, SF)
    rated = plan_of(O.score_samples(v.genotype, v.score))
    assert "Join" not in rated[:rated.index("HashAggregate")]
    assert plan_of(distribution.confidence(v)).count("Generate explode(_entries") == 1


def test_percentiles_meet_lists(spark):
    """One shuffle of a score for its sample's references and one for its statistics; every reference and every row of statistics counts."""
    scored = spark.createDataFrame([(1, "P", 2.0, 1.0), (2, "Q", 2.0, 1.0), (3, None, 2.0, 1.0)], "sample_id long, pgs_id string, score_sum double, raw_score double")
    refs = spark.createDataFrame([(1, "EUR", True), (1, "MIX", False), (2, "EUR", True), (3, "EUR", True)], "sample_id long, population string, is_primary boolean")
    stats = spark.createDataFrame([("P", "EUR", 0.0, 1.0), ("P", "EUR", 0.5, 2.0), ("P", "AFR", 0.0, 1.0)], "pgs_id string, population string, mean double, std double")
    found = D.percentiles(scored, refs, stats)
    plan = plan_of(found)
    got = sorted(((r.sample_id, r.population, r.is_primary, r.mean, r.std, r.expected_std) for r in found.collect()), key=str)
    assert got == [(1, "EUR", True, 0.0, 1.0, 2.0), (1, "EUR", True, 0.5, 2.0, 2.0), (1, "MIX", False, None, None, 2.0), (2, "EUR", True, None, None, None), (3, "EUR", True, None, None, None)]
    assert plan.count("ShuffledHashJoin") == 2 and plan.count("Join [") == 2


def test_wanted_rows_of_a_lookup_are_not_shuffled(spark):
    """A request becomes its rows after it has met what was found for it, and these rows are rolled up where they are."""
    plan = plan_of(clinical.pl10(Views(spark, SF)))
    assert "Exchange" not in plan[:plan.index("SortMergeJoin [test_no")]


def test_lookup_of_listed_rows_is_that_of_wanted_rows(spark):
    listed = spark.createDataFrame(
        [(1, "rs1", "1", 10), (1, "rs2", "1", 20), (1, "rs3", "1", 30), (1, "rs3", "1", 30), (2, "rs1", "1", 10), (2, "rs4", "1", 40), (2, "rs5", None, None), (2, ".", "1", 50), (3, None, "1", 20),
         (None, "rs1", "1", 10)], "test_no int, rsid string, chrom string, pos long").withColumns({"ref": F.lit("A"), "alt": F.lit("G")})
    requests = spark.createDataFrame([("s", 1), ("s", 1), ("s", 2), ("s", 3), ("t", 1), ("t", 2), (None, 1), ("u", None), ("w", 2)], "sample_id string, test_no int")
    records = spark.createDataFrame(
        [("s", "1", 12, "rs1", "A", "T", "1/1", None, 7), ("s", "1", 11, "rs1", "A", "G", "0/1", None, 9), ("s", "1", 20, ".", "a", "C,g", "0/2", None, 3), ("s", "1", 20, "rs9", "A", "T", "0/1", None, 1),
         ("t", "1", 28, "rs2", "A", "<*>", "0/0", "45", 1), ("t", "1", 20, "rs2", "A", "<NON_REF>", "0/0", None, 2), ("t", "1", 50, ".", "A", None, "0/1", None, 4), (None, "1", 10, "rs1", "A", "G", "1/1", None, 5)],
        "sample_id string, chrom string, pos long, id string, ref string, alt_csv string, gt string, info_end string, line_no long").withColumn("alts", F.split("alt_csv", ","))
    for rows in (records, records.drop("line_no")):
        whole = L.look_up(requests.join(listed, "test_no"), rows)
        parts = L.look_up(requests, rows, listed=listed).select(*whole.columns)
        assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
