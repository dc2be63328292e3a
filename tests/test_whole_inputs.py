"""Queries show the whole of their input."""

from types import SimpleNamespace

from pyspark.sql import functions as F

import __spark_entry__ as entry
from genocohort.checks import mart
from genocohort.fixtures import Views
from genocohort.operators import mart as M
from tests.compare import ROOT

SF = f"{ROOT}/sf0.001"
QUERIES = entry.queries()


def values(spark, query: str, column: str) -> set:
    return {r[0] for r in QUERIES[query](spark, SF).select(column).distinct().collect()}


def test_all_sources_and_results(spark):
    assert {"rsID", "position", "position-inferred", "gvcf_refblock"} <= values(spark, "wn8_lookup_pick", "source")
    # every file of the given tables has a view, which replaces its errors; file 2 here has none
    report = spark.createDataFrame([(1, 1, "error", 0.5), (2, 1, "view", 0.6), (3, 2, "error", 0.7), (4, 3, None, 0.8)], "task_id long, file_id long, test_id string, match_rate double")
    assert {r["task_key"]: r["task_id"] for r in mart.snk6_every(SimpleNamespace(report=report)).collect()} == {1: 2, 2: 3, 3: 4}
    assert 1 in values(spark, "sl7_search_limit", "source_rank")


def test_all_populations(spark):
    for query in ("sc11_z_score", "sc12_normal_percent", "sc16_confidence", "pl4_polygenic_score"):
        assert {True, False} <= values(spark, query, "is_primary"), query


def test_all_positions_proxies_and_targets(spark):
    assert {"0/0", "0/1", "1/1"} <= values(spark, "jn27_position_genotypes", "gt")
    assert max(len(x) for x in values(spark, "pl25_target_site_genotypes", "ref")) > 1
    assert len(values(spark, "sc9_hla_proxy", "rsid")) == Views(spark, SF).genotype.select("rsid").distinct().count()


def test_specialized_tests_are_routed(spark):
    done = spark.createDataFrame([(1, "roh", "passed", "ROH: 2 segments")], "sample_id long, target string, status string, headline string")
    requests = spark.createDataFrame([(1, "a"), (2, "a")], "sample_id long, test_id string")
    tests = spark.createDataFrame([("a", "special", "specialized", "roh")], "test_id string, category string, test_type string, target string")
    got = {tuple(r) for r in mart.run(Views(spark, SF), requests, tests, done).select("sample_id", "status", "headline").collect()}
    assert got == {(1, "passed", "ROH: 2 segments"), (2, "failed", "No data")}


def test_texts_of_lookups_and_screens(spark):
    answers = spark.createDataFrame([(1, "G", "rs1", "0/1", "rsID"), (1, None, "rs2", None, "none")], "sample_id long, gene string, rsid string, genotype string, source string")
    text = M.lookup_summary(answers, ["sample_id"], F.lit("T"), F.col("rsid"), F.lit("A>G")).first()["summary"]
    assert text == "Variant lookup for: T\n   rs2 (A>G): not found [via none]\n  G rs1 (A>G): 0/1 [via rsID]"
    asked = spark.createDataFrame([(1, "P"), (2, "P")], "sample_id long, panel string")
    genes = spark.createDataFrame([("P", "G"), ("P", "H")], "panel string, gene string")
    found = spark.createDataFrame([(1, "P", "G", "1", 5, "A", "T", "Pathogenic", "0/1")], "sample_id long, panel string, gene string, chrom string, pos long, ref string, alt string, clnsig string, gt string")
    texts = {r["sample_id"]: r["summary"] for r in M.screen_summary(asked, genes, found).collect()}
    assert texts[1] == "Monogenic Screening: P Panel\nGenes screened: 2\nFINDINGS: 1 pathogenic/likely pathogenic variant(s) found!\n  G: 1:5 A>T [Pathogenic] GT=0/1"
    assert "No pathogenic/likely pathogenic variants found" in texts[2]
