"""What was found for a sample is shuffled once, to the listed rows of the test, together with the requests."""

from pyspark.sql import functions as F

from genocohort.checks import clinical
from genocohort.fixtures import Views
from genocohort.operators import lookup as L
from tests.compare import ROOT


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_found_records_are_shuffled_once(spark):
    listed = spark.createDataFrame([(1, "rs1", "1", 10), (1, "rs2", "1", 20), (2, "rs1", "1", 10), (None, "rs2", "1", 20)], "test_no int, rsid string, chrom string, pos long").withColumns({"ref": F.lit("A"), "alt": F.lit("G")})
    requests = spark.createDataFrame([("s", "a", 1), ("s", "b", 1), ("s", "b", 1), ("t", None, 2), (None, "c", 1), ("u", "d", 3), ("t", "e", None)], "sample_id string, test_id string, test_no int")
    records = spark.createDataFrame(
        [("s", "1", 10, "rs1", "A", "G", "0/1", None), ("t", "1", 20, "rs2", "A", "G", "1/1", None), (None, "1", 10, "rs1", "A", "G", "1/1", None), ("w", "1", 10, "rs1", "A", "G", "1/1", None)],
        "sample_id string, chrom string, pos long, id string, ref string, alt_csv string, gt string, info_end string").withColumn("alts", F.split("alt_csv", ","))
    parts = L.look_up(requests, records, listed=listed)
    plan = plan_of(parts)
    assert plan[:plan.index("Union")].count("Exchange") == 1 and "hashpartitioning(sample_id" not in plan[:plan.index("Union")]
    whole = L.look_up(requests.join(listed, "test_no"), records).select(*parts.columns)
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect())) and parts.count() == 9


def test_records_of_a_lookup_are_worked_out_once(spark):
    """Found by id, by place and below blocks: reads of files, in place of three plans of the record view."""
    v = Views(spark, f"{ROOT}/sf0.001")
    assert any("view-record-" in f for f in clinical.looked(v).inputFiles())
