"""Results that say why there is none, lookups from reads, proxies, searches, input files."""

from pyspark.sql import functions as F

from genocohort.operators import clinical as P
from genocohort.operators import lookup as L
from genocohort.operators import mart as M
from genocohort.operators import scoring as O
from genocohort.sources import headers as H

ANSWERS = "sample_id int, test_no int, gene string, rsid string, source string, dosage int, depth int, genotype string, star_allele string"


def test_rollup_of_lookups_from_reads(spark):
    rows = [
        (1, 1, "CYP2D6", "rs1", "pileup", 2, 20, "1/1", "*4"), (1, 1, "CYP2D6", "rs2", "pileup", 2, 20, "1/1", "*10"), (1, 1, "CYP2D6", "rs3", "pileup", 0, 20, "0/0", "*2"),
        (2, 1, "CYP2D6", "rs1", "pileup", 2, 20, "1/1", "*4"), (2, 1, "CYP2C9", "rs2", "pileup", 2, 3, "1/1", "*10"),
        (3, 1, "G", None, "cnv_only", None, None, None, None), (4, 1, "G", "rs9", "none", None, None, None, None), (5, 1, "G", "rs9", "pileup", 0, 9, "0/0", None)]
    got = {r.sample_id: (r.status, r.headline, r.n_low_coverage) for r in L.reads_rollup(spark.createDataFrame(rows, ANSWERS), ["sample_id", "test_no"]).collect()}
    assert got == {
        1: ("warning", "CYP2D6: impossible call detected (hom for *10, *4)", 0), 2: ("passed", "2/2 alt calls: CYP2C9=1/1, CYP2D6=1/1", 1), 3: ("warning", "G: requires specialized assay", 0),
        4: ("failed", "No data: 1 variant(s) unresolvable", 0), 5: ("passed", "All ref/ref (no alt calls)", 0)}


def test_the_four_proxies_go_through_the_lookup(spark):
    """By id, by position with the alleles checked, by a reference block, and one that nothing covers."""
    places = {"rs2395029": ("6", 100, "T", "G"), "rs9263726": ("6", 200, "T", "C"), "rs2844682": ("6", 300, "A", "G"), "rs1633021": (None, None, None, None)}
    wanted = P.proxy_table(spark).withColumn("sample_id", F.lit("s"))
    known = spark.createDataFrame([(k, *x) for k, x in places.items()], "rsid string, chrom string, pos long, ref string, alt string")
    records = spark.createDataFrame([
        ("s", "6", 100, "rs2395029", "T", "G", ["G"], "0/1", None), ("s", "6", 200, ".", "T", "C", ["C"], "1|1", None), ("s", "6", 250, ".", "A", "<*>", ["<*>"], "0/0", "400")],
        "sample_id string, chrom string, pos long, id string, ref string, alt_csv string, alts array<string>, gt string, info_end string")
    got = {r.hla_allele: (r.carrier, r.status, r.headline) for r in P.hla_proxy_answers(L.look_up(wanted.join(known, "rsid"), records)).collect()}
    assert got == {
        "B*57:01": (True, "warning", "B*57:01: CARRIER (proxy rs2395029 = 0/1)"), "B*58:01": (True, "warning", "B*58:01: CARRIER (proxy rs9263726 = 1|1)"),
        "B*15:02": (False, "passed", "B*15:02: non-carrier (proxy rs2844682 = 0/0)"), "A*31:01": (False, "warning", "A*31:01: proxy SNP rs1633021 not in VCF")}


def test_requested_scores_have_a_row(spark):
    g = spark.createDataFrame([("a", "1", 5, "A", "G", 1), ("b", "2", 9, "A", "G", 2)], "sample_id string, chrom string, pos long, ref string, alt string, dosage int")
    w = spark.createDataFrame([("P1", "1", 5, "G", "A", 0.5), ("P2", "7", 1, "G", "A", 0.5)] + [("P3", "1", p, "G", "A", 1.0) for p in (5, 6, 7)], "pgs_id string, chrom string, pos long, effect_allele string, other_allele string, weight double")
    asked = spark.createDataFrame([("a", "P1"), ("a", "P2"), ("b", "P1"), ("c", "P9"), ("a", "P3"), ("a", "P1")], "sample_id string, pgs_id string")
    got = {(r.sample_id, r.pgs_id): (r.matched, r.total, r.status, r.failure) for r in O.score_samples(g, w, asked).collect()}
    none = "PGS failed (0/{} variants matched: chromosome/build mismatch?)"
    assert got == {("a", "P1"): (1, 1, "passed", None), ("a", "P2"): (0, 1, "failed", none.format(1)), ("b", "P1"): (0, 1, "failed", none.format(1)), ("c", "P9"): (0, 0, "failed", none.format(0)),
                   ("a", "P3"): (1, 3, "failed", "PGS failed (match rate 33%: too low)")}


def test_search_by_id_and_floor(spark):
    c = spark.createDataFrame([("PGS000001", "one", "x"), ("PGS000002", "two of PGS000001", "y")], "pgs_id string, name string, trait string")
    t = c.select(F.col("trait").alias("trait_label"), "pgs_id")
    find = lambda text: [r.pgs_id for r in M.search_catalogue(c, t, text, 9).collect()]
    assert find(" pgs000001") == ["PGS000001"] and find("two") == ["PGS000002"] and find(" y ") == [] and find("PGS000009") == []


def test_callers_of_a_header(spark):
    heads = {"a": ["##source=GATK", "##DeepVariant_version=1.4"], "b": ["##GATKCommandLine=<x>", "##source=Strelka"], "c": ["##source=mine", "##GATKCommandLine=<x>"], "d": ["##source=mine"], "e": ["##source=DRAGEN 4"]}
    lines = spark.createDataFrame([(f, i, x) for f, xs in heads.items() for i, x in enumerate(xs)], "file string, line_no long, value string")
    assert {r.file: r.caller for r in H.header_facts(lines).collect()} == {"a": "DeepVariant 1.4", "b": "GATK HaplotypeCaller", "c": "GATK HaplotypeCaller", "d": None, "e": "DRAGEN 4"}


def test_kind_of_input_by_runner_category_default(spark):
    rows = [("cyp2d6", "PGS - Heart"), ("lookup", "Carrier Status"), ("pgs_score", "PGS - Heart"), (None, None)]
    df = spark.createDataFrame(rows, "runner string, category string").select(M.input_kind(F.col("runner"), F.col("category")).alias("k"))
    assert [r.k for r in df.collect()] == ["reads_only", "alignment_first", "default", "default"]


def test_kinds_nobody_asks_for_are_not_planned(spark):
    """Requests are worked out once; a plan for one kind of test holds no joins of scores."""
    from genocohort.checks import mart
    from genocohort.fixtures import Views
    from tests.compare import ROOT

    worked = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            worked.add(batch.num_rows)
            yield batch

    plain = spark.createDataFrame([(-5, "stats:snps")], "sample_id long, test_id string")
    tests = spark.createDataFrame([("stats:snps", "stats", "vcf_stats", "snps"), ("score:P", "score", "pgs_score", "P")], "test_id string, category string, test_type string, target string")
    done = mart.run(Views(spark, f"{ROOT}/sf0.001"), plain.mapInArrow(counted, plain.schema), tests)
    assert "_entries" not in done._jdf.queryExecution().executedPlan().toString()
    assert [(r.sample_id, r.status, r.headline) for r in done.collect()] == [(-5, "failed", "No data")] and worked.value == 1
