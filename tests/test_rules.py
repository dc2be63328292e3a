"""Rule tables, gates, genotypes, CIGAR cases and match types on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from genocohort import constants as K
from genocohort.functions import clinical as C
from genocohort.functions import genotype as G
from genocohort.functions import scores as S
from genocohort.operators import clinical as P
from genocohort.operators import lookup as L
from genocohort.operators import pileup as PU


def one(spark, value, schema, column):
    return spark.createDataFrame([value], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("gt,dosage", [("0/0", 0), ("0|1", 1), ("1/1", 2), ("1/2", 2), ("0/2", 1), ("./.", None), ("0/.", None), ("1", 1), ("0", 0)])
def test_alt_dosage(spark, gt, dosage):
    assert one(spark, (gt,), "gt string", G.alt_dosage(F.col("gt"))) == dosage


@pytest.mark.parametrize("gt,copies", [("0/1", 1), ("1/1", 2), ("1/2", 1), ("2/2", 0), ("0/0", 0), ("1", None), ("./1", None), ("0/3", None)])
def test_allele_dosage_over_several_alts(spark, gt, copies):
    col = G.allele_dosage(F.col("r"), F.col("a"), F.col("gt"), F.lit("C"))
    assert one(spark, ("A", ["C", "T"], gt), "r string, a array<string>, gt string", col) == copies


@pytest.mark.parametrize("x", [-3.0, -0.5, 0.0, 0.1, 1.0, 2.5])
def test_normal_percent(spark, x):
    want = 50 * (1 + math.erf(x / math.sqrt(2)))
    assert one(spark, (x,), "x double", S.normal_percent(F.col("x"))) == pytest.approx(want, abs=2e-5)


@pytest.mark.parametrize("z,percentile,reason", [(0.0, 50.0, None), (4.0, 99.5, None), (-4.5, 0.5, None), (6.0, 99.5, None), (6.5, None, "z_score_extreme"), (-7.0, None, "z_score_extreme")])
def test_gates_at_z(spark, z, percentile, reason):
    cols = S.percentile_columns(F.col("z"), F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    r = spark.createDataFrame([(z,)], "z double").select(cols["percentile"].alias("p"), cols["reason"].alias("r"), cols["gates"].alias("g")).first()
    assert (r.p, r.r) == (percentile, reason)
    assert ("z_over_4" in r.g) == (4 < abs(z) <= 6)


def test_gates_for_spread(spark):
    def run(std, expected):
        cols = S.percentile_columns(F.lit(0.1), F.lit(5.0), F.lit(0.1), F.lit(std).cast("double"), F.lit(expected).cast("double"))
        return spark.range(1).select(cols["reason"].alias("r")).first().r

    assert run(0.0, 1.0) == "ref_std_zero"
    assert run(0.05, 1.0) == "distribution_collapsed"
    assert run(0.2, 1.0) is None
    assert run(None, 1.0) == "no_reference_stats"


def test_apoe_combinations(spark):
    text = {0: "0/0", 1: "0/1", 2: "1/1"}
    rows = [(f"{a}{b}", m, text[d]) for a in text for b in text for m, d in (("e4", a), ("e2", b))] + [("x", "e4", "./."), ("x", "e2", "0/0")]
    got = {r.s: r.diplotype for r in P.apoe_diplotypes(spark.createDataFrame(rows, "s string, marker string, genotype string"), ["s"]).collect()}
    assert got == {**{f"{a}{b}": d for a, b, d, _ in K.APOE_TABLE}, "x": "Could not determine"}


@pytest.mark.parametrize("diplotype,score,word", [("*4/*5", 0.0, "Poor"), ("*4/*10", 0.25, "Intermediate"), ("*10/*9", 0.75, "Intermediate"), ("*1/*4", 1.0, "Normal"),
                                                  ("*1/*2", 2.0, "Normal"), ("*1x2/*1", 3.0, "Ultrarapid"), ("*99/*10", 1.25, "Normal")])
def test_metabolizer(spark, diplotype, score, word):
    r = P.metabolizer_status(spark.createDataFrame([(1, diplotype)], "s int, diplotype string"), ["s"]).first()
    assert r.activity_score == score and r.phenotype.startswith(word)


@pytest.mark.parametrize("gene,n,word", [("FMR1", 44, "Normal"), ("FMR1", 54, "Intermediate"), ("FMR1", 200, "Premutation"), ("FMR1", 201, "Full"), ("HTT", 39, "Reduced"), ("HTT", 40, "Full"), ("DMPK", 50, "Premutation")])
def test_repeats(spark, gene, n, word):
    r = P.repeat_classes(spark.createDataFrame([(gene, [5, n])], "gene string, counts array<int>")).first()
    assert r.repeat_class.startswith(word) and r.carrier == (n > {"FMR1": 44, "HTT": 26, "DMPK": 34}[gene])


@pytest.mark.parametrize("share,depth,dosage", [(0.14, 100, 0), (0.15, 100, 1), (0.85, 100, 1), (0.86, 100, 2), (0.5, 6, None)])
def test_snv_cut_offs_are_exclusive(spark, share, depth, dosage):
    n = round(share * depth)
    assert one(spark, (n, depth), "a int, d int", C.snv_dosage(F.col("a"), F.col("d"))) == dosage


@pytest.mark.parametrize("n,depth,dosage", [(19, 100, 0), (20, 100, 1), (84, 100, 1), (85, 100, 2), (7, 7, None)])
def test_indel_cut_offs_are_inclusive(spark, n, depth, dosage):
    assert one(spark, (n, depth), "a int, d int", C.indel_dosage(F.col("a"), F.col("d"))) == dosage


# site 100, read starts at 81: the anchor is the 20th aligned base
DELETION = {"50M": "ref", "20M2D30M": "alt", "20M3D30M": "other", "20M2I28M": "ref", "20M": None, "21M": None, "22M": "ref", "5S20M2D25M": "alt", "10M5N5M2D30M": "alt"}
INSERTION = {"50M": "ref", "20M2I28M": "alt", "20M3I27M": "other", "20M2D30M": "ref", "20M": None, "21M": "ref", "5S20M2I23M": "alt"}


@pytest.mark.parametrize("ref,alt,cases", [("CGA", "C", DELETION), ("C", "CTG", INSERTION)])
def test_indel_verdicts_by_cigar(spark, ref, alt, cases):
    rows = []
    for cigar in cases:
        lead = "A" * (24 if cigar.startswith("5S") else 19)
        rows.append((1, "1", 81, cigar, (lead + "CTG" + "A" * 40)[:50], "I" * 50, 60, 0))
    reads = spark.createDataFrame(rows, "sample_id int, chrom string, start_pos long, cigar string, seq string, quals string, mapq int, flag int")
    sites = spark.createDataFrame([("1", 100, ref, alt)], "chrom string, pos long, ref string, alt string")
    got = {r.cigar: r.verdict for r in PU.indel_verdicts(reads, sites).collect()}
    assert got == {c: x for c, x in cases.items() if x is not None}


def test_lookup_match_types(spark):
    wanted = spark.createDataFrame(
        [("s", rs, c, p, "A", "G") for rs, c, p in [("rs1", "1", 10), ("rs2", "1", 20), ("rs3", "1", 30), ("rs4", "1", 40), ("rs5", "1", 50), ("rs6", None, None), (None, None, None)]],
        "sample_id string, rsid string, chrom string, pos long, ref string, alt string")
    records = spark.createDataFrame(
        [("s", "1", 10, "rs1", "A", "T", "1/1", None), ("s", "1", 20, ".", "a", "C,g", "0/2", None), ("s", "1", 20, ".", "A", "T", "0/1", None),
         ("s", "1", 30, ".", "A", "T", "0/1", None), ("s", "1", 28, ".", "A", "<*>", "0/0", "35"), ("s", "1", 36, ".", "A", "<NON_REF>", "0/0", "45")],
        "sample_id string, chrom string, pos long, id string, ref string, alt_csv string, gt string, info_end string",
    ).withColumn("alts", F.split("alt_csv", ","))
    got = {r.rsid: (r.source, r.match_type, r.genotype, r.found) for r in L.look_up(wanted, records).collect()}
    assert got == {
        "rs1": ("rsID", "rsid", "1/1", True), "rs2": ("position", "exact", "0/2", True), "rs3": ("position", "locus_mismatch", "0/1", True),
        "rs4": ("gvcf_refblock", "ref_block", "0/0", True), "rs5": ("position-inferred", None, "0/0", False), "rs6": ("none", None, None, False),
        None: ("cnv_only", None, None, False),
    }
