"""Rule-table operators: diplotypes, metabolizer activity, repeats, HLA, pathogenic-variant panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import clinical as C
from ..functions import genotype as G


def apoe_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.APOE_TABLE, "dose_e4 int, dose_e2 int, diplotype string, risk string")


def apoe_diplotypes(calls: DataFrame, by: Sequence[str]) -> DataFrame:
    """``calls``: by-columns, marker (``e4`` / ``e2``), genotype. Two rows per group become one diplotype."""
    cls = G.genotype_class(F.col("genotype"))
    dose = F.when(cls == "ref", 0).when(cls == "het", 1).when(cls == "hom", 2)
    doses = calls.groupBy(*by).agg(
        F.max(F.when(F.col("marker") == "e4", dose)).alias("dose_e4"),
        F.max(F.when(F.col("marker") == "e2", dose)).alias("dose_e2"),
    )
    table = apoe_table(calls.sparkSession)
    return doses.join(F.broadcast(table), ["dose_e4", "dose_e2"], "left").select(
        *by, F.coalesce("diplotype", F.lit("Could not determine")).alias("diplotype"), F.coalesce("risk", F.lit("Unknown")).alias("risk")
    )


def metabolizer_status(diplotypes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Activity score and class of CYP2D6 diplotypes such as ``*1/*4`` or ``*2x2/*10``."""
    table = diplotypes.sparkSession.createDataFrame(K.CYP2D6_ACTIVITY, "allele string, activity double")
    parts = diplotypes.where(F.col("diplotype").isNotNull()).select(*by, "diplotype", F.explode(F.split("diplotype", "/")).alias("_part"))
    scored = parts.withColumn("allele", C.star_allele(F.col("_part"))).join(F.broadcast(table), "allele", "left")
    score = F.sum(F.coalesce("activity", F.lit(1.0)) * C.star_copies(F.col("_part")))
    return scored.groupBy(*by, "diplotype").agg(score.alias("activity_score")).withColumn(
        "phenotype", C.activity_class(F.col("activity_score"))
    )


def repeat_classes(counts: DataFrame) -> DataFrame:
    """Class and carrier flag by the larger repeat count; a gene without thresholds has the default first cut."""
    table = counts.sparkSession.createDataFrame(
        K.REPEAT_TABLE, "gene string, unit string, c1 int, c2 int, c3 int, n1 string, n2 string, n3 string, n4 string"
    )
    joined = counts.join(F.broadcast(table), "gene", "left").withColumn("repeats", F.array_max("counts"))
    cls = C.repeat_class(F.col("repeats"), [F.col(f"c{i}") for i in (1, 2, 3)], [F.col(f"n{i}") for i in (1, 2, 3, 4)])
    cut = F.coalesce("c1", F.lit(K.REPEAT_DEFAULT_CUT))
    return joined.withColumn(
        "repeat_class", F.when(F.col("c1").isNotNull(), cls).when(F.col("repeats") <= cut, "Normal").otherwise("Expanded")
    ).withColumn("carrier", F.col("repeats") > cut).withColumn(
        "status", F.when(F.col("carrier"), "warning").otherwise("passed")
    ).drop("unit", "c1", "c2", "c3", "n1", "n2", "n3", "n4")


def proxy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.HLA_PROXIES, "hla_allele string, rsid string, risk_base string")


def hla_proxy_carriers(calls: DataFrame, proxies: DataFrame) -> DataFrame:
    """Carrier state from a proxy SNP: any het or hom ALT call counts, whatever the risk base."""
    cls = G.genotype_class(F.col("genotype"))
    state = F.when(cls.isin("het", "hom"), "carrier").when(cls == "ref", "non-carrier").otherwise("undetermined")
    return calls.join(proxies, "rsid").withColumn("carrier_state", state)


def hla_proxy_answers(answers: DataFrame) -> DataFrame:
    """Status and headline per looked-up proxy (``answers``: hla_allele, rsid, risk_base, found, genotype).

    A proxy that is neither found nor inferred to be reference says nothing; a carrier shows the risk base, or any het or hom ALT call.
    """
    gt = F.coalesce("genotype", F.lit(""))
    unknown = ~F.col("found") & ~gt.contains("0/0")
    carrier = (F.col("found") & F.upper(gt).contains(F.upper("risk_base"))) | gt.rlike(r"0[/|]1|1[/|]0|1[/|]1")
    text = lambda word: F.concat("hla_allele", F.lit(f": {word} (proxy "), "rsid", F.lit(" = "), gt, F.lit(")"))
    headline = F.when(unknown, F.concat("hla_allele", F.lit(": proxy SNP "), "rsid", F.lit(" not in VCF"))).when(carrier, text("CARRIER")).otherwise(text("non-carrier"))
    return answers.withColumn("carrier", ~unknown & carrier).withColumn("status", F.when(unknown | carrier, "warning").otherwise("passed")).withColumn("headline", headline)


def hla_headline(calls: DataFrame, by: Sequence[str]) -> DataFrame:
    """Headline of the canonical loci in fixed order. A sample has a few dozen loci."""
    place = F.array_position(F.array(*[F.lit(x) for x in K.HLA_LOCUS_ORDER]), F.col("gene"))
    text = F.concat(
        F.regexp_replace("gene", "^HLA-", ""), F.lit("*"),
        F.array_join(F.transform("alleles", lambda a: C.short_hla(a)), "/"),
    )
    listed = calls.where(place > 0).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct(place.alias("place"), text.alias("text")))).alias("_x")
    )
    return listed.select(*by, F.concat(F.lit("HLA: "), F.array_join(F.transform("_x", lambda e: e["text"]), ", ")).alias("headline"))


def annotate(records: DataFrame, annotations: DataFrame) -> DataFrame:
    """Attach significance and gene text per (position, REF, ALT); reference blocks are dropped first."""
    real = records.where(~((F.size("alts") == 1) & G.is_symbolic(F.col("alts"))))
    exploded = real.withColumn("alt", F.explode(G.strip_symbolic(F.col("alts"))))
    slim = annotations.select("chrom", "pos", "ref", "alt", "clnsig", "geneinfo")
    return exploded.join(slim, ["chrom", "pos", "ref", "alt"], "left")


def pathogenic_findings(annotated: DataFrame, panel_genes: DataFrame) -> DataFrame:
    """One row per (sample, variant, matched panel gene) with a carried pathogenic allele."""
    carried = annotated.where(G.is_pathogenic(F.col("clnsig")) & G.carries_alt(F.col("gt")))
    return carried.withColumn("gene", F.explode(G.gene_names(F.col("geneinfo")))).join(panel_genes, "gene").select(
        "sample_id", "panel", "gene", "chrom", "pos", "ref", "alt", "clnsig", "gt"
    )


def clean_genes(requests: DataFrame, panel_genes: DataFrame, findings: DataFrame) -> DataFrame:
    """(sample, panel, gene) screened without a finding."""
    return requests.join(panel_genes, "panel").join(findings, ["sample_id", "panel", "gene"], "left_anti").select(
        "sample_id", "panel", "gene"
    )


def screen_rollup(requests: DataFrame, panel_genes: DataFrame, findings: DataFrame) -> DataFrame:
    """Per requested (sample, panel): findings, genes hit, genes screened, first five genes, status, headline."""
    screened = panel_genes.groupBy("panel").agg(F.countDistinct("gene").alias("genes_screened"))
    hits = findings.groupBy("sample_id", "panel", "gene").agg(F.count(F.lit(1)).alias("_n"))
    per = hits.groupBy("sample_id", "panel").agg(
        F.sum("_n").alias("findings"), F.count(F.lit(1)).alias("genes_with_finding"),
        F.array_sort(F.collect_list("gene")).alias("_genes"),
    )
    out = requests.join(screened, "panel").join(per, ["sample_id", "panel"], "left")
    n, found = F.coalesce("findings", F.lit(0)), F.coalesce("genes_with_finding", F.lit(0))
    headline = F.when(
        n > 0, F.concat(n.cast("string"), F.lit(" pathogenic finding(s): "), F.array_join(F.slice("_genes", 1, 5), ", "))
    ).otherwise(F.concat(F.lit("No pathogenic variants in "), F.col("genes_screened").cast("string"), F.lit(" genes")))
    return out.select(
        "sample_id", "panel", n.alias("findings"), found.alias("genes_with_finding"), "genes_screened",
        F.when(n > 0, "warning").otherwise("passed").alias("status"), headline.alias("headline"),
    )
