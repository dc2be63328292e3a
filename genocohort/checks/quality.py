"""Sample QC, sex checks, build validation and scoring-file QC."""

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import qc as Q
from ..sources import headers as H
from .registry import check

VAR_SQL = """va AS (SELECT sample_id, chrom, pos, ref, split_part(alt_csv, ',', 1) AS alt, gt,
   CASE WHEN gt IN ('1/1', '1|1') THEN 'hom' WHEN gt IN ('0/1', '0|1', '1/0') THEN 'het' ELSE 'ref' END AS cls
  FROM v_record WHERE alt_csv NOT IN ('<*>', '<NON_REF>') AND gt NOT IN ('0/0', './.', '0/.')),
 q AS (SELECT sample_id, count(*) FILTER (length(ref) = 1 AND length(alt) = 1 AND ref || alt IN ('AG','GA','CT','TC')) AS transitions,
   count(*) FILTER (length(ref) = 1 AND length(alt) = 1 AND ref || alt NOT IN ('AG','GA','CT','TC')) AS transversions,
   count(*) FILTER (cls = 'het') AS n_het, count(*) FILTER (cls = 'hom') AS n_hom,
   count(*) FILTER (length(ref) = 1 AND length(alt) = 1) AS n_snps, count(*) FILTER (length(ref) <> length(alt)) AS n_indels,
   count(*) FILTER (length(ref) = 1 AND length(alt) = 1 AND chrom = '22') AS n22 FROM va GROUP BY 1)"""


@check("ag7_titv", f"""WITH {VAR_SQL} SELECT sample_id, transitions, transversions, transitions / nullif(transversions, 0)::DOUBLE AS titv,
   CASE WHEN transversions = 0 THEN 'failed' WHEN transitions / transversions::DOUBLE BETWEEN 1.9 AND 2.2 THEN 'passed' ELSE 'warning' END AS titv_status FROM q""")
def ag7(v):
    return Q.sample_metrics(v.record).select("sample_id", "transitions", "transversions", "titv", "titv_status")


@check("ag8_het_hom", f"""WITH {VAR_SQL} SELECT sample_id, n_het, n_hom, n_het / nullif(n_hom, 0)::DOUBLE AS het_hom,
   CASE WHEN n_hom = 0 THEN 'failed' WHEN n_het / n_hom::DOUBLE BETWEEN 1.3 AND 2.5 THEN 'passed' ELSE 'warning' END AS het_hom_status FROM q""")
def ag8(v):
    return Q.sample_metrics(v.record).select("sample_id", "n_het", "n_hom", "het_hom", "het_hom_status")


@check("ag9_variant_counts", f"""WITH {VAR_SQL} SELECT sample_id, n_snps, n_indels, CASE WHEN n_snps BETWEEN 3000000 AND 5000000 THEN 'passed' ELSE 'warning' END AS snp_status,
   CASE WHEN n_indels BETWEEN 400000 AND 1000000 THEN 'passed' ELSE 'warning' END AS indel_status,
   CAST(round(n22 * ({K.GENOME_LENGTH}::DOUBLE / {K.CHR22_LENGTH})) AS BIGINT) AS snps_scaled FROM q""")
def ag9(v):
    return Q.sample_metrics(v.record).select("sample_id", "n_snps", "n_indels", "snp_status", "indel_status", "snps_scaled")


@check("pl19_sample_qc", f"""WITH {VAR_SQL} SELECT sample_id, transitions / nullif(transversions, 0)::DOUBLE AS titv, n_het / nullif(n_hom, 0)::DOUBLE AS het_hom, n_snps, n_indels FROM q""")
def pl19(v):
    return Q.sample_metrics(v.record).select("sample_id", "titv", "het_hom", "n_snps", "n_indels")


SEX_SQL = """sx AS (SELECT sample_id, count(*) FILTER (chrom = 'Y') AS y_records, count(*) FILTER (chrom = 'X') AS x_records,
   count(*) FILTER (chrom = 'Y' AND site AND gt = '0/0') AS y_hom_ref,
   count(*) FILTER (chrom = 'X' AND site AND gt IN ('0/1','0|1','1/0','1/1','1|1')) AS x_variants,
   count(*) FILTER (chrom = 'Y' AND site AND gt IN ('0/1','0|1','1/0','1/1','1|1')) AS y_variants,
   count(*) FILTER (chrom = 'X' AND site AND gt IN ('0/1','0|1','1/0')) AS x_het, count(*) FILTER (chrom = 'X' AND site) AS x_sites
  FROM (SELECT *, alt_csv NOT IN ('<*>', '<NON_REF>') AS site FROM v_record) GROUP BY 1)"""


@check("ag10_chry_count", f"""WITH {SEX_SQL} SELECT sample_id, y_records, y_hom_ref, CASE WHEN x_records = 0 AND y_records = 0 THEN 'unknown' WHEN y_hom_ref > 0 THEN 'Male' ELSE 'Female' END AS chry_sex FROM sx""")
def ag10(v):
    return Q.sex_counts(v.record, male_homref=0).select("sample_id", "y_records", "y_hom_ref", "chry_sex")


@check("ag11_chrx_het", f"""WITH {SEX_SQL} SELECT sample_id, x_het / nullif(x_sites, 0)::DOUBLE AS x_het_rate, CASE WHEN x_sites = 0 THEN 'unknown' WHEN x_het / x_sites::DOUBLE > 0.3 THEN 'Female' ELSE 'Male' END AS chrx_sex FROM sx""")
def ag11(v):
    return Q.sex_counts(v.record).select("sample_id", "x_het_rate", "chrx_sex")


@check("ag14_xy_variant_ratio", f"""WITH {SEX_SQL} SELECT sample_id, x_variants, y_variants, x_variants / nullif(y_variants, 0)::DOUBLE AS xy_ratio, CASE WHEN x_variants = 0 THEN 'unknown' WHEN y_variants = 0 THEN 'unknown (likely female)'
   WHEN y_hom_ref > 0 THEN 'Male' ELSE 'Female' END AS xy_sex FROM sx""")
def ag14(v):
    return Q.sex_counts(v.record, male_homref=0).select("sample_id", "x_variants", "y_variants", "xy_ratio", "xy_sex")


READ_COUNT_SQL = """rc AS (SELECT sample_id, count(*) FILTER (chrom = 'X') AS x_reads, count(*) FILTER (chrom = 'Y') AS y_reads,
   count(*) FILTER (chrom = 'Y' AND start_pos BETWEEN 200000 AND 900000) AS sry_reads FROM v_read WHERE mapq >= 20 AND (flag & 260) = 0 GROUP BY 1)"""


@check("ag12_sex_reads", f"""WITH {READ_COUNT_SQL} SELECT sample_id, x_reads, y_reads, sry_reads, CASE WHEN y_reads > 0 THEN x_reads / y_reads::DOUBLE ELSE 'inf'::DOUBLE END AS xy_read_ratio,
   CASE WHEN y_reads > 500000 THEN 'Male' ELSE 'Female' END AS chry_sex, CASE WHEN sry_reads >= 10 THEN 'Male' ELSE 'Female' END AS sry_sex,
   CASE WHEN y_reads > 0 AND x_reads / y_reads::DOUBLE > 1.5 AND x_reads / y_reads::DOUBLE < 50 THEN 'Male' ELSE 'Female' END AS xy_sex FROM rc""")
def ag12(v):
    return Q.sex_from_reads(v.read, sry=("Y", 200000, 900000))


@check("pf11_countable_reads", "SELECT sample_id, chrom, start_pos, mapq, flag, count(*) AS n FROM v_read WHERE mapq >= 20 AND (flag & 260) = 0 GROUP BY ALL")
def pf11(v):
    return Q.countable_reads(v.read).groupBy("sample_id", "chrom", "start_pos", "mapq", "flag").agg(F.count(F.lit(1)).alias("n"))


SRY_SQL = """here AS (SELECT * FROM v_record WHERE chrom = 'Y' AND pos <= 900000 AND coalesce(try_cast(info_end AS BIGINT), pos) >= 200000),
  med AS (SELECT sample_id, min_dp AS median_depth FROM (SELECT sample_id, min_dp, row_number() OVER (PARTITION BY sample_id ORDER BY min_dp) - 1 AS k, count(*) OVER (PARTITION BY sample_id) AS n
     FROM here WHERE min_dp IS NOT NULL) WHERE k = n // 2),
  cnt AS (SELECT sample_id, count(*) AS region_records, count(*) FILTER (alt_csv NOT IN ('<*>', '<NON_REF>')) AS region_variants FROM here GROUP BY 1),
  sry AS (SELECT p.sample_id, has_y, coalesce(region_records, 0) AS region_records, coalesce(region_variants, 0) AS region_variants, median_depth,
   CASE WHEN region_variants > 0 THEN 'Male' WHEN region_records IS NULL THEN 'unknown' WHEN coalesce(median_depth, 0) >= 5 THEN 'Male' ELSE 'Female' END AS sry_sex,
   CASE WHEN region_records IS NULL THEN 'warning' ELSE 'passed' END AS status
   FROM (SELECT sample_id, bool_or(chrom = 'Y') AS has_y FROM v_record GROUP BY 1) p LEFT JOIN cnt USING (sample_id) LEFT JOIN med USING (sample_id))"""


@check("ag13_sry_presence", f"WITH {SRY_SQL} SELECT * FROM sry")
def ag13(v):
    return Q.sry_check(v.record, region=("Y", 200000, 900000))


@check("pl20_sex_checks", f"""WITH {SEX_SQL}, {SRY_SQL} SELECT sample_id, CASE WHEN x_records = 0 AND y_records = 0 THEN 'unknown' WHEN y_hom_ref > 10000 THEN 'Male' ELSE 'Female' END AS chry_sex,
   CASE WHEN x_sites = 0 THEN 'unknown' WHEN x_het / x_sites::DOUBLE > 0.3 THEN 'Female' ELSE 'Male' END AS chrx_sex, sry_sex FROM sx JOIN sry USING (sample_id)""")
def pl20(v):
    sry = Q.sry_check(v.record, region=("Y", 200000, 900000)).select("sample_id", "sry_sex")
    return Q.sex_counts(v.record).join(sry, "sample_id").select("sample_id", "chry_sex", "chrx_sex", "sry_sex")


BUILD_SQL = """decl AS (SELECT sample_id, (['GRCh38','hg19',NULL,'hg38'])[sample_id % 4 + 1] AS declared FROM v_sample),
  spot AS (SELECT d.sample_id, declared, CASE WHEN bool_or(r.pos = s38.pos) THEN 'PASS' WHEN bool_or(r.pos = s37.pos) THEN 'FAIL' ELSE 'NOT_FOUND' END AS spot_check
    FROM decl d LEFT JOIN (SELECT * FROM v_record WHERE chrom = '19' AND alt_csv NOT IN ('<*>', '<NON_REF>')) r ON r.sample_id = d.sample_id,
      (SELECT pos FROM v_variant WHERE variant_id = 18) s38, (SELECT pos FROM v_variant WHERE variant_id = 43) s37 GROUP BY 1, 2)"""


def declared(v):
    text = F.when(F.col("sample_id") % 4 == 0, "GRCh38").when(F.col("sample_id") % 4 == 1, "hg19").when(F.col("sample_id") % 4 == 3, "hg38")
    return v.sample.select("sample_id", text.alias("declared"))


def sentinel(v):
    return v.variant.where(F.col("variant_id").isin(18, 43)).select(
        F.when(F.col("variant_id") == 18, "GRCh38").otherwise("GRCh37").alias("build"), "chrom", "pos")


@check("jn23_build_sentinel", f"WITH {BUILD_SQL} SELECT sample_id, spot_check FROM spot")
def jn23(v):
    return Q.sentinel_check(declared(v), v.record, sentinel(v)).select("sample_id", "spot_check")


@check("pl21_build_validation", f"""WITH {BUILD_SQL} SELECT sample_id, build_status, CASE WHEN build_status = 'FAIL' THEN 'WARN' ELSE build_status END AS scoring_status FROM (SELECT sample_id,
   CASE WHEN declared = 'hg19' THEN 'FAIL' WHEN spot_check = 'FAIL' THEN 'FAIL' WHEN spot_check = 'NOT_FOUND' AND declared IS NULL THEN 'WARN' ELSE 'PASS' END AS build_status FROM spot)""")
def pl21(v):
    return Q.validate_build(declared(v), v.record, sentinel(v)).select("sample_id", "build_status", "scoring_status")


@check("ag15_scoring_file_qc", """WITH r AS (SELECT pgs_id, CASE WHEN l_quantity > 49 AND l_orderkey % 3 = 0 THEN 'Un' ELSE chrom END AS chrom, effect_allele, CASE WHEN l_extendedprice < 905 THEN 'x' ELSE CAST(weight_h AS VARCHAR) END AS w FROM v_score_raw),
   c AS (SELECT pgs_id, count(*) AS variant_count, count(*) FILTER (chrom = 'Un') AS bad_chroms, count(*) FILTER (effect_allele NOT IN ('A','C','G','T')) AS bad_alleles, count(*) FILTER (try_cast(w AS DOUBLE) IS NULL) AS bad_weights FROM r GROUP BY 1)
   SELECT *, CASE WHEN variant_count < 5 THEN 'rejected' WHEN reasons <> '' THEN 'flagged' ELSE 'ok' END AS eligibility FROM (SELECT *, concat_ws(',', CASE WHEN variant_count < 5 THEN 'too_few_variants' END,
   CASE WHEN bad_chroms > 0 THEN 'invalid_chroms' END, CASE WHEN bad_alleles > variant_count * 0.1::DOUBLE THEN 'invalid_alleles' END, CASE WHEN bad_weights > 0 THEN 'bad_weights' END) AS reasons FROM c)""")
def ag15(v):
    rows = v.score_raw.select(
        "pgs_id", F.when((F.col("l_quantity") > 49) & (F.col("l_orderkey") % 3 == 0), "Un").otherwise(F.col("chrom")).alias("chrom"), "effect_allele",
        F.when(F.col("l_extendedprice") < 905, "x").otherwise(F.col("weight_h").cast("string")).alias("weight_text"),
    )
    return Q.scoring_file_quality(rows, ["pgs_id"]).withColumn("reasons", F.array_join("reasons", ","))


@check("ag28_coverage_estimate", """SELECT sample_id, mapped, platform, round(mapped * CASE WHEN platform IN ('ONT', 'PACBIO') THEN 5000 ELSE 150 END / 100000::DOUBLE, 1) AS coverage
   FROM (SELECT sample_id, count(*) AS mapped, (['ILLUMINA','ONT','PACBIO'])[sample_id % 3 + 1] AS platform FROM v_read WHERE (flag & 4) = 0 GROUP BY 1)""")
def ag28(v):
    mapped = v.read.where(F.col("flag").bitwiseAND(4) == 0).groupBy("sample_id").agg(F.count(F.lit(1)).alias("mapped"))
    platform = F.element_at(F.array(F.lit("ILLUMINA"), F.lit("ONT"), F.lit("PACBIO")), (F.col("sample_id") % 3 + 1).cast("int"))
    return mapped.withColumn("platform", platform).withColumn("coverage", H.coverage_estimate(F.col("mapped"), F.lit(100000), F.col("platform")))


@check("src16_header_facts", """SELECT concat('s', sample_id) AS file, CASE WHEN sample_id % 3 = 0 THEN 'GRCh38' WHEN sample_id % 3 = 1 THEN 'GRCh37' ELSE 'unknown' END AS build, n_contigs, CASE WHEN sample_id % 2 = 0 THEN concat('R', sample_id, ',S', sample_id, ',T') ELSE concat('S', sample_id) END AS samples, CAST(CASE WHEN sample_id % 2 = 0 THEN 3 ELSE 1 END AS INT) AS n_samples, (['DeepVariant 1.5', 'GATK HaplotypeCaller', 'strelka v2', NULL])[sample_id % 4 + 1] AS caller, true AS has_chr
   FROM (SELECT sample_id, count(DISTINCT chrom) AS n_contigs FROM v_block GROUP BY 1)""")
def src16(v):
    b = v.block.select("sample_id", "chrom").distinct()
    file = F.concat(F.lit("s"), F.col("sample_id").cast("string"))
    contigs = b.select(file.alias("file"), F.concat(F.lit("##contig=<ID=chr"), "chrom", F.lit(",length=1000>")).alias("value"))
    s = b.select("sample_id").distinct()
    ref = F.when(F.col("sample_id") % 3 == 0, "##reference=file:///GRCh38.fa").when(F.col("sample_id") % 3 == 1, "##reference=hs37d5").otherwise("##reference=x")
    # by turns: a DeepVariant line beside another caller's, a GATK command line beside an unknown source, a known source, none known
    turn = F.col("sample_id") % 4
    callers = [F.when(turn == 0, "##DeepVariant_version=1.5").when(turn == 1, '##GATKCommandLine=<ID=HaplotypeCaller>').otherwise("##x"),
               F.when(turn == 0, "##source=GATK").when(turn == 2, "##source=strelka v2").otherwise("##source=caller v1")]
    fixed = s.select(file.alias("file"), F.explode(F.array(
        ref, *callers, F.concat(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS"), F.col("sample_id").cast("string"), F.when(F.col("sample_id") % 2 == 0, "\tT").otherwise("")),
        F.when(F.col("sample_id") % 2 == 0, F.concat(F.lit("@RG\tID:1\tSM:R"), F.col("sample_id").cast("string"), F.lit("\tPL:ILLUMINA"))).otherwise("##x"))).alias("value"))
    return H.header_facts(contigs.unionByName(fixed)).select("file", "build", "n_contigs", "samples", "n_samples", "caller", "has_chr")
