"""File formats, written tables, ingest and arrivals: texts are made from the given tables and read back."""

from pyspark.sql import functions as F

from ..functions import files as N
from ..plans.ingest import ingest_weights
from ..session import shared_folder
from ..sources import documents as D
from ..sources import reads as RD
from ..sources import scorefile as SF
from ..sources import sinks as S
from ..sources import tables as T
from ..sources import vcf as V
from ..streaming.arrivals import prepare_arrivals
from .cohort import COHORT_HEADER, COHORT_SQL, GENOTYPES, cohort_body
from .distribution import MEMBER_SQL, member_scores
from .registry import check


def text(c):
    return F.col(c).cast("string")


def vcf_lines(v):
    """gVCF text of every sample: a header line each, then the records."""
    info = F.when(F.col("info_end").isNotNull(), F.concat(F.lit("END="), "info_end")).otherwise("AC=1;DB")
    chrom = F.concat(F.lit("chr"), F.when(F.col("chrom") == "MT", "M").otherwise(F.col("chrom")))
    body = v.record.select(
        F.concat(F.lit("/in/s"), text("sample_id"), F.lit(".g.vcf.gz")).alias("file"),
        F.concat_ws("\t", chrom, text("pos"), "id", F.lower("ref"), "alt_csv", F.lit("50"), F.lit("PASS"), info, F.lit("GT:MIN_DP"),
                    F.concat("gt", F.lit(":"), text("min_dp"))).alias("value"))
    heads = v.sample.select(
        F.concat(F.lit("/in/s"), text("sample_id"), F.lit(".g.vcf.gz")).alias("file"),
        F.explode(F.array(F.lit("##fileformat=VCFv4.2"), F.concat(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts"), text("sample_id")))).alias("value"))
    return heads.unionByName(body)


VCF_SQL = "SELECT concat('s', sample_id) AS sample_id, chrom, pos, coalesce(try_cast(info_end AS BIGINT), pos) AS end_pos, id, ref, alt_csv, gt, min_dp, alt_csv IN ('<*>', '<NON_REF>') AS is_ref_block FROM v_record"


@check("src1_vcf_records", VCF_SQL)
def src1(v):
    return V.parse_vcf(vcf_lines(v)).select(
        N.sample_from_file(N.base_name(F.col("file"))).alias("sample_id"), "chrom", "pos", "end_pos", "id", "ref", "alt_csv", "gt", "min_dp", "is_ref_block")


def score_lines(v):
    """Score files: metadata, a header row, weights; every third file has harmonised columns."""
    number = F.substring("pgs_id", 4, 20).cast("bigint")
    harmonised = number % 3 == 0
    pos = text("pos")
    row = F.when(
        harmonised,
        F.concat_ws("\t", F.lit("rs"), "chrom", F.lit("1"), "effect_allele", "other_allele", text("weight_h"), "chrom", pos),
    ).otherwise(F.concat_ws("\t", F.lit("rs"), F.concat(F.lit("chr"), "chrom"), pos, "effect_allele",
                            F.when(F.col("weight_h") == 0, "NA").otherwise(F.col("other_allele")), F.when(F.col("weight_h") == 5, "bad").otherwise(text("weight_h"))))
    body = v.score.select(F.col("pgs_id").alias("file"), row.alias("value"))
    base = ["rsID", "chr_name", "chr_position", "effect_allele", "other_allele", "effect_weight"]
    # every score keeps a row of each of its positions, so the scores are those of the raw rows
    heads = v.score_raw.select("pgs_id").distinct().select(
        F.col("pgs_id").alias("file"),
        F.explode(F.array(
            F.concat(F.lit("#pgs_id="), "pgs_id"), F.lit("###PGS CATALOG SCORING FILE"), F.when(harmonised, "#genome_build=GRCh37").otherwise("#genome_build=GRCh38"),
            F.when(harmonised, "\t".join([*base, "hm_chr", "hm_pos"])).otherwise("\t".join(base)))).alias("value"))
    return heads.unionByName(body)


WEIGHT_SQL = """SELECT pgs_id, chrom, pos, effect_allele, CASE WHEN n % 3 <> 0 AND weight_h = 0 THEN '' ELSE other_allele END AS other_allele, weight_h::DOUBLE AS weight
   FROM (SELECT *, CAST(substr(pgs_id, 4) AS BIGINT) AS n FROM v_score) WHERE n % 3 = 0 OR weight_h <> 5"""


@check("src3_score_file", WEIGHT_SQL)
def src3(v):
    return SF.parse_weights(score_lines(v)).select(
        F.col("file").alias("pgs_id"), "chrom", "pos", "effect_allele", F.coalesce("other_allele", F.lit("")).alias("other_allele"), "weight")


@check("src3_score_file_metadata", "SELECT DISTINCT pgs_id, CASE WHEN CAST(substr(pgs_id, 4) AS BIGINT) % 3 = 0 THEN 'GRCh37' ELSE 'GRCh38' END AS genome_build FROM v_score")
def src3_meta(v):
    m = SF.parse_metadata(score_lines(v))
    return m.select(F.element_at("metadata", "pgs_id").alias("pgs_id"), F.element_at("metadata", "genome_build").alias("genome_build"))


@check("src4_score_corpus", WEIGHT_SQL)
def src4(v):
    folder = shared_folder(v.spark, "corpus")
    score_lines(v).withColumn("name", F.concat("file", F.lit("_hmPOS_GRCh38"))).drop("file").repartition(8, "name").write.partitionBy("name").text(folder)
    return SF.read_weights(v.spark, f"{folder}/name=PGS*/*").select(
        "pgs_id", "chrom", "pos", "effect_allele", F.coalesce("other_allele", F.lit("")).alias("other_allele"), "weight")


@check("src5_panel_samples", "SELECT concat('S', sample_id) AS iid, superpop FROM v_sample")
def src5(v):
    rows = v.sample.select(F.concat(F.lit("S"), text("sample_id")).alias("iid"), "superpop").unionByName(
        v.table("region").select(F.lit("#IID").alias("iid"), F.lit("SuperPop").alias("superpop")))
    return T.parse_panel_samples(rows)


@check("src7_clinvar_records", "SELECT chrom, pos, ref, alt, clnsig, geneinfo FROM v_variant")
def src7(v):
    chrom = F.when(F.col("variant_id") % 2 == 0, F.concat(F.lit("chr"), "chrom")).otherwise(F.col("chrom"))
    lines = v.variant.select(F.lit("clinvar.vcf.gz").alias("file"), F.concat_ws(
        "\t", chrom, text("pos"), "rsid", "ref", "alt", F.lit("."), F.lit("."), F.concat(F.lit("CLNSIG="), "clnsig", F.lit(";GENEINFO="), "geneinfo")).alias("value"))
    return V.clinvar_table(V.parse_vcf(lines))


@check("src8_pca_weights", "SELECT chrom, pos, ref, alt, alt AS a1, variant_id / 8.0::DOUBLE AS pc1, variant_id / 8.0::DOUBLE * 10 AS pc10 FROM v_variant")
def src8(v):
    rows = v.variant.select(
        F.col("chrom").alias("#CHROM"), F.concat_ws(":", "chrom", text("pos"), "ref", "alt").alias("ID"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), F.col("alt").alias("A1"),
        *[(F.col("variant_id") / 8 * i).cast("string").alias(f"PC{i}") for i in range(1, 11)])
    return T.pca_weight_table(rows).select("chrom", "pos", "ref", "alt", "a1", F.get("loadings", F.lit(0)).alias("pc1"), F.get("loadings", F.lit(9)).alias("pc10"))


@check("src9_y_markers", "SELECT rsid AS name, gene AS haplogroup, pos, ref, alt FROM v_variant WHERE length(ref) = 1 AND length(alt) = 1 AND variant_id % 6 <> 0")
def src9(v):
    rows = v.variant.select(
        F.col("rsid").alias("name"), F.when(F.col("variant_id") % 2 == 0, F.concat("gene", F.lit("~"))).otherwise(F.concat("gene", F.lit(" (notes)"))).alias("haplogroup"),
        F.when(F.col("variant_id") % 6 == 0, "12..13").otherwise(text("pos")).alias("pos"), F.concat(F.lower("ref"), F.lit("->"), "alt").alias("mutation"))
    return T.parse_y_markers(rows)


@check("src10_sam_reads", "SELECT sample_id, chrom, start_pos, flag, mapq, cigar, seq, count(*) AS n FROM v_read GROUP BY ALL")
def src10(v):
    chrom = F.concat(F.lit("chr"), F.when(F.col("chrom") == "MT", "M").otherwise(F.col("chrom")))
    lines = v.read.select("sample_id", F.concat_ws(
        "\t", F.concat(F.lit("r"), text("l_orderkey")), text("flag"), chrom, text("start_pos"), text("mapq"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", "quals").alias("value"))
    return RD.parse_sam(lines).groupBy("sample_id", "chrom", "start_pos", "flag", "mapq", "cigar", "seq").agg(F.count(F.lit(1)).alias("n"))


@check("src11_report_documents", """SELECT CAST(event_id AS VARCHAR) AS task_id, CAST(user_id AS VARCHAR) AS file_id, event_type AS test_id, value AS percentile, event_id % 2 = 0 AS no_report FROM events WHERE event_id % 9 <> 0""")
def src11(v):
    e = v.table("events")
    doc = F.to_json(F.struct(text("event_id").alias("task_id"), text("user_id").alias("file_id"), F.col("event_type").alias("test_id"),
                             F.struct(F.col("value").alias("percentile"), (F.col("event_id") % 2 == 0).alias("no_report")).alias("result")))
    lines = e.select(F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{\"task_id\": "), text("event_id"))).otherwise(doc).alias("value"))
    return D.parse_json(lines, D.REPORT).select("task_id", "file_id", "test_id", "result.percentile", "result.no_report")


@check("src12_line_log", "SELECT CAST(event_id AS VARCHAR) AS task_id, event_type AS error, CAST(user_id AS VARCHAR) AS pgs_id FROM events WHERE event_id % 9 <> 0")
def src12(v):
    doc = F.to_json(F.struct(text("event_id").alias("task_id"), F.col("event_type").alias("error"), text("user_id").alias("pgs_id")))
    lines = v.table("events").select(F.when(F.col("event_id") % 9 == 0, F.lit("not json")).otherwise(doc).alias("value"))
    return D.parse_json(lines, D.LOG).select("task_id", "error", "pgs_id")


# ---- written tables ----------------------------------------------------------------------------------------------------


@check("snk1_weight_table", "SELECT pgs_id, chrom, pos, effect_allele, other_allele, weight FROM v_score")
def snk1(v):
    folder = shared_folder(v.spark, "weights")
    S.write_weights(v.score.drop("weight_h"), folder)
    return v.spark.read.parquet(folder).select("pgs_id", "chrom", "pos", "effect_allele", "other_allele", "weight")


@check("snk2_stats_table", """SELECT pgs_id, population, mean + CASE WHEN CAST(substr(pgs_id, 4) AS BIGINT) % 5 = 0 THEN 2 WHEN n_samples % 2 = 0 THEN 0 ELSE 1 END AS mean FROM v_stats""")
def snk2(v):
    """Half of the pairs first, then all without force, then every fifth score by force: the others stay."""
    folder = shared_folder(v.spark, "stats")
    s = v.stats.select("pgs_id", "population", "mean", "n_samples")
    stored = lambda: v.spark.read.parquet(folder).select(*s.columns)
    S.write_stats(s.where("n_samples % 2 = 0"), None, folder)
    S.write_stats(s.withColumn("mean", F.col("mean") + 1), stored(), folder)
    forced = s.where(F.substring("pgs_id", 4, 20).cast("bigint") % 5 == 0)
    S.write_stats(forced.withColumn("mean", F.col("mean") + 2), stored(), folder, force=True)
    return v.spark.read.parquet(folder).select("pgs_id", "population", "mean")


@check("snk3_raw_scores", f"WITH {MEMBER_SQL} SELECT pgs_id, population, sample_id, raw_score FROM ms")
def snk3(v):
    """Scores arrive in two calls."""
    folder = shared_folder(v.spark, "scores")
    members = member_scores(v)  # the condition of either call goes down to the weights: no score is summed twice
    odd = F.substring("pgs_id", 4, 20).cast("bigint") % 2 == 1
    S.write_raw_scores(members.where(odd), folder)
    S.write_raw_scores(members.where(~odd), folder, v.spark.read.parquet(folder))
    return v.spark.read.parquet(folder).select("pgs_id", "population", "sample_id", "raw_score")


@check("snk7_append_log", "SELECT CAST(event_id AS VARCHAR) AS task_id, event_type AS status FROM events UNION ALL SELECT CAST(event_id AS VARCHAR), 'again' FROM events WHERE event_type = 'error'")
def snk7(v):
    folder = shared_folder(v.spark, "log")
    e = v.table("events")
    S.append_log(e.select(text("event_id").alias("task_id"), F.col("event_type").alias("status")), folder)
    S.append_log(e.where("event_type = 'error'").select(text("event_id").alias("task_id"), F.lit("again").alias("status")), folder)
    return D.read_log(v.spark, folder).select("task_id", "status")


@check("st1_arriving_files", f"""WITH {COHORT_SQL} {VCF_SQL.replace("concat('s', sample_id) AS sample_id", "CAST(sample_id % 4 AS VARCHAR) AS lot, 'file' AS sample_id")}
   UNION ALL SELECT '4', concat('h', n), chrom, CASE WHEN blocked THEN pos - 15 ELSE pos END, CASE WHEN blocked THEN pos + 15 ELSE pos END, '.', CASE WHEN blocked THEN 'N' ELSE ref END,
     CASE WHEN blocked THEN '<*>' ELSE concat(alt, ',', alt2) END, CASE WHEN blocked THEN '0/0' ELSE ({GENOTYPES})[(variant_id * 7 + n * 3) % {len(GENOTYPES)} + 1] END, NULL, blocked FROM hv, hs""")
def st1(v):
    """Lots of files arrive one after the other, the last one a file of six samples, in parts of which only one holds the header; each is
    taken in once, and every sample keeps its records."""
    source, target, state = (shared_folder(v.spark, n) for n in ("arrivals", "records", "state"))
    lines = vcf_lines(v).withColumn("lot", (F.regexp_extract("file", r"s(\d+)\.", 1).cast("bigint") % 4).cast("string")).drop("file")
    lots = lambda *which: lines.where(F.col("lot").isin(*which)).write.mode("append").partitionBy("lot").text(source)
    # one file, as its header names all of it: one task writes the lines as they come, below the header, and sorts nothing
    plain = {"header": True, "sep": "\u0001", "comment": "\u0002", "quote": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    file = lambda: cohort_body(v).select(F.col("value").alias(COHORT_HEADER)).repartition(1).write.mode("append").options(**plain).csv(f"{source}/lot=4")
    for arrive in (lambda: lots("0", "1"), lambda: lots("2", "3"), file):
        arrive()
        prepare_arrivals(v.spark, source, target, state)
    return v.spark.read.parquet(target).select(
        F.col("lot").cast("string").alias("lot"), F.when(F.col("lot") == 4, F.col("sample_id")).otherwise(F.lit("file")).alias("sample_id"), "chrom", "pos", "end_pos", "id", "ref", "alt_csv", "gt",
        "min_dp", "is_ref_block")


# ---- ingest -----------------------------------------------------------------------------------------------------------

INGEST_SQL = """b AS (SELECT DISTINCT pgs_id, CASE WHEN CAST(substr(pgs_id, 4) AS BIGINT) % 3 = 0 THEN 'GRCh37' ELSE 'GRCh38' END AS build FROM v_score_raw),
  r AS (SELECT s.*, build FROM v_score_raw s JOIN b USING (pgs_id)),
  l AS (SELECT r.* EXCLUDE (pos), r.pos + delta AS pos FROM r JOIN v_chain c ON c.chrom = r.chrom AND r.pos BETWEEN src_start AND src_end WHERE build = 'GRCh37'),
  g AS (SELECT pgs_id FROM (SELECT pgs_id, count(*) AS n FROM r WHERE build = 'GRCh37' GROUP BY 1) JOIN (SELECT pgs_id, count(*) AS k FROM l GROUP BY 1) USING (pgs_id) WHERE k / n::DOUBLE >= 0.5),
  p AS (SELECT * FROM r WHERE build = 'GRCh38' UNION ALL BY NAME SELECT * FROM l WHERE pgs_id IN (SELECT pgs_id FROM g)),
  q AS (SELECT pgs_id, count(*) AS n, count(*) FILTER (effect_allele NOT IN ('A','C','G','T')) AS ba FROM p GROUP BY 1),
  st AS (SELECT b.pgs_id, build, coalesce(n, 0) AS variant_count, CASE WHEN n IS NULL OR n < 5 THEN 'rejected' WHEN ba > n * 0.1::DOUBLE THEN 'flagged' ELSE 'ok' END AS eligibility,
     CASE WHEN n IS NULL THEN CASE WHEN build = 'GRCh38' THEN 'zero_variants' ELSE 'liftover_failed' END ELSE concat_ws(',', CASE WHEN n < 5 THEN 'too_few_variants' END, CASE WHEN ba > n * 0.1::DOUBLE THEN 'invalid_alleles' END) END AS reasons FROM b LEFT JOIN q USING (pgs_id))"""


def ingest(v):
    rows = v.score_raw.withColumn("weight", F.col("weight_h") / 64).withColumn("weight_text", text("weight_h"))
    number = F.substring("pgs_id", 4, 20).cast("bigint")
    builds = v.score_raw.select("pgs_id").distinct().withColumn("build", F.when(number % 3 == 0, "GRCh37").otherwise("GRCh38"))
    return ingest_weights(rows, builds, v.chain, v.SCORE_ORDER)


@check("pl1_ingest_weights", f"""WITH {INGEST_SQL} SELECT pgs_id, chrom, pos, effect_allele, other_allele, weight_h / 64.0::DOUBLE AS weight FROM p WHERE pgs_id IN (SELECT pgs_id FROM st WHERE eligibility <> 'rejected')
   QUALIFY row_number() OVER (PARTITION BY pgs_id, chrom, pos, effect_allele ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount) = 1""")
def pl1(v):
    return ingest(v)["weights"]


@check("pl1_ingest_status", f"WITH {INGEST_SQL} SELECT * FROM st")
def pl1_status(v):
    return ingest(v)["status"]
