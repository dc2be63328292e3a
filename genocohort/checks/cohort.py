"""From the text of a cohort's VCF file to percentiles: several samples a line, several ALTs a record, reference blocks."""

from pyspark.sql import functions as F

from ..operators.picks import first_rows
from ..plans.polygenic import score_vcf_lines
from .distribution import ERF_SQL
from .registry import check

GENOTYPES = ["0/0", "0|1", "1/1", "1/2", "0/2", "2/2", "./.", "1"]
SAMPLES = 6

COHORT_SQL = f"""hs AS (SELECT unnest(range({SAMPLES})) AS n),
  hv AS (SELECT variant_id, chrom, pos, ref, alt, alt || 'A' AS alt2, variant_id % 4 = 1 AND length(ref) = 1 AND length(alt) = 1 AS blocked FROM v_variant
     QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY variant_id) = 1),
  hw AS (SELECT concat('PGS90000', variant_id % 5) AS pgs_id, *, CASE WHEN variant_id % 3 = 0 THEN alt WHEN variant_id % 3 = 1 AND NOT blocked THEN alt2 ELSE ref END AS effect,
     (variant_id % 7 - 3) / 64.0::DOUBLE AS weight FROM hv),
  hd AS (SELECT concat('h', n) AS sample_id, pgs_id, weight, CASE WHEN blocked THEN CASE WHEN effect = ref THEN 2 ELSE 0 END
      WHEN g IN ('./.', '1') THEN NULL ELSE (substr(g, 1, 1) = k)::INT + (substr(g, 3, 1) = k)::INT END AS d
    FROM (SELECT *, ({GENOTYPES})[(variant_id * 7 + n * 3) % {len(GENOTYPES)} + 1] AS g, CASE effect WHEN ref THEN '0' WHEN alt THEN '1' ELSE '2' END AS k FROM hw, hs)),
  hsum AS (SELECT sample_id, pgs_id, count(*) AS total, count(d) AS matched, coalesce(sum(d * weight), 0)::DOUBLE AS score_sum, sum(d * weight) / (2 * count(d)) AS raw FROM hd GROUP BY 1, 2),
  hz AS (SELECT *, (raw - CAST(substr(pgs_id, 9) AS INT) / 1000.0::DOUBLE) / 0.02::DOUBLE AS zz FROM hsum)"""


def cohort_variants(v):
    """One variant a position, a second ALT, and whether a reference block stands there instead of a call."""
    plain = (F.length("ref") == 1) & (F.length("alt") == 1)
    return first_rows(v.variant, ["chrom", "pos"], ["variant_id"]).select(
        "variant_id", "chrom", "pos", "ref", "alt", F.concat("alt", F.lit("A")).alias("alt2"), ((F.col("variant_id") % 4 == 1) & plain).alias("blocked")
    )


COHORT_HEADER = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *(f"h{n}" for n in range(SAMPLES))])


def cohort_body(v):
    k = F.col("variant_id")
    gts = F.array(*[F.lit(g) for g in GENOTYPES])
    called = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda n: F.concat(F.element_at(gts, ((k * 7 + n * 3) % len(GENOTYPES) + 1).cast("int")), F.lit(":9")))
    head = [F.concat(F.lit("chr"), F.when(F.col("chrom") == "MT", "M").otherwise(F.col("chrom")))]
    call = [F.col("pos").cast("string"), F.lit("."), F.col("ref"), F.concat_ws(",", "alt", "alt2"), F.lit("50"), F.lit("PASS"), F.lit("DB"), F.lit("GT:DP"), F.array_join(called, "\t")]
    block = [(F.col("pos") - 15).cast("string"), F.lit("."), F.lit("N"), F.lit("<*>"), F.lit("."), F.lit("."), F.concat(F.lit("END="), (F.col("pos") + 15).cast("string")), F.lit("GT:DP"),
             F.lit("\t".join(["0/0:9"] * SAMPLES))]
    return cohort_variants(v).select(F.when(F.col("blocked"), F.concat_ws("\t", *head, *block)).otherwise(F.concat_ws("\t", *head, *call)).alias("value"))


def cohort_lines(v):
    header = v.spark.range(1).select(F.lit(COHORT_HEADER).alias("value"))
    return header.unionByName(cohort_body(v)).withColumn("file", F.lit("/in/cohort.g.vcf.gz"))


@check("pl4_vcf_to_percentile", f"""WITH {COHORT_SQL} SELECT sample_id, pgs_id, round(score_sum, 6) AS score_sum, matched, total, round(matched * 100.0::DOUBLE / total, 1) AS match_rate_value,
    CASE WHEN matched > 0 AND abs(zz) <= 6 THEN round(least(greatest(50 * (1 + {ERF_SQL.format(x='(zz / sqrt(2))')}), 0.5), 99.5), 1) END AS percentile FROM hz""")
def pl4_vcf(v):
    sites = cohort_variants(v)
    k = F.col("variant_id")
    effect = F.when(k % 3 == 0, F.col("alt")).when((k % 3 == 1) & ~F.col("blocked"), F.col("alt2")).otherwise(F.col("ref"))
    weights = sites.withColumn("effect_allele", effect).select(
        F.concat(F.lit("PGS90000"), (k % 5).cast("string")).alias("pgs_id"), "chrom", "pos", "effect_allele",
        F.when(F.col("effect_allele") == F.col("ref"), F.col("alt")).otherwise(F.col("ref")).alias("other_allele"), ((k % 7 - 3) / 64).alias("weight"),
    )
    stats = v.spark.range(5).select(
        F.concat(F.lit("PGS90000"), F.col("id").cast("string")).alias("pgs_id"), F.lit("EUR").alias("population"), (F.col("id") / 1000).alias("mean"), F.lit(0.02).alias("std"))
    ancestry = v.spark.range(SAMPLES).select(F.concat(F.lit("h"), F.col("id").cast("string")).alias("sample_id"), F.create_map(F.lit("EUR"), F.lit(1.0)).alias("shares"))
    out = score_vcf_lines(cohort_lines(v), weights, sites.select("chrom", "pos", "ref"), ancestry, stats)
    return out.where("is_primary").select("sample_id", "pgs_id", F.round("score_sum", 6).alias("score_sum"), "matched", "total", "match_rate_value", "percentile")
