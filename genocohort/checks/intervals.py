"""Reference-block expansion, liftover and target genotypes."""

from pyspark.sql import functions as F

from ..operators import alleles as A
from ..operators import blocks as B
from ..operators import intervals as I
from ..sources.vcf import detect_gvcf
from .projections import MAP_SQL
from .registry import check

EXPAND_SQL = """x AS (SELECT b.sample_id, v.chrom, v.pos, v.ref, b.gt, b.min_dp, b.pos AS block_pos
   FROM v_block b JOIN v_variant v ON b.chrom = v.chrom AND v.pos BETWEEN b.pos AND b.end_pos)"""


@check("jn3_block_expansion", f"WITH {EXPAND_SQL} SELECT sample_id, chrom, pos, ref, gt, min_dp, block_pos FROM x")
def jn3(v):
    return B.expand_blocks(v.block, v.variant)


@check("pf20_target_site_filter", """SELECT sample_id, chrom, pos, block_id FROM v_block b WHERE EXISTS (SELECT 1 FROM v_variant v WHERE v.chrom = b.chrom AND v.pos BETWEEN b.pos AND b.end_pos)""")
def pf20(v):
    return B.blocks_over_targets(v.block, v.variant).select("sample_id", "chrom", "pos", "block_id")


LIFT_SQL = """lifted AS (SELECT pgs_id, s.chrom, s.pos AS old_pos, s.pos + delta AS pos, effect_allele FROM v_score s JOIN v_chain c
    ON s.chrom = c.chrom AND s.pos BETWEEN src_start AND src_end),
  rates AS (SELECT pgs_id, n_total, coalesce(n_lifted, 0) AS n_lifted, coalesce(n_lifted, 0) / n_total::DOUBLE AS lift_rate
    FROM (SELECT pgs_id, count(*) AS n_total FROM v_score GROUP BY 1) LEFT JOIN (SELECT pgs_id, count(*) AS n_lifted FROM lifted GROUP BY 1) USING (pgs_id))"""


@check("jn4_liftover", f"WITH {LIFT_SQL} SELECT pgs_id, chrom, old_pos, pos, effect_allele FROM lifted WHERE pgs_id IN (SELECT pgs_id FROM rates WHERE lift_rate >= 0.5)")
def jn4(v):
    return I.lift_positions(v.score, v.chain, ["pgs_id"]).select("pgs_id", "chrom", "old_pos", "pos", "effect_allele")


@check("ag25_lift_rate_gate", f"WITH {LIFT_SQL} SELECT pgs_id, n_total, n_lifted, lift_rate, lift_rate >= 0.7 AS usable FROM rates")
def ag25(v):
    return I.lift_rates(v.score, I.lift_positions(v.score, v.chain), ["pgs_id"]).withColumn("usable", F.col("lift_rate") >= 0.7)


@check("src15_chain_intervals", "SELECT chrom, src_start, src_end, delta, '+' AS strand FROM v_chain")
def src15(v):
    return v.chain.withColumn("strand", F.lit("+"))


@check("pl7_genotypes_at_targets", f"""WITH {MAP_SQL}, sites AS (SELECT chrom, pos, ref FROM v_variant),
   c AS (SELECT sample_id, r.chrom, r.pos, r.ref, regexp_replace(alt_csv, ',<\\*>', '') AS alt, gt, 0 AS rk, CAST(0 AS BIGINT) AS st FROM v_record r
     JOIN sites s ON s.chrom = r.chrom AND s.pos = r.pos WHERE alt_csv NOT IN ('<*>', '<NON_REF>')
     UNION ALL SELECT b.sample_id, s.chrom, s.pos, s.ref, pick, b.gt, 1, -b.pos FROM v_block b
       JOIN (SELECT s.*, (SELECT min(t.x) FROM unnest(string_split(alleles, ',')) t(x) WHERE t.x <> s.ref) AS pick FROM sites s JOIN amap USING (chrom, pos)) s
       ON b.chrom = s.chrom AND s.pos BETWEEN b.pos AND b.end_pos WHERE pick IS NOT NULL AND s.ref IN ('A','C','G','T'))
   SELECT sample_id, chrom, pos, ref, alt, gt, rk = 1 AS from_block,
     CASE WHEN contains(gt, '.') THEN NULL ELSE CAST(substr(gt, 1, 1) = '1' AS INT) + CAST(substr(gt, 3, 1) = '1' AS INT) END AS dosage FROM c
   QUALIFY row_number() OVER (PARTITION BY sample_id, chrom, pos ORDER BY rk, st, gt, ref, alt) = 1""")
def pl7(v):
    return B.genotypes_at_targets(v.record, v.variant.select("chrom", "pos", "ref"), A.allele_map(v.score)).drop("alts")


@check("ag27_normalisation_counts", """SELECT chrom, count(*) AS total, CAST(sum(CASE WHEN alt_csv IN ('<*>','<NON_REF>') THEN 1 ELSE 0 END) AS BIGINT) AS ref_blocks,
   CAST(sum(CASE WHEN alt_csv LIKE '%,<*>' THEN 1 ELSE 0 END) AS BIGINT) AS stripped, CAST(sum(CASE WHEN alt_csv IN ('<*>','<NON_REF>') THEN 0 ELSE 1 END) AS BIGINT) AS kept FROM v_record GROUP BY 1""")
def ag27(v):
    return A.normalisation_counts(v.record, ["chrom"])


@check("src2_detect_gvcf", """SELECT sample_id, bool_or(alt_csv LIKE '%<%' OR info_end IS NOT NULL) OR sample_id % 7 = 0 AS is_gvcf FROM v_record GROUP BY sample_id""")
def src2(v):
    name = F.when(F.col("sample_id") % 7 == 0, "s.g.vcf.gz").otherwise("s.vcf.gz")
    return detect_gvcf(v.record.withColumn("file", name), ["sample_id"])
