"""Pileup genotypes and scores from aligned reads."""

from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions import genotype as G
from ..operators import alleles as A
from ..operators import lookup as L
from ..operators import pileup as P
from ..operators.picks import never_broadcast
from .projections import MAP_SQL
from .registry import check

SITE_SQL = """obs AS (SELECT r.sample_id, v.variant_id, v.chrom, v.pos, v.ref, v.alt, r.base, (flag & 16) <> 0 AS rev FROM v_read r JOIN v_variant v ON v.chrom = r.chrom AND v.pos = r.start_pos + 19
    WHERE mapq >= 20 AND baseq >= 20 AND (flag & 1284) = 0)"""
COUNT_SQL = f"""{SITE_SQL}, bc AS (SELECT sample_id, variant_id, chrom, pos, ref, alt, count(*) AS depth,
   count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t,
   count(*) FILTER (base = ref[1]) AS ref_n, count(*) FILTER (base = alt[1]) AS alt_n,
   count(*) FILTER (base = translate(ref[1], 'ACGT', 'TGCA')) AS ref_c, count(*) FILTER (base = translate(alt[1], 'ACGT', 'TGCA')) AS alt_c,
   count(*) FILTER (base = alt[1] AND NOT rev) AS alt_fwd, count(*) FILTER (base = alt[1] AND rev) AS alt_rev
   FROM obs WHERE length(ref) = length(alt) GROUP BY ALL)"""
CALL_SQL = f"""{COUNT_SQL}, sn AS (SELECT *, depth >= 8 AND alt_n = depth AND variant_id % 10 = 0 AS wrong, ref_n = 0 AND alt_n = 0 AND (ref_c > 0 OR alt_c > 0) AS flip FROM bc),
  sn2 AS (SELECT *, CASE WHEN flip THEN alt_c ELSE alt_n END AS alt_count FROM sn),
  snv AS (SELECT sample_id, chrom, pos, ref, alt, depth, alt_count, CASE WHEN wrong THEN 0 WHEN depth < 8 THEN NULL WHEN alt_count / depth::DOUBLE < 0.15 THEN 0 WHEN alt_count / depth::DOUBLE > 0.85 THEN 2 ELSE 1 END AS dosage,
     wrong AS ref_sanity_failed, depth >= 8 AND NOT wrong AND flip AS strand_flip, wrong, alt_fwd, alt_rev FROM sn2),
  snvs AS (SELECT *, coalesce(NOT wrong AND dosage > 0 AND depth >= 10 AND alt_fwd + alt_rev >= 3 AND (alt_fwd / (alt_fwd + alt_rev)::DOUBLE > 0.9 OR alt_fwd / (alt_fwd + alt_rev)::DOUBLE < 0.1), false) AS strand_bias FROM snv)"""
VERDICT_SQL = """vd AS (SELECT r.sample_id, v.chrom, v.pos, v.ref, v.alt, r.cigar, CASE
    WHEN length(v.ref) > length(v.alt) THEN CASE WHEN cigar IN ('50M', '20M2I28M', '25M25M') THEN 'ref' WHEN cigar IN ('20M2D30M', '5S20M2D25M') THEN 'alt' WHEN cigar = '20M3D30M' THEN 'other' END
    ELSE CASE WHEN cigar = '20M' THEN NULL WHEN cigar = '20M2I28M' THEN 'alt' ELSE 'ref' END END AS verdict
   FROM v_read r JOIN v_variant v ON v.chrom = r.chrom AND v.pos = r.start_pos + 19 WHERE mapq >= 20 AND (flag & 3332) = 0 AND length(v.ref) <> length(v.alt)),
  ic AS (SELECT sample_id, chrom, pos, ref, alt, count(*) AS depth, count(*) FILTER (verdict = 'ref') AS ref_count, count(*) FILTER (verdict = 'alt') AS alt_count, count(*) FILTER (verdict = 'other') AS other_count FROM vd WHERE verdict IS NOT NULL GROUP BY ALL),
  ind AS (SELECT *, CASE WHEN depth < 8 THEN NULL WHEN alt_count / depth::DOUBLE >= 0.85 THEN 2 WHEN alt_count / depth::DOUBLE >= 0.2 THEN 1 ELSE 0 END AS dosage FROM ic)"""
GT = "CASE {d} WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' ELSE './.' END"


def snv_sites(v):
    return v.variant.select("chrom", "pos", "ref", "alt").where("length(ref) = length(alt)")


def indel_sites(v):
    return v.variant.select("chrom", "pos", "ref", "alt").where("length(ref) <> length(alt)")


def reference_bases(v):
    base = F.col("ref").substr(1, 1)
    return v.variant.select("chrom", "pos", F.when(F.col("variant_id") % 10 == 0, G.complement(base)).otherwise(base).alias("base"))


@check("jn17_reads_over_sites", """SELECT r.sample_id, v.chrom, v.pos, cigar, count(*) AS reads FROM v_read r JOIN v_variant v ON v.chrom = r.chrom AND v.pos = r.start_pos + 19 GROUP BY ALL""")
def jn17(v):
    over = P.reads_over_sites(v.read, v.variant.select("chrom", "pos"))
    return over.groupBy("sample_id", "chrom", F.col("site_pos").alias("pos"), "cigar").agg(F.count(F.lit(1)).alias("reads"))


@check("pf12_pileup_filter", f"WITH {SITE_SQL} SELECT sample_id, chrom, pos, base, rev AS is_reverse, count(*) AS n FROM obs GROUP BY ALL")
def pf12(v):
    o = P.base_observations(v.read, v.variant.select("chrom", "pos"))
    return o.groupBy("sample_id", "chrom", F.col("site_pos").alias("pos"), "base", "is_reverse").agg(F.count(F.lit(1)).alias("n"))


@check("ag19_base_counts", f"WITH {COUNT_SQL} SELECT sample_id, chrom, pos, depth, a, c, g, t, alt_fwd, alt_rev FROM bc")
def ag19(v):
    c = P.base_counts(P.base_observations(v.read, snv_sites(v)), P.SITE_KEYS)
    one = {b.lower(): F.col(f"{b}_fwd") + F.col(f"{b}_rev") for b in "ACGT"}
    return c.select("sample_id", "chrom", F.col("site_pos").alias("pos"), "depth", *[x.alias(n) for n, x in one.items()],
                    P._count_of(F.col("alt"), ["fwd"]).alias("alt_fwd"), P._count_of(F.col("alt"), ["rev"]).alias("alt_rev"))


def snv_calls(v):
    counts = P.base_counts(P.base_observations(v.read, snv_sites(v)), P.SITE_KEYS).withColumnRenamed("site_pos", "pos")
    return P.call_snvs(counts, reference_bases(v))


@check("sc4_snv_genotype", f"WITH {CALL_SQL} SELECT sample_id, chrom, pos, depth, dosage FROM snvs")
def sc4(v):
    return snv_calls(v).select("sample_id", "chrom", "pos", "depth", "dosage")


@check("jn18_reference_base", f"WITH {CALL_SQL} SELECT sample_id, bc.chrom, bc.pos, CASE WHEN variant_id % 10 = 0 THEN translate(ref[1], 'ACGT', 'TGCA') ELSE ref[1] END AS reference_base FROM bc")
def jn18(v):
    return snv_calls(v).select("sample_id", "chrom", "pos", "reference_base")


@check("sc28_reference_sanity", f"WITH {CALL_SQL} SELECT sample_id, chrom, pos, ref_sanity_failed, strand_flip FROM snvs")
def sc28(v):
    return snv_calls(v).select("sample_id", "chrom", "pos", "ref_sanity_failed", "strand_flip")


@check("sc27_strand_bias", f"WITH {CALL_SQL} SELECT sample_id, chrom, pos, strand_bias FROM snvs")
def sc27(v):
    return snv_calls(v).select("sample_id", "chrom", "pos", "strand_bias")


@check("wn10_cigar_walk", f"WITH {VERDICT_SQL} SELECT sample_id, chrom, pos, cigar, verdict, count(*) AS reads FROM vd WHERE verdict IS NOT NULL GROUP BY ALL")
def wn10(v):
    d = P.indel_verdicts(v.read, indel_sites(v))
    return d.groupBy("sample_id", "chrom", F.col("site_pos").alias("pos"), "cigar", "verdict").agg(F.count(F.lit(1)).alias("reads"))


@check("ag21_indel_counts", f"WITH {VERDICT_SQL} SELECT sample_id, chrom, pos, depth, ref_count, alt_count, other_count FROM ic")
def ag21(v):
    c = P.call_indels(P.indel_verdicts(v.read, indel_sites(v)), P.SITE_KEYS)
    return c.select("sample_id", "chrom", F.col("site_pos").alias("pos"), "depth", "ref_count", "alt_count", "other_count")


@check("sc5_indel_genotype", f"WITH {VERDICT_SQL} SELECT sample_id, chrom, pos, dosage, {GT.format(d='dosage')} AS genotype FROM ind")
def sc5(v):
    c = P.call_indels(P.indel_verdicts(v.read, indel_sites(v)), P.SITE_KEYS)
    return c.select("sample_id", "chrom", F.col("site_pos").alias("pos"), "dosage", "genotype")


@check("pl8_pileup_genotypes", f"""WITH {CALL_SQL}, {VERDICT_SQL} SELECT sample_id, chrom, pos, ref, alt, depth, alt_count, dosage, {GT.format(d='dosage')} AS genotype FROM snvs
   UNION ALL SELECT sample_id, chrom, pos, ref, alt, depth, alt_count, dosage, {GT.format(d='dosage')} FROM ind""")
def pl8(v):
    return P.genotype_sites(v.read, v.variant.select("chrom", "pos", "ref", "alt"), reference_bases(v)).select(
        "sample_id", "chrom", "pos", "ref", "alt", "depth", "alt_count", "dosage", "genotype")


READ_SCORE_SQL = f"""{SITE_SQL}, sc AS (SELECT sample_id, chrom, pos, count(*) AS depth, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t FROM obs GROUP BY ALL),
  e AS (SELECT sample_id, pgs_id, weight, depth, CASE effect_allele[1] WHEN 'A' THEN a WHEN 'C' THEN c WHEN 'G' THEN g WHEN 'T' THEN t ELSE 0 END AS d1,
     CASE effect_allele[1] WHEN 'T' THEN a WHEN 'G' THEN c WHEN 'C' THEN g WHEN 'A' THEN t ELSE 0 END AS d2 FROM sc JOIN v_score USING (chrom, pos)),
  f AS (SELECT *, d1 = 0 AND d2 > 0 AS flip, CASE WHEN d1 = 0 AND d2 > 0 THEN d2 ELSE d1 END AS n FROM e),
  rs AS (SELECT sample_id, pgs_id, coalesce(sum(CASE WHEN n / depth::DOUBLE < 0.15 THEN 0 WHEN n / depth::DOUBLE > 0.85 THEN 2 ELSE 1 END * weight) FILTER (depth >= 8), 0) AS score_sum, count(*) FILTER (depth >= 8) AS matched,
     count(*) FILTER (depth >= 8 AND flip) AS strand_flips FROM f GROUP BY 1, 2),
  tot AS (SELECT pgs_id, count(*) AS total FROM v_score GROUP BY 1)"""


@check("ag22_read_score_sums", f"WITH {READ_SCORE_SQL} SELECT sample_id, pgs_id, matched, total - matched AS missing, total - matched AS low_cov, strand_flips FROM rs JOIN tot USING (pgs_id)")
def ag22(v):
    return P.score_from_reads(v.read, v.score).select("sample_id", "pgs_id", "matched", "missing", "low_cov", "strand_flips")


@check("pl9_score_from_reads", f"WITH {READ_SCORE_SQL} SELECT sample_id, pgs_id, score_sum, matched, CASE WHEN matched > 0 THEN score_sum / (2 * matched) END AS raw_score FROM rs")
def pl9(v):
    return P.score_from_reads(v.read, v.score).select("sample_id", "pgs_id", "score_sum", "matched", "raw_score")


@check("pl25_target_site_genotypes", f"""WITH {MAP_SQL}, {SITE_SQL}, {VERDICT_SQL}, tg AS (SELECT v.chrom, v.pos, v.ref, coalesce((SELECT min(t.x) FROM unnest(string_split(alleles, ',')) t(x) WHERE t.x <> v.ref), 'N') AS alt FROM v_variant v JOIN amap USING (chrom, pos)),
   k AS (SELECT sample_id, o.chrom, o.pos, tg.ref, tg.alt, count(*) AS depth, count(*) FILTER (base = tg.ref) AS rn, count(*) FILTER (base = tg.alt) AS an, count(*) FILTER (base = translate(tg.ref, 'ACGT', 'TGCA')) AS rc, count(*) FILTER (base = translate(tg.alt, 'ACGT', 'TGCA')) AS ac
     FROM obs o JOIN tg ON tg.chrom = o.chrom AND tg.pos = o.pos WHERE length(tg.ref) = 1 GROUP BY ALL),
   m AS (SELECT *, CASE WHEN rn = 0 AND an = 0 AND (rc > 0 OR ac > 0) THEN ac ELSE an END AS n FROM k)
   SELECT sample_id, chrom, pos, ref, alt, depth, CASE WHEN depth < 8 THEN './.' WHEN n / depth::DOUBLE < 0.15 THEN '0/0' WHEN n / depth::DOUBLE > 0.85 THEN '1/1' ELSE '0/1' END AS genotype FROM m
   UNION ALL SELECT i.sample_id, i.chrom, i.pos, i.ref, tg.alt, depth, {GT.format(d='dosage')} FROM ind i JOIN tg ON tg.chrom = i.chrom AND tg.pos = i.pos WHERE length(tg.ref) > 1""")
def pl25_every(v):
    targets = A.fill_missing_alt(v.variant.select("chrom", "pos", "ref"), A.allele_map(v.score))
    return P.genotype_sites(v.read, targets).select("sample_id", "chrom", "pos", "ref", "alt", "depth", "genotype")


PL10_SQL = f"""WITH {CALL_SQL}, {VERDICT_SQL}, allc AS (SELECT sample_id, chrom, pos, ref, alt, dosage, depth FROM snvs UNION ALL SELECT sample_id, chrom, pos, ref, alt, dosage, depth FROM ind),
   tv AS (SELECT variant_id // 5 AS test_no, CASE WHEN variant_id % 25 = 13 OR variant_id // 5 % 9 = 4 THEN NULL ELSE rsid END AS rsid, gene, chrom, CASE WHEN variant_id % 10 = 7 OR variant_id // 5 % 9 = 5 THEN NULL ELSE pos END AS pos, ref, alt,
     CASE WHEN variant_id % 2 = 0 THEN concat('*', variant_id % 7 + 1) END AS star FROM v_variant),
   req AS (SELECT DISTINCT sample_id, variant_id // 5 AS test_no FROM allc JOIN v_variant USING (chrom, pos)),
   ans AS (SELECT r.sample_id, r.test_no, tv.*  EXCLUDE (test_no), dosage, depth, CASE WHEN rsid IS NULL THEN 'cnv_only' WHEN tv.pos IS NULL THEN 'none' ELSE 'pileup' END AS src
     FROM req r JOIN tv USING (test_no) LEFT JOIN allc a ON a.sample_id = r.sample_id AND a.chrom = tv.chrom AND a.pos = tv.pos AND a.ref = tv.ref AND a.alt = tv.alt AND tv.rsid IS NOT NULL),
   roll AS (SELECT sample_id, test_no, count(*) AS n_variants, count(*) FILTER (src = 'pileup') AS n_resolved, count(*) FILTER (src = 'pileup' AND dosage > 0) AS n_alt, count(*) FILTER (src = 'cnv_only') AS n_cnv,
     count(*) FILTER (src = 'pileup' AND coalesce(depth, 0) < 8) AS n_low_coverage, min(gene) FILTER (src = 'cnv_only') AS cnv_gene,
     list(concat(gene, '=', {GT.format(d='dosage')}) ORDER BY gene, rsid) FILTER (src = 'pileup' AND dosage > 0) AS calls FROM ans GROUP BY 1, 2),
   cl AS (SELECT sample_id, test_no, gene, string_agg(DISTINCT star, ', ' ORDER BY star) AS stars FROM ans WHERE dosage = 2 AND star IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT star) > 1 QUALIFY row_number() OVER (PARTITION BY sample_id, test_no ORDER BY gene) = 1)
   SELECT sample_id, test_no, n_variants, n_resolved, n_alt, n_low_coverage,
     CASE WHEN cl.gene IS NOT NULL THEN 'warning' WHEN n_resolved = 0 AND n_cnv = 0 THEN 'failed' WHEN n_resolved = 0 THEN 'warning' ELSE 'passed' END AS status,
     CASE WHEN cl.gene IS NOT NULL THEN concat(cl.gene, ': impossible call detected (hom for ', stars, ')') WHEN n_resolved = 0 AND n_cnv = 0 THEN concat('No data: ', n_variants, ' variant(s) unresolvable')
       WHEN n_resolved = 0 THEN concat(cnv_gene, ': requires specialized assay') WHEN n_alt = 0 THEN 'All ref/ref (no alt calls)' ELSE concat(n_alt, '/', n_resolved, ' alt calls: ', array_to_string(calls[1:3], ', ')) END AS headline
   FROM roll LEFT JOIN cl USING (sample_id, test_no)"""


@check("pl10_lookup_from_reads", PL10_SQL)
def pl10_reads(v):
    """Five-variant tests of the samples with reads at one of their sites."""
    k = F.col("variant_id")
    test = G.whole(k, 5)
    variants = v.variant.select(
        test.alias("test_no"), F.when((k % 25 == 13) | (test % 9 == 4), None).otherwise(F.col("rsid")).alias("rsid"), "gene", "chrom",
        F.when((k % 10 == 7) | (test % 9 == 5), None).otherwise(F.col("pos")).alias("pos"), "ref", "alt", F.when(k % 2 == 0, F.concat(F.lit("*"), (k % 7 + 1).cast("string"))).alias("star_allele"),
    )
    calls = P.genotype_sites(v.read, v.variant.select("chrom", "pos", "ref", "alt"), reference_bases(v))
    requests = calls.join(never_broadcast(v.variant.select("chrom", "pos", test.alias("test_no"))), ["chrom", "pos"]).select("sample_id", "test_no").distinct()
    return L.reads_rollup(L.lookup_from_reads(requests.join(never_broadcast(variants), "test_no"), v.read, reference_bases(v)), ["sample_id", "test_no"])
