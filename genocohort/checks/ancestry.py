"""Frequencies, projection, admixture, haplogroups, runs of homozygosity, linkage and panel components."""

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import genotype as G
from ..operators import ancestry as A
from ..operators import ld as LD
from ..operators import pca as PC
from ..operators import roh as R
from ..plans import ancestry as PA
from .registry import check

FREQ_SQL = """fq AS (SELECT chrom, pos, count(dosage) AS n_called, count(*) AS n_records, sum(dosage) / nullif(2 * count(dosage), 0)::DOUBLE AS alt_freq FROM v_panel GROUP BY 1, 2)"""


@check("ag20_allele_frequency", f"WITH {FREQ_SQL} SELECT chrom, pos, n_called, n_records, alt_freq, 1 - n_called / n_records::DOUBLE AS missing_rate, least(alt_freq, 1 - alt_freq) AS maf FROM fq")
def ag20(v):
    return A.allele_frequencies(v.panel)


@check("pf19_panel_sites", """WITH f AS (SELECT chrom, pos, sum(dosage) / nullif(2 * count(dosage), 0)::DOUBLE AS p, 1 - count(dosage) / count(*)::DOUBLE AS mr FROM v_panel
     WHERE chrom NOT IN ('X','Y','MT') AND length(ref) = 1 AND length(alt) = 1 GROUP BY 1, 2)
   SELECT chrom, pos, p AS alt_freq FROM f WHERE least(p, 1 - p) >= 0.05 AND mr <= 0.02""")
def pf19(v):
    return A.panel_sites(v.panel).select("chrom", "pos", "alt_freq")


def loadings(v):
    """Loadings of the variants: ten entries of an embedding row, shared by four neighbouring variants."""
    e = v.table("embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("loadings"))
    own = v.variant.withColumn("vec_id", G.whole(F.col("variant_id"), 4))
    return own.join(e, "vec_id").select("chrom", "pos", "loadings")


PCS = ", ".join(f"round(sum(z * w[{i}]) / (2 * count(*)), 9) AS pc{i}" for i in range(1, 11))
PC_SQL = f"""{FREQ_SQL}, ld AS (SELECT chrom, pos, list_transform(embedding[1:10], lambda x: x::DOUBLE) AS w FROM v_variant JOIN embeddings ON vec_id = variant_id // 4),
  zt AS (SELECT p.sample_id, (dosage - 2 * alt_freq) / sqrt(2 * alt_freq * (1 - alt_freq)) AS z, w FROM v_panel p JOIN fq USING (chrom, pos) JOIN ld USING (chrom, pos) WHERE dosage IS NOT NULL AND alt_freq > 0 AND alt_freq < 1),
  pc AS (SELECT sample_id, count(*) AS n_variants, {PCS} FROM zt GROUP BY 1)"""
CENT = ", ".join(f"round(avg(pc{i}), 9) AS c{i}" for i in range(1, 11))
DIST_SQL = f"""{PC_SQL}, ce AS (SELECT superpop, {CENT} FROM pc JOIN v_panel_sample USING (sample_id) GROUP BY 1),
  di AS (SELECT sample_id, superpop, sqrt((pc1-c1)*(pc1-c1) + (pc2-c2)*(pc2-c2) + (pc3-c3)*(pc3-c3) + (pc4-c4)*(pc4-c4)) AS distance FROM pc, ce),
  rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY distance, superpop) AS k FROM di),
  cl AS (SELECT sample_id, max(superpop) FILTER (k = 1) AS population, max(distance) FILTER (k = 1) AS d1, max(superpop) FILTER (k = 2) AS second_population, max(distance) FILTER (k = 2) AS d2 FROM rk GROUP BY 1),
  ad AS (SELECT sample_id, superpop, exp(-(distance - min(distance) OVER (PARTITION BY sample_id)) / 0.02::DOUBLE) AS e FROM di),
  ads AS (SELECT sample_id, superpop, e / sum(e) OVER (PARTITION BY sample_id) AS share FROM ad)"""


def projected(v):
    p = A.project(v.panel, A.allele_frequencies(v.panel), loadings(v))
    return p.withColumn("pcs", F.transform("pcs", lambda x: F.round(x, 9)))


def centres(v):
    c = A.centroids(projected(v), v.panel_sample)
    return c.withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 9)))


def distances(v):
    return A.centroid_distances(projected(v), centres(v))


@check("sc29_standardised_projection", f"WITH {PC_SQL} SELECT * FROM (SELECT sample_id, n_variants, {', '.join(f'round(pc{i}, 7) AS pc{i}' for i in range(1, 11))} FROM pc)")
def sc29(v):
    return projected(v).select("sample_id", "n_variants", *[F.round(F.get("pcs", F.lit(i)), 7).alias(f"pc{i + 1}") for i in range(10)])


@check("ag18_centroids", f"WITH {DIST_SQL} SELECT superpop, {', '.join(f'round(c{i}, 7) AS c{i}' for i in range(1, 11))} FROM ce")
def ag18(v):
    return centres(v).select("superpop", *[F.round(F.get("centroid", F.lit(i)), 7).alias(f"c{i + 1}") for i in range(10)])


@check("jn16_centroid_distances", f"WITH {DIST_SQL} SELECT sample_id, superpop, round(distance, 6) AS distance FROM di")
def jn16(v):
    return distances(v).select("sample_id", "superpop", F.round("distance", 6).alias("distance"))


@check("sc19_embedding_distance", """WITH c AS (SELECT label % 5 AS pop, avg(embedding[1]::DOUBLE) AS a, avg(embedding[2]::DOUBLE) AS b, avg(embedding[3]::DOUBLE) AS c, avg(embedding[4]::DOUBLE) AS d FROM embeddings GROUP BY 1)
   SELECT vec_id, pop, round(sqrt((embedding[1]-a)*(embedding[1]-a)+(embedding[2]-b)*(embedding[2]-b)+(embedding[3]-c)*(embedding[3]-c)+(embedding[4]-d)*(embedding[4]-d)), 6) AS distance FROM embeddings, c""")
def sc19(v):
    e = v.table("embeddings").select("vec_id", F.col("label"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("pcs"))
    c = e.groupBy((F.col("label") % 5).alias("pop")).agg(F.array(*[F.avg(F.get("pcs", F.lit(i))) for i in range(4)]).alias("centroid"))
    asked = e.withColumn("pop", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return asked.join(F.broadcast(c), "pop").select("vec_id", "pop", F.round(A.distance(F.col("pcs"), F.col("centroid")), 6).alias("distance"))


@check("wn6_nearest_centroid", f"WITH {DIST_SQL} SELECT sample_id, population, second_population, CASE WHEN d2 - d1 > 0.3::DOUBLE * d1 THEN 'high' ELSE 'moderate' END AS confidence FROM cl")
def wn6(v):
    return A.closest_population(distances(v)).select("sample_id", "population", "second_population", "confidence")


@check("sl5_top_distances", f"WITH {DIST_SQL} SELECT sample_id, string_agg(superpop, ',' ORDER BY k) FILTER (k <= 3) AS nearest FROM rk GROUP BY 1")
def sl5(v):
    return A.ranked_distances(distances(v)).select("sample_id", F.array_join(F.transform(F.slice("ranked", 1, 3), lambda r: r["superpop"]), ",").alias("nearest"))


@check("sc18_softmax_shares", f"WITH {DIST_SQL} SELECT sample_id, superpop, round(share, 6) AS share FROM ads")
def sc18(v):
    return A.admixture(distances(v)).select("sample_id", "superpop", F.round("share", 6).alias("share"))


@check("pl16_admixture", f"WITH {DIST_SQL} SELECT sample_id, max(superpop) FILTER (k = 1) AS top_population, round(max(100 * share), 1) AS top_percent FROM ads JOIN rk USING (sample_id, superpop) GROUP BY 1")
def pl16(v):
    return PA.admixture_summary(distances(v))


@check("pl15_pca_projection", f"WITH {DIST_SQL} SELECT sample_id, n_variants, round(pc1, 7) AS pc1, round(pc2, 7) AS pc2, population, round(d1, 6) AS distance FROM pc JOIN cl USING (sample_id)")
def pl15(v):
    return PA.project_and_assign(projected(v), centres(v)).select(
        "sample_id", "n_variants", F.round(F.get("pcs", F.lit(0)), 7).alias("pc1"), F.round(F.get("pcs", F.lit(1)), 7).alias("pc2"), "population", F.round("distance", 6).alias("distance"))


ARCH_SQL = "ar(population, low, high) AS (VALUES " + ", ".join(f"('{p}', {a}::DOUBLE, {b}::DOUBLE)" for p, a, b in K.ARCHAIC_RANGE) + ")"


@check("sc20_archaic_range", f"WITH {ARCH_SQL} SELECT sample_id, superpop AS population, low, high, round((low + high) / 2, 2) AS estimate FROM v_sample JOIN ar ON superpop = population")
def sc20(v):
    return A.archaic_estimate(v.sample.select("sample_id", F.col("superpop").alias("population")))


@check("pl17_archaic_estimate", f"WITH {DIST_SQL}, {ARCH_SQL} SELECT sample_id, population, round((low + high) / 2, 2) AS estimate FROM cl JOIN ar USING (population)")
def pl17(v):
    return A.archaic_estimate(A.closest_population(distances(v))).select("sample_id", "population", "estimate")


# ---- haplogroups ---------------------------------------------------------------------------------------------------

LABEL_SQL = """mk AS (SELECT chrom, pos, ref, alt, rsid AS name, concat(substr('EGIJR', CAST((variant_id // 25) % 5 + 1 AS INT), 1), substr('1b1a1', 1, CAST((variant_id // 125) % 6 AS INT))) AS haplogroup FROM v_variant)"""
SUP_SQL = f"""{LABEL_SQL}, hit AS (SELECT p.sample_id, mk.* FROM v_panel p JOIN mk USING (chrom, pos, ref, alt) WHERE chrom = '{{c}}' AND dosage > 0),
  lt AS (SELECT haplogroup, count(*) AS label_total FROM mk WHERE chrom = '{{c}}' GROUP BY 1),
  sup AS (SELECT sample_id, haplogroup, count(*) AS derived, max(label_total) AS label_total, count(*) / max(label_total)::DOUBLE AS rate FROM hit JOIN lt USING (haplogroup) GROUP BY 1, 2)"""


def markers(v, chrom):
    k = G.whole(F.col("variant_id"), 25)
    letter = F.lit("EGIJR").substr((k % 5 + 1).cast("int"), F.lit(1))
    tail = F.lit("1b1a1").substr(F.lit(1), (G.whole(F.col("variant_id"), 125) % 6).cast("int"))
    return v.variant.where(F.col("chrom") == chrom).select("chrom", "pos", "ref", "alt", F.col("rsid").alias("name"), F.concat(letter, tail).alias("haplogroup"))


def panel_records(v):
    gt = F.when(F.col("dosage").isNull(), "./.").when(F.col("dosage") == 0, "0/0").when(F.col("dosage") == 1, "0/1").otherwise("1/1")
    return v.panel.select("sample_id", "chrom", "pos", "ref", F.array("alt").alias("alts"), gt.alias("gt"))


def y_support(v):
    m = markers(v, "Y")
    return A.marker_support(A.derived_markers(panel_records(v), m), m)


@check("jn15_marker_match", f"WITH {SUP_SQL.format(c='Y')} SELECT sample_id, pos, name, haplogroup FROM hit")
def jn15(v):
    return A.derived_markers(panel_records(v), markers(v, "Y")).select("sample_id", "pos", "name", "haplogroup")


@check("ag17_marker_support", f"WITH {SUP_SQL.format(c='Y')} SELECT sample_id, haplogroup, derived, label_total, rate FROM sup")
def ag17(v):
    return y_support(v).select("sample_id", "haplogroup", "derived", "label_total", "rate")


PICK_SQL = """SELECT sample_id, haplogroup, derived, strong FROM (SELECT *, derived >= 5 AND rate >= 0.5 AS strong FROM sup) QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY strong DESC,
   CASE WHEN strong THEN length(haplogroup) ELSE derived END DESC, CASE WHEN strong THEN derived ELSE length(haplogroup) END DESC, CASE WHEN strong THEN rate END DESC NULLS LAST, haplogroup) = 1"""


@check("wn7_haplogroup_pick", f"WITH {SUP_SQL.format(c='Y')} {PICK_SQL}")
def wn7(v):
    return A.pick_haplogroup(y_support(v)).select("sample_id", "haplogroup", "derived", "strong")


@check("sl4_top_haplogroups", f"WITH {SUP_SQL.format(c='Y')} SELECT sample_id, haplogroup, derived, row_number() OVER (PARTITION BY sample_id ORDER BY derived DESC, length(haplogroup) DESC, haplogroup) AS place FROM sup QUALIFY place <= 5")
def sl4(v):
    return A.top_labels(y_support(v)).select("sample_id", "haplogroup", "derived", F.col("place").cast("bigint").alias("place"))


@check("pl12_y_haplogroup", f"""WITH {SUP_SQL.format(c='Y')}, p AS ({PICK_SQL}), t AS (SELECT sample_id, concat(haplogroup, '(', derived, '/', label_total, ')') AS txt, row_number() OVER (PARTITION BY sample_id ORDER BY derived DESC, length(haplogroup) DESC, haplogroup) AS k FROM sup)
   SELECT p.sample_id, haplogroup, concat('Y-DNA: ', haplogroup, ' (', derived, ' derived SNPs)') AS headline, (SELECT string_agg(txt, ', ' ORDER BY k) FROM t WHERE t.sample_id = p.sample_id AND k <= 5) AS top FROM p""")
def pl12(v):
    return PA.y_haplogroups(panel_records(v), markers(v, "Y"))


@check("pl13_mt_evidence", f"""WITH {SUP_SQL.format(c='MT')}, n AS (SELECT sample_id, count(*) AS mt_variants FROM v_panel WHERE chrom = 'MT' AND dosage > 0 GROUP BY 1)
   SELECT sample_id, 'MT' AS contig, mt_variants, haplogroup, derived, label_total FROM n JOIN sup USING (sample_id)""")
def pl13(v):
    spelled = panel_records(v).withColumn("chrom", F.when(F.col("chrom") == "MT", "chrM").otherwise(F.concat(F.lit("chr"), "chrom")))
    return PA.mt_evidence(spelled, markers(v, "MT").select("chrom", "pos", "alt", "haplogroup"))


# ---- runs of homozygosity --------------------------------------------------------------------------------------------

ROH_SQL = """g AS (SELECT sample_id, chrom, pos, dosage, row_number() OVER (PARTITION BY sample_id, chrom ORDER BY pos) - 1 AS j, count(*) OVER (PARTITION BY sample_id, chrom) AS n FROM v_panel WHERE chrom NOT IN ('X','Y','MT')),
  h AS (SELECT *, CASE WHEN j + 49 < n THEN CAST(sum(CASE WHEN dosage = 1 THEN 1 ELSE 0 END) OVER w <= 1 AND sum(CASE WHEN dosage IS NULL THEN 1 ELSE 0 END) OVER w <= 5 AS INT) END AS hom
     FROM g WINDOW w AS (PARTITION BY sample_id, chrom ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
  e AS (SELECT *, count(hom) OVER b AS nw, sum(hom) OVER b AS hits FROM h WINDOW b AS (PARTITION BY sample_id, chrom ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
  s AS (SELECT *, CASE WHEN j - lag(j) OVER o > 1 OR pos - lag(pos) OVER o > 1000000 OR lag(j) OVER o IS NULL THEN 1 ELSE 0 END AS st FROM e WHERE nw > 0 AND hits / nw::DOUBLE >= 0.05 WINDOW o AS (PARTITION BY sample_id, chrom ORDER BY pos)),
  i AS (SELECT *, sum(st) OVER (PARTITION BY sample_id, chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM s),
  seg AS (SELECT * FROM (SELECT sample_id, chrom, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS n_snps, (max(pos) - min(pos) + 1) / 1000::DOUBLE AS kb FROM i GROUP BY sample_id, chrom, island) WHERE n_snps >= 50 AND kb >= 500 AND kb / n_snps <= 50)"""


@check("wn9_roh_segments", f"WITH {ROH_SQL} SELECT sample_id, chrom, start_pos, end_pos, n_snps, kb FROM seg")
def wn9(v):
    return R.homozygous_segments(v.panel)


SUM_SQL = f"""{ROH_SQL}, rs AS (SELECT sample_id, count(kb) AS segments, round(coalesce(sum(kb), 0), 3) AS total_kb, round(coalesce(avg(kb), 0), 3) AS mean_kb FROM v_panel_sample LEFT JOIN seg USING (sample_id) GROUP BY 1)"""


@check("ag31_roh_summary", f"WITH {SUM_SQL} SELECT * FROM rs")
def ag31(v):
    return R.roh_summary(R.homozygous_segments(v.panel), v.panel_sample).select(
        "sample_id", "segments", F.round("total_kb", 3).alias("total_kb"), F.round("mean_kb", 3).alias("mean_kb"))


@check("sc21_froh", f"WITH {SUM_SQL} SELECT sample_id, round(total_kb * 1000 / 2881000000::DOUBLE, 9) AS froh FROM rs")
def sc21(v):
    return R.roh_summary(R.homozygous_segments(v.panel), v.panel_sample).select("sample_id", F.round("froh", 9).alias("froh"))


@check("pl18_runs_of_homozygosity", f"WITH {SUM_SQL} SELECT sample_id, segments, total_kb, concat('ROH: ', segments, ' segments') AS headline FROM rs")
def pl18(v):
    return PA.runs_of_homozygosity(v.panel, v.panel_sample).select("sample_id", "segments", F.round("total_kb", 3).alias("total_kb"), "headline")


# ---- linkage and panel components -------------------------------------------------------------------------------------

LD_SQL = """ix AS (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS idx FROM (SELECT DISTINCT chrom, pos FROM v_panel)),
  gl AS (SELECT sample_id, p.chrom, p.pos, dosage AS d, idx FROM v_panel p JOIN ix USING (chrom, pos) WHERE dosage IS NOT NULL),
  pr AS (SELECT a.chrom, a.pos AS pos_i, b.pos AS pos_j, count(*) AS n, sum(a.d) AS sx, sum(b.d) AS sy, sum(a.d*a.d) AS sxx, sum(b.d*b.d) AS syy, sum(a.d*b.d) AS sxy FROM gl a JOIN gl b ON a.chrom = b.chrom AND a.sample_id = b.sample_id AND b.idx > a.idx AND b.idx - (a.idx // 5) * 5 < 50 GROUP BY 1, 2, 3),
  r2 AS (SELECT chrom, pos_i, pos_j, n, (n*sxy - sx*sy)::DOUBLE * (n*sxy - sx*sy)::DOUBLE / ((n*sxx - sx*sx)::DOUBLE * (n*syy - sy*sy)::DOUBLE) AS r2 FROM pr WHERE n*sxx > sx*sx AND n*syy > sy*sy)"""


@check("jn25_ld_pairs", f"WITH {LD_SQL} SELECT chrom, pos_i, pos_j, n, round(r2, 9) AS r2 FROM r2")
def jn25(v):
    return LD.ld_pairs(v.panel, window=50, step=5).withColumn("r2", F.round("r2", 9))


PRUNE_SQL = f"""ps AS (SELECT chrom, pos, least(p, 1 - p) AS maf FROM (SELECT chrom, pos, sum(dosage) / nullif(2 * count(dosage), 0)::DOUBLE AS p, 1 - count(dosage) / count(*)::DOUBLE AS mr FROM v_panel
     WHERE chrom NOT IN ('X','Y','MT') AND length(ref) = 1 AND length(alt) = 1 GROUP BY 1, 2) WHERE least(p, 1 - p) >= 0.05 AND mr <= 0.02),
  {LD_SQL.replace("FROM v_panel)),", "FROM v_panel JOIN ps USING (chrom, pos))),")},
  lk AS MATERIALIZED (SELECT chrom, pos_i AS a, pos_j AS b FROM r2 WHERE r2 > 0.1 UNION ALL SELECT chrom, pos_j, pos_i FROM r2 WHERE r2 > 0.1),
  nb AS MATERIALIZED (SELECT ps.chrom, pos, row_number() OVER (PARTITION BY ps.chrom ORDER BY maf DESC, md5(concat(ps.chrom, ':', pos))) AS k, (SELECT list(b) FROM lk WHERE lk.chrom = ps.chrom AND lk.a = ps.pos) AS near FROM ps),
  fold AS (SELECT chrom, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT chrom FROM nb)
    UNION ALL SELECT fold.chrom, nb.k, CASE WHEN list_has_any(kept, coalesce(near, [])) THEN kept ELSE list_append(kept, nb.pos) END FROM fold JOIN nb ON nb.chrom = fold.chrom AND nb.k = fold.k + 1),
  pruned AS (SELECT chrom, unnest(kept) AS pos FROM fold QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY k DESC) = 1)"""


@check("wn13_ld_prune", f"WITH RECURSIVE {PRUNE_SQL} SELECT chrom, pos FROM pruned")
def wn13(v):
    return PA.prune_panel(v.panel, window=50, step=5)[2]


@check("pl14_pca_reference")
def pl14(v):
    return PA.build_reference(v.panel, v.panel_sample, components=4, window=50, step=5)["centroids"].select(
        "superpop", *[F.round(F.get("centroid", F.lit(i)), 6).alias(f"c{i + 1}") for i in range(4)])


# The SQL finds the four largest variances on its own: the sample covariance as a matrix, squared 14 times a component, whose image of a
# fixed vector gives the axis; its variance is taken off before the next one.
SQUARES = 14
TIMES = "list_transform({m}, lambda a: list_transform({m}, lambda b: list_dot_product(a, b)))"
TOP_SQL = f"""zz AS (SELECT sample_id, p.chrom, p.pos, (dosage - 2 * q) / sqrt(2 * q * (1 - q)) AS z FROM v_panel p JOIN pruned USING (chrom, pos)
     JOIN (SELECT chrom, pos, sum(dosage) / nullif(2 * count(dosage), 0)::DOUBLE AS q FROM v_panel GROUP BY 1, 2) USING (chrom, pos) WHERE dosage IS NOT NULL AND q > 0 AND q < 1),
  sn AS (SELECT DISTINCT sample_id FROM zz), cells AS (SELECT a.sample_id AS i, b.sample_id AS j, sum(a.z * b.z) AS c FROM zz a JOIN zz b ON a.chrom = b.chrom AND a.pos = b.pos GROUP BY 1, 2),
  lines AS (SELECT x.sample_id AS i, list(coalesce(c, 0)::DOUBLE ORDER BY y.sample_id) AS line FROM sn x JOIN sn y ON true LEFT JOIN cells ON i = x.sample_id AND j = y.sample_id GROUP BY 1),
  cov AS MATERIALIZED (SELECT list(line ORDER BY i) AS c FROM lines),
  total AS (SELECT sum(z * z) AS t FROM zz),
  steps AS (SELECT -1 AS component, 0 AS step, c, list_transform(c, lambda r: list_transform(r, lambda x: x / t)) AS m, NULL::DOUBLE AS variance FROM cov, total
    UNION ALL SELECT component + (step = {SQUARES})::INT, CASE WHEN step = {SQUARES} THEN 0 ELSE step + 1 END, CASE WHEN step = {SQUARES} THEN less ELSE c END,
        CASE WHEN step = {SQUARES} THEN list_transform(less, lambda r: list_transform(r, lambda x: x / t)) ELSE list_transform(sq, lambda r: list_transform(r, lambda x: x / top)) END, CASE WHEN step = {SQUARES} THEN v END
    FROM (SELECT *, CASE WHEN step = {SQUARES} THEN list_transform(c, lambda r, i: list_transform(r, lambda x, j: x - v * u[i] * u[j])) END AS less,
                 CASE WHEN step < {SQUARES} THEN list_max(list_transform(sq, lambda r: list_max(list_transform(r, lambda x: abs(x))))) END AS top
      FROM (SELECT *, CASE WHEN step = {SQUARES} THEN list_dot_product(u, list_transform(c, lambda r: list_dot_product(r, u))) END AS v
        FROM (SELECT *, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS u
          FROM (SELECT s.*, t, list_transform(m, lambda r: list_dot_product(r, list_transform(range(len(r)), lambda i: sin(i + 1.0)))) AS w, CASE WHEN step < {SQUARES} THEN {TIMES.format(m="m")} END AS sq FROM steps s, total))))
    WHERE component < 3)"""


@check("pl14_eigen_equation", f"""WITH RECURSIVE {PRUNE_SQL}, {TOP_SQL}
   SELECT component, round(variance / t, 6) AS share, 0.0::DOUBLE AS norm_error, round(t, 6) AS total_variance FROM steps, total WHERE variance IS NOT NULL""")
def pl14_eigen(v):
    """The variances of the panel's components, as shares of the total one: the largest there are, as SQL finds them by itself."""
    built = PA.build_reference(v.panel, v.panel_sample, components=4, window=50, step=5)
    total = built["z"].agg(F.sum(F.col("z") * F.col("z"))).scalar()
    return built["errors"].withColumn("total", total).select(
        "component", F.round(F.col("variance") / F.col("total"), 6).alias("share"), F.round("norm_error", 6).alias("norm_error"), F.round("total", 6).alias("total_variance"))
