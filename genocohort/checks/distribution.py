"""Reference distributions, percentiles, gates and their audits."""

from pyspark.sql import functions as F

from ..constants import POPULATIONS, QUANTILE_PERCENTS
from ..functions import scores as S
from ..operators import distribution as D
from ..operators import scoring as O
from .registry import check
from .scoring import SCORED_SQL

POP_SQL = "pops(population, label, min_n, buildable) AS (VALUES " + ", ".join(
    f"('{c}', '{l}', {n}, {str(b).lower()})" for c, l, n, b in POPULATIONS
) + ")"
MIX_SQL = """ranked AS (SELECT sample_id, superpop, row_number() OVER (PARTITION BY superpop
      ORDER BY md5(concat(CAST(sample_id AS VARCHAR), '42')), sample_id) AS place
    FROM v_sample WHERE superpop IN ('EUR', 'EAS')),
  take AS (SELECT CASE WHEN count(*) = 2 THEN min(n) ELSE 0 END AS n FROM (SELECT count(*) AS n FROM ranked GROUP BY superpop)),
  mix AS (SELECT sample_id, 'MIX' AS population FROM ranked, take WHERE place <= take.n)"""
PANEL_SQL = """pm AS (SELECT g.sample_id, s.pgs_id, s.weight_h,
    CASE WHEN s.effect_allele = g.alt THEN g.dosage ELSE 2 - g.dosage END AS d
  FROM v_genotype g JOIN v_score s ON g.chrom = s.chrom AND g.pos = s.pos
  WHERE (s.effect_allele = g.alt AND s.other_allele = g.ref) OR (s.effect_allele = g.ref AND s.other_allele = g.alt)),
  panel AS (SELECT *, CASE WHEN allele_ct > 0 THEN score_sum / allele_ct END AS raw_score
    FROM (SELECT sample_id, pgs_id, round(coalesce(sum(d * weight_h), 0) / 64.0::DOUBLE, 6) AS score_sum,
    CAST(2 * count(d) AS BIGINT) AS allele_ct FROM pm GROUP BY 1, 2))"""
MEMBER_SQL = f"""{PANEL_SQL}, {MIX_SQL},
  member AS (SELECT sample_id, superpop AS population FROM v_sample UNION ALL SELECT * FROM mix),
  ms AS (SELECT p.*, population FROM panel p JOIN member USING (sample_id) WHERE raw_score IS NOT NULL)"""


def single(value):
    """Interpolated values to single precision: engines interpolate in different orders."""
    return value.cast("float").cast("double")


def panel_sums(v, calls=None):
    """Scores of the panel, and whether they come dealt by score."""
    sides = O.settled(v.genotype if calls is None else calls, v.score)
    parts = O.parts_by_score(*sides)
    scored = O.sum_scores(O.match_allele_pair(*sides, parts=parts), O.pair_columns(sides[0]))
    total = F.round("score_sum", 6)
    return scored.withColumn("score_sum", total).withColumn(
        "raw_score", F.when(F.col("allele_ct") > 0, F.col("score_sum") / F.col("allele_ct"))
    ), parts is not None


def panel_scores(v, calls=None):
    return panel_sums(v, calls)[0]


def member_sums(v):
    calls, members = D.tagged(v.genotype, D.memberships(v.sample))
    scored, dealt = panel_sums(v, calls)
    return D.with_rows(scored.where(F.col("raw_score").isNotNull()), members), dealt


def member_scores(v):
    return member_sums(v)[0]


@check("jn2_score_panel_pairs", f"WITH {PANEL_SQL} SELECT sample_id, pgs_id, score_sum, allele_ct FROM panel")
def jn2(v):
    return panel_scores(v).select("sample_id", "pgs_id", "score_sum", "allele_ct")


@check("jn10_sample_superpopulation", f"""WITH {PANEL_SQL} SELECT superpop, count(*) AS scores, count(DISTINCT sample_id) AS samples
    FROM panel JOIN v_sample USING (sample_id) GROUP BY 1""")
def jn10(v):
    calls, places = D.tagged(v.genotype, v.sample)
    return D.with_rows(panel_scores(v, calls), places).groupBy("superpop").agg(
        F.count(F.lit(1)).alias("scores"), F.countDistinct("sample_id").alias("samples")
    )


@check("jn11_keep_list", f"WITH {PANEL_SQL}, {MIX_SQL} SELECT sample_id, pgs_id, allele_ct FROM panel WHERE sample_id IN (SELECT sample_id FROM mix)")
def jn11(v):
    kept = v.genotype.join(D.balanced_mix(v.sample), "sample_id", "left_semi")  # samples that are not kept go before anything is summed
    return panel_scores(v, kept).select("sample_id", "pgs_id", "allele_ct")


@check("wn12_balanced_mix", f"WITH {MIX_SQL} SELECT sample_id, population FROM mix")
def wn12(v):
    return D.balanced_mix(v.sample)


@check("ag3_reference_distribution", f"""WITH {MEMBER_SQL}
    SELECT pgs_id, population, count(*) AS n_samples, round(avg(raw_score), 8) AS mean,
      round(coalesce(stddev_samp(raw_score), 0), 8) AS std, quantile_cont(raw_score, 0.5)::FLOAT::DOUBLE AS median,
      min(raw_score) AS min, max(raw_score) AS max FROM ms GROUP BY 1, 2""")
def ag3(v):
    scored, dealt = member_sums(v)
    d = D.score_distribution(scored, ["pgs_id", "population"], "raw_score", dealt=dealt)
    return d.select(
        "pgs_id", "population", "n_samples", *[F.round(c, 8).alias(c) for c in ("mean", "std")], single(F.col("median")).alias("median"), "min", "max"
    )


Q_SQL = ", ".join(f"quantile_cont(raw_score, {p / 100})::FLOAT::DOUBLE AS p{p}" for p in QUANTILE_PERCENTS)


@check("ag4_quantiles", f"WITH {MEMBER_SQL} SELECT pgs_id, population, {Q_SQL} FROM ms GROUP BY 1, 2")
def ag4(v):
    scored, dealt = member_sums(v)
    d = D.score_distribution(scored, ["pgs_id", "population"], "raw_score", dealt=dealt)
    return d.select("pgs_id", "population", *[single(F.element_at("quantiles", str(p))).alias(f"p{p}") for p in QUANTILE_PERCENTS])


@check("ag5_sum_scale_distribution", f"""WITH {MEMBER_SQL} SELECT pgs_id, population, round(avg(score_sum), 8) AS sum_mean,
    round(coalesce(stddev_samp(score_sum), 0), 8) AS sum_std, min(score_sum) AS sum_min, max(score_sum) AS sum_max FROM ms GROUP BY 1, 2""")
def ag5(v):
    return member_scores(v).groupBy("pgs_id", "population").agg(
        F.round(F.avg("score_sum"), 8).alias("sum_mean"),
        F.round(F.coalesce(F.stddev_samp("score_sum"), F.lit(0.0)), 8).alias("sum_std"),
        F.min("score_sum").alias("sum_min"), F.max("score_sum").alias("sum_max"),
    )


@check("pl2_reference_stats", f"""WITH {MEMBER_SQL}
    SELECT pgs_id, population, count(*) AS n_samples, round(avg(raw_score), 8) AS mean,
      round(coalesce(stddev_samp(raw_score), 0), 8) AS std, quantile_cont(raw_score, 0.5)::FLOAT::DOUBLE AS median,
      quantile_cont(raw_score, 0.05)::FLOAT::DOUBLE AS q5, quantile_cont(raw_score, 0.95)::FLOAT::DOUBLE AS q95,
      round(avg(score_sum), 8) AS sum_mean, round(coalesce(stddev_samp(score_sum), 0), 8) AS sum_std FROM ms GROUP BY 1, 2""")
def pl2(v):
    calls, members = D.tagged(v.genotype, D.memberships(v.sample))
    scored, dealt = panel_sums(v, calls)
    d = D.reference_stats(scored, members, dealt=dealt)
    return d.select(
        "pgs_id", "population", "n_samples",
        *[F.round(c, 8).alias(c) for c in ("mean", "std", "sum_mean", "sum_std")],
        single(F.col("median")).alias("median"), single(F.element_at("quantiles", "5")).alias("q5"),
        single(F.element_at("quantiles", "95")).alias("q95"),
    )


@check("ag34_panel_match_rate", f"""WITH {PANEL_SQL}, hit AS (SELECT DISTINCT s.pgs_id, s.chrom, s.pos, s.effect_allele
    FROM v_genotype g JOIN v_score s ON g.chrom = s.chrom AND g.pos = s.pos
    WHERE (s.effect_allele = g.alt AND s.other_allele = g.ref) OR (s.effect_allele = g.ref AND s.other_allele = g.alt))
  SELECT pgs_id, n_hit AS matched_variants, total AS total_variants, round(n_hit * 1.0::DOUBLE / total, 6) AS match_rate
  FROM (SELECT pgs_id, count(*) AS total FROM v_score GROUP BY 1) t JOIN (SELECT pgs_id, count(*) AS n_hit FROM hit GROUP BY 1) h USING (pgs_id)""")
def ag34(v):
    hits = v.score.join(v.genotype.select("chrom", "pos", "ref", "alt").distinct(), ["chrom", "pos"]).where(
        ((F.col("effect_allele") == F.col("alt")) & (F.col("other_allele") == F.col("ref")))
        | ((F.col("effect_allele") == F.col("ref")) & (F.col("other_allele") == F.col("alt")))
    ).select("pgs_id", "chrom", "pos", "effect_allele").distinct()
    n = hits.groupBy("pgs_id").agg(F.count(F.lit(1)).alias("matched_variants"))
    return O.score_totals(v.score).join(n, "pgs_id").select(
        "pgs_id", "matched_variants", F.col("total").alias("total_variants"),
        F.round(F.col("matched_variants") / F.col("total"), 6).alias("match_rate"),
    )


# ---- percentiles -------------------------------------------------------------------------------------------------

ERF_SQL = """(CASE WHEN {x} < 0 THEN -1 ELSE 1 END * (1 - ((((1.061405429::DOUBLE * (1/(1+0.3275911::DOUBLE*abs({x}))) - 1.453152027) * (1/(1+0.3275911::DOUBLE*abs({x})))
  + 1.421413741) * (1/(1+0.3275911::DOUBLE*abs({x}))) - 0.284496736) * (1/(1+0.3275911::DOUBLE*abs({x}))) + 0.254829592) * (1/(1+0.3275911::DOUBLE*abs({x}))) * exp(-{x} * {x})))"""
SHARE_SQL = """anc AS (SELECT sample_id, superpop, p AS top, 1 - p AS rest FROM (SELECT sample_id, superpop,
    (50 + sample_id % 50) / 100.0::DOUBLE AS p FROM v_sample)),
  refs AS (SELECT sample_id, CASE WHEN top >= 0.8 THEN superpop ELSE 'MIX' END AS population, true AS is_primary FROM anc
    UNION ALL SELECT sample_id, CASE WHEN superpop = 'EUR' THEN 'EAS' ELSE 'EUR' END, false FROM anc
    UNION ALL SELECT sample_id, superpop, false FROM anc WHERE top < 0.8)"""
PCT_SQL = f"""{SCORED_SQL}, {SHARE_SQL},
  exp_std AS (SELECT pgs_id, coalesce(max(CASE WHEN population = 'EUR' THEN std END), max(CASE WHEN population = 'MIX' THEN std END)) AS expected_std
     FROM v_stats WHERE population IN ('EUR', 'MIX') AND std > 0 GROUP BY 1),
  sc AS (SELECT sample_id, pgs_id, round(score_sum, 6) AS score_sum, round(score_sum, 6) / allele_ct AS raw_score FROM scored WHERE allele_ct > 0),
  j AS (SELECT sc.*, r.population, r.is_primary, mean, std, expected_std,
      CASE WHEN abs(mean) > 1 AND abs(raw_score) < abs(mean) * 0.001 THEN score_sum ELSE raw_score END AS cmp
    FROM sc JOIN refs r USING (sample_id) LEFT JOIN v_stats s ON s.pgs_id = sc.pgs_id AND s.population = r.population
    LEFT JOIN exp_std e ON e.pgs_id = sc.pgs_id),
  z AS (SELECT *, CASE WHEN std > 0 THEN (cmp - mean) / std END AS zz FROM j),
  p AS (SELECT *, 50 * (1 + {ERF_SQL.format(x='(zz / sqrt(2))')}) AS pct,
    coalesce(expected_std > 0 AND std < expected_std * 0.1, false) AS collapsed FROM z),
  pct AS (SELECT *, CASE WHEN mean IS NULL OR std IS NULL THEN 'no_reference_stats' WHEN NOT std > 0 THEN 'ref_std_zero'
      WHEN abs(zz) > 6 THEN 'z_score_extreme' WHEN collapsed THEN 'distribution_collapsed' END AS reason FROM p)"""


def shares(v):
    """A main population and one other: EUR, or EAS for EUR samples."""
    top = (F.lit(50) + F.col("sample_id") % 50) / 100
    other = F.when(F.col("superpop") == "EUR", "EAS").otherwise("EUR")
    return v.sample.select("sample_id", F.create_map(F.col("superpop"), top, other, 1 - top).alias("shares"))


def cohort_scores(v, calls):
    sides = O.settled(calls, v.score)
    return comparable(O.sum_scores(O.match_effect_allele(*sides, parts=O.parts_by_score(*sides)), O.pair_columns(calls)))


def comparable(scored, *more):
    total = F.round("score_sum", 6)
    return scored.where(F.col("allele_ct") > 0).select(*O.pair_columns(scored), total.alias("score_sum"), (total / F.col("allele_ct")).alias("raw_score"), *more)


def cohort_percentiles(v):
    calls, references = D.tagged(v.genotype, D.choose_references(shares(v)))
    return D.percentiles(cohort_scores(v, calls), references, v.stats)


@check("sc15_reference_selection", f"WITH {SHARE_SQL} SELECT sample_id, population, is_primary FROM refs")
def sc15(v):
    return D.choose_references(shares(v))


@check("pl5_multi_population_percentile", f"""WITH {PCT_SQL} SELECT sample_id, pgs_id, population, is_primary,
   CASE WHEN reason IS NULL THEN round(least(greatest(pct, 0.5), 99.5), 1) END AS percentile, coalesce(reason, '') AS reason FROM pct""")
def pl5(v):
    return cohort_percentiles(v).select(
        "sample_id", "pgs_id", "population", "is_primary", "percentile", F.coalesce("reason", F.lit("")).alias("reason")
    )


@check("sc11_z_score", f"WITH {PCT_SQL} SELECT sample_id, pgs_id, population, is_primary, zz AS z_score FROM pct")
def sc11_every(v):
    return cohort_percentiles(v).select("sample_id", "pgs_id", "population", "is_primary", F.col("z").alias("z_score"))


@check("sc12_normal_percent", f"WITH {PCT_SQL} SELECT sample_id, pgs_id, population, is_primary, round(pct, 4) AS percent FROM pct")
def sc12_every(v):
    z = (S.comparable_score(F.col("raw_score"), F.col("score_sum"), F.col("mean")) - F.col("mean")) / F.when(F.col("std") > 0, F.col("std"))
    return cohort_percentiles(v).select("sample_id", "pgs_id", "population", "is_primary", F.round(S.normal_percent(z), 4).alias("percent"))


@check("sc13_sanity_gates", f"""WITH {PCT_SQL}, g AS (SELECT *, coalesce(reason IS NULL AND (pct < 0.5 OR pct > 99.5), false) AS capped FROM pct)
  SELECT sample_id, pgs_id, population, capped AS percentile_capped, concat_ws(',',
     CASE WHEN abs(zz) > 6 THEN 'z_over_6' END, CASE WHEN abs(zz) <= 6 AND abs(zz) > 4 THEN 'z_over_4' END,
     CASE WHEN std > 0 AND abs(zz) <= 6 AND collapsed THEN 'ref_std_collapsed' END,
     CASE WHEN capped THEN 'percentile_capped' END) AS gates FROM g""")
def sc13(v):
    return cohort_percentiles(v).select(
        "sample_id", "pgs_id", "population", "percentile_capped", F.array_join("gates", ",").alias("gates")
    )


@check("sc14_scale_reconciliation", f"""WITH {PCT_SQL} SELECT sample_id, pgs_id, population,
    coalesce(std > 0 AND cmp <> raw_score, false) AS scale_correction FROM pct""")
def sc14(v):
    return cohort_percentiles(v).select("sample_id", "pgs_id", "population", "scale_correction")


@check("pl6_eur_percentile", f"""WITH {PCT_SQL.replace(SHARE_SQL, "refs AS (SELECT sample_id, 'EUR' AS population, true AS is_primary FROM v_sample)")}
   SELECT sample_id, pgs_id, CASE WHEN reason IS NULL THEN round(least(greatest(pct, 0.5), 99.5), 1) END AS percentile FROM pct""")
def pl6(v):
    refs = v.sample.select("sample_id", F.lit("EUR").alias("population"), F.lit(True).alias("is_primary"))
    calls, references = D.tagged(v.genotype, refs)
    return D.percentiles(cohort_scores(v, calls), references, v.stats).select("sample_id", "pgs_id", "percentile")


def confidence(v):
    calls, references = D.tagged(v.genotype, D.choose_references(shares(v)))
    rated = comparable(O.score_samples(calls, v.score), "match_rate_value").where(F.col("pgs_id").isNotNull())
    p = D.percentiles(rated, references, v.stats)
    method = F.when(F.col("mean").isNotNull() & F.col("std").isNotNull(), "precomputed_stats").otherwise("unavailable")
    build = F.when(F.col("sample_id") % 3 == 0, "WARN").otherwise("PASS")
    reasons = S.confidence_reasons(method, F.col("match_rate_value"), build, F.col("gates"))
    return p.select(
        "sample_id", "pgs_id", "population", "is_primary", F.array_join(reasons, ",").alias("reasons"),
        F.when(F.size(reasons) == 0, "high").otherwise("low").alias("confidence"),
    )


@check("sc16_confidence", f"""WITH {PCT_SQL}, t AS (SELECT pgs_id, count(*) AS total FROM v_score GROUP BY 1),
  f AS (SELECT pct.sample_id, pct.pgs_id, population, is_primary, concat_ws(',', CASE WHEN mean IS NULL OR std IS NULL THEN 'no_precomputed_stats' END,
        CASE WHEN round(matched * 100.0::DOUBLE / total, 1) < 95 THEN 'match_rate_below_95pct' END,
        CASE WHEN pct.sample_id % 3 = 0 THEN 'build_validation_not_passed' END,
        CASE WHEN std > 0 AND (abs(zz) > 4 OR collapsed OR pct < 0.5 OR pct > 99.5) THEN 'sanity_gates_tripped' END) AS reasons
    FROM pct JOIN scored USING (sample_id, pgs_id) JOIN t ON t.pgs_id = pct.pgs_id)
  SELECT *, CASE WHEN reasons = '' THEN 'high' ELSE 'low' END AS confidence FROM f""")
def sc16_every(v):
    return confidence(v)


@check("sc17_status_band", f"""WITH {SCORED_SQL}, t AS (SELECT pgs_id, count(*) AS total FROM v_score GROUP BY 1)
    SELECT sample_id, pgs_id, CASE WHEN matched = 0 OR rate < 60 THEN 'failed' WHEN rate < 85 THEN 'warning' ELSE 'passed' END AS status,
      (matched = 0 OR rate < 60) AS no_report
    FROM (SELECT sample_id, pgs_id, matched, matched * 100.0::DOUBLE / total AS rate FROM scored JOIN t USING (pgs_id))""")
def sc17(v):
    return O.score_samples(v.genotype, v.score).select("sample_id", "pgs_id", "status", "no_report")


def reported(v):
    from ..plans.polygenic import score_with_percentile

    known = F.col("raw_score").isNotNull()  # a score that is not known has no percentile in any population: one row
    out = score_with_percentile(v.genotype, v.score, shares(v), v.stats)
    return out.where(known | F.coalesce("is_primary", F.lit(True))).select(
        "sample_id", "pgs_id", F.round("score_sum", 6).alias("score_sum"), "matched", "total", "match_rate_value", "status",
        F.when(known, F.col("population")).alias("population"), "percentile", F.when(known, F.col("is_primary")).alias("is_primary"),
    )


@check("pl4_polygenic_score", f"""WITH {PCT_SQL}, t AS (SELECT pgs_id, count(*) AS total FROM v_score GROUP BY 1)
  SELECT s.sample_id, s.pgs_id, round(s.score_sum, 6) AS score_sum, s.matched, t.total,
    round(s.matched * 100.0::DOUBLE / t.total, 1) AS match_rate_value,
    CASE WHEN s.matched = 0 OR s.matched * 100.0::DOUBLE / t.total < 60 THEN 'failed' WHEN s.matched * 100.0::DOUBLE / t.total < 85 THEN 'warning' ELSE 'passed' END AS status,
    pct.population, pct.is_primary, CASE WHEN pct.population IS NOT NULL AND reason IS NULL THEN round(least(greatest(pct, 0.5), 99.5), 1) END AS percentile
  FROM scored s JOIN t USING (pgs_id) LEFT JOIN pct ON pct.sample_id = s.sample_id AND pct.pgs_id = s.pgs_id""")
def pl4_every(v):
    return reported(v)


@check("pl4_requested_scores", f"""WITH {SCORED_SQL}, t AS (SELECT pgs_id, count(*) AS total FROM v_score GROUP BY 1),
  req AS (SELECT DISTINCT o_custkey AS sample_id, concat('PGS', lpad(CAST(o_orderkey % 130 AS VARCHAR), 6, '0')) AS pgs_id FROM orders),
  x AS (SELECT sample_id, pgs_id, coalesce(round(score_sum, 6), 0) AS score_sum, coalesce(matched, 0) AS matched, coalesce(total, 0) AS total, CASE WHEN total > 0 THEN coalesce(matched, 0) * 100.0::DOUBLE / total ELSE 0 END AS rate
    FROM req LEFT JOIN scored USING (sample_id, pgs_id) LEFT JOIN t USING (pgs_id))
  SELECT sample_id, pgs_id, score_sum, matched, total, round(rate, 1) AS match_rate_value, CASE WHEN matched = 0 OR rate < 60 THEN 'failed' WHEN rate < 85 THEN 'warning' ELSE 'passed' END AS status,
    (matched = 0 OR rate < 60) AS no_report, CASE WHEN matched = 0 THEN concat('PGS failed (0/', format('{{:,}}', total), ' variants matched: chromosome/build mismatch?)') END AS nothing_seen FROM x""")
def pl4_requested(v):
    """Each order asks one score of one sample; some are of scores that do not exist, some of scores without a position seen."""
    k = F.col("o_orderkey")
    requests = v.table("orders").select(F.col("o_custkey").alias("sample_id"), F.concat(F.lit("PGS"), F.lpad((k % 130).cast("string"), 6, "0")).alias("pgs_id"))
    s = O.score_samples(v.genotype, v.score, requests)
    return s.select("sample_id", "pgs_id", F.round("score_sum", 6).alias("score_sum"), "matched", "total", "match_rate_value", "status", "no_report",
                    F.when(F.col("matched") == 0, F.col("failure")).alias("nothing_seen"))


# ---- statistics tables -------------------------------------------------------------------------------------------


@check("pf24_usable_stats", f"""WITH {POP_SQL} SELECT s.pgs_id, s.population, coalesce(label, s.population) AS label, round(mean, 8) AS mean, round(std, 8) AS std, n_samples
   FROM v_stats s LEFT JOIN pops p ON p.population = s.population WHERE std > 0""")
def pf24(v):
    return D.usable_stats(v.stats, D.population_table(v.spark)).select(
        "pgs_id", "population", "label", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"), "n_samples"
    ).orderBy("pgs_id", "population")


WN14_SQL = """src AS (SELECT pgs_id, population, genome_build, std, n_samples, CASE WHEN n_samples % 4 = 0 THEN 0 WHEN n_samples % 4 = 1 THEN 1 ELSE 2 END AS source_rank FROM v_stats WHERE std > 0
   UNION ALL SELECT pgs_id, population, genome_build, std * 2, n_samples + 1, 1 FROM v_stats WHERE std > 0
   UNION ALL SELECT pgs_id, 'EUR', genome_build, std * 3, n_samples, 2 FROM v_stats WHERE std > 0 AND population = 'MIX')"""


def stat_sources(v):
    cols = ["pgs_id", "population", "genome_build", "std", "n_samples"]
    s = v.stats.select(*cols)
    new = s.where("n_samples % 4 = 0")
    db = s.where("n_samples % 4 = 1").unionByName(
        s.withColumn("std", F.col("std") * 2).withColumn("n_samples", F.col("n_samples") + 1)
    )
    legacy = s.where("n_samples % 4 > 1").unionByName(
        s.where("population = 'MIX'").withColumn("population", F.lit("EUR")).withColumn("std", F.col("std") * 3)
    )
    return new, db, legacy


@check("wn14_stats_precedence", f"""WITH {WN14_SQL} SELECT pgs_id, population, source_rank, min(std) AS std FROM
   (SELECT *, min(source_rank) OVER (PARTITION BY pgs_id, population) AS best FROM src) WHERE source_rank = best
   GROUP BY 1, 2, 3""")
def wn14(v):
    new, db, legacy = stat_sources(v)
    # equal ranks: the smaller spread, to make the pick unique
    best = D.stats_by_precedence(*[
        x.groupBy("pgs_id", "population").agg(F.min("genome_build").alias("genome_build"), F.min("std").alias("std"))
        for x in (new.where("std > 0"), db.where("std > 0"), legacy.where("std > 0"))
    ])
    return best.select("pgs_id", "population", "source_rank", "std")


@check("ag16_build_issues", """WITH want AS (SELECT DISTINCT pgs_id, unnest(['EUR','EAS','AFR','SAS','AMR','MIX']) AS population FROM v_score),
  i AS (SELECT w.pgs_id, unnest(list_filter([CASE WHEN n_samples IS NULL THEN w.population || ':missing' END,
     CASE WHEN n_samples < 50 THEN w.population || ':few_samples' END, CASE WHEN std <= 0 THEN w.population || ':zero_std' END,
     CASE WHEN match_rate < 0.01 THEN w.population || ':low_match' END], lambda x: x IS NOT NULL)) AS issue
    FROM want w LEFT JOIN v_stats s ON s.pgs_id = w.pgs_id AND s.population = w.population)
  SELECT p.pgs_id, coalesce(string_agg(issue, ',' ORDER BY issue), '') AS issues, count(issue) = 0 AS verified
  FROM (SELECT DISTINCT pgs_id FROM v_score) p LEFT JOIN i ON i.pgs_id = p.pgs_id GROUP BY 1""")
def ag16(v):
    return D.build_issues(v.score, v.stats).select("pgs_id", F.array_join("issues", ",").alias("issues"), "verified")


@check("so6_missing_populations", """SELECT pgs_id, unnest(['EUR','EAS','AFR','SAS','AMR','MIX']) AS population FROM (SELECT DISTINCT pgs_id FROM v_score)
   EXCEPT SELECT pgs_id, population FROM v_stats WHERE std > 0""")
def so6(v):
    return D.missing_populations(v.score, v.stats.where("std > 0"))


AUDIT_SQL = """audit AS (SELECT p.pgs_id, CASE WHEN n_samples IS NULL THEN 'missing' WHEN genome_build <> 'GRCh38' OR n_samples < 50
     OR (mean <> 0 AND std / abs(mean) < 0.001) THEN 'stale' ELSE 'ok' END AS audit_status
  FROM (SELECT DISTINCT pgs_id FROM v_score) p LEFT JOIN v_stats s ON s.pgs_id = p.pgs_id AND population = 'EUR' AND std > 0)"""


@check("ag26_stats_audit", f"WITH {AUDIT_SQL} SELECT audit_status, count(*) AS scores FROM audit GROUP BY 1")
def ag26(v):
    return D.audit_stats(v.score, v.stats).groupBy("audit_status").agg(F.count(F.lit(1)).alias("scores"))


@check("pl22_stats_audit_rows", f"WITH {AUDIT_SQL} SELECT pgs_id, audit_status FROM audit")
def pl22(v):
    return D.audit_stats(v.score, v.stats)


@check("ag24_population_coverage", """SELECT pgs_id, string_agg(population, ',' ORDER BY population) AS populations
   FROM (SELECT DISTINCT pgs_id, population FROM v_stats WHERE std > 0) GROUP BY 1""")
def ag24(v):
    return D.population_coverage(v.stats.where("std > 0"))


@check("so2_coverage_union", f"""WITH {WN14_SQL} SELECT pgs_id, string_agg(population, ',' ORDER BY population) AS populations
   FROM (SELECT DISTINCT pgs_id, population FROM src) GROUP BY 1""")
def so2(v):
    return D.population_coverage(*[s.where("std > 0") for s in stat_sources(v)])


LOG_SQL = """done AS (SELECT concat('PGS', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS pgs_id FROM events WHERE event_type = 'purchase' AND value > 150),
   full_set AS (SELECT pgs_id FROM v_stats WHERE std > 0 GROUP BY 1 HAVING count(DISTINCT population) = 6)"""


@check("jn12_resume", f"""WITH {LOG_SQL} SELECT DISTINCT pgs_id FROM v_score
   WHERE pgs_id NOT IN (SELECT pgs_id FROM done) AND pgs_id NOT IN (SELECT pgs_id FROM full_set)""")
def jn12(v):
    from ..plans.backfill import pending_scores

    log = v.table("events").where("event_type = 'purchase' AND value > 150").select(
        F.concat(F.lit("PGS"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("pgs_id"), F.lit("ok").alias("status")
    )
    return pending_scores(v.score, log, v.stats.where("std > 0"))


@check("pl3_backfill", f"""WITH {MEMBER_SQL}, {LOG_SQL}
   SELECT pgs_id, population, count(*) AS n_samples, round(avg(raw_score), 8) AS mean FROM ms
   WHERE pgs_id NOT IN (SELECT pgs_id FROM done) AND pgs_id NOT IN (SELECT pgs_id FROM full_set) GROUP BY 1, 2""")
def pl3(v):
    from ..plans.backfill import backfill_stats

    log = v.table("events").where("event_type = 'purchase' AND value > 150").select(
        F.concat(F.lit("PGS"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("pgs_id"), F.lit("ok").alias("status")
    )
    out = backfill_stats(v.genotype, v.score, v.sample, log, v.stats.where("std > 0"))
    return out.select("pgs_id", "population", "n_samples", F.round("mean", 8).alias("mean"))


@check("jn24_matched_position_panel", f"""WITH {PANEL_SQL}, eur AS (SELECT p.pgs_id, count(*) AS n, avg(raw_score) AS m, stddev_samp(raw_score) AS s
     FROM panel p JOIN v_sample USING (sample_id) WHERE superpop = 'EUR' AND raw_score IS NOT NULL GROUP BY 1),
   hit AS (SELECT pgs_id, count(*) AS n_variants FROM (SELECT DISTINCT s.pgs_id, s.chrom, s.pos FROM v_score s JOIN v_genotype g ON g.chrom = s.chrom AND g.pos = s.pos) GROUP BY 1)
   SELECT pgs_id, n_variants, n AS n_eur, CASE WHEN n_variants >= 10 AND n >= 50 THEN round(m, 8) END AS mean,
     CASE WHEN n_variants >= 10 AND n >= 50 THEN round(s, 8) END AS std FROM hit JOIN eur USING (pgs_id)""")
def jn24(v):
    from ..plans.polygenic import matched_panel_stats

    calls, weights = O.settled(v.genotype, v.score)
    positions = calls.select("chrom", "pos").distinct()
    return matched_panel_stats(positions, calls, weights, v.sample).select(
        "pgs_id", "n_variants", "n_eur", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std")
    )
