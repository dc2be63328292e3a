"""Reference distributions of panel scores and percentiles of samples against them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BUILDABLE, MIX_PARTS, MIX_SEED, POPULATIONS, QUANTILE_PERCENTS
from ..functions import scores as S
from ..session import written
from .picks import first_rows
from .running import numbered, ordered_quantiles, ordinal, select_quantiles, sketch_brackets


def population_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POPULATIONS, "population string, label string, min_n int, buildable boolean")


def balanced_mix(samples: DataFrame) -> DataFrame:
    """Same number of samples of each part of MIX: the lowest in md5 order of id and seed.

    The order number comes from hash-prefix buckets, so no task holds a population.
    """
    members = samples.where(F.col("superpop").isin(*MIX_PARTS)).withColumn(
        "_hash", F.md5(F.concat(F.col("sample_id").cast("string"), F.lit(MIX_SEED)))
    )
    sizes = members.groupBy("superpop").agg(F.count(F.lit(1)).alias("_n"))
    take = sizes.agg(F.when(F.count(F.lit(1)) == len(MIX_PARTS), F.min("_n")).otherwise(0).alias("_take")).withColumn(
        "superpop", F.explode(F.array(*[F.lit(p) for p in MIX_PARTS]))
    )
    bucket = F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int")
    placed = ordinal(members, ["superpop"], bucket, ["_hash", "sample_id"], "_place")
    # one row per part of MIX
    return placed.join(F.broadcast(take), "superpop").where(F.col("_place") < F.col("_take")).select(
        "sample_id", F.lit("MIX").alias("population")
    )


def memberships(samples: DataFrame) -> DataFrame:
    """(sample, population): the own super-population, and MIX for the balanced part."""
    own = samples.select("sample_id", F.col("superpop").alias("population"))
    return own.unionByName(balanced_mix(samples))


def tagged(calls: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The calls with ``_tag``, and the table of tags (``_tag``, ``_rows``): what ``rows`` (sample_id and more) hold for a sample, as a
    sorted list, is one of few (a population and MIX, the references of an ancestry). Its number travels with the sample's calls, so that
    the sums of all scores are not shuffled by sample to meet it. Samples without rows have no tag."""
    rest = [c for c in rows.columns if c != "sample_id"]
    held = written(rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("_rows")), "sample-rows")
    tags = written(numbered(held, "_rows", "_tag"), "sample-tags")
    return calls.join(held.join(tags, "_rows").select("sample_id", "_tag"), "sample_id", "left"), tags


def with_rows(scores: DataFrame, tags: DataFrame) -> DataFrame:
    """Scores of tagged calls joined with the rows of their sample."""
    each = scores.join(tags, "_tag").withColumn("_row", F.explode("_rows"))
    return each.select(*[c for c in scores.columns if c != "_tag"], "_row.*")


def score_distribution(
    scores: DataFrame, keys: Sequence[str], value: str, prefix: str = "", more: Sequence[Column] = (), dealt: bool = False
) -> DataFrame:
    """n, mean, sample standard deviation (0 for one sample), min, max, quantiles and median of ``value``.

    Two passes over ``scores``: the first takes the moments and a quantile sketch, the second orders the values near the quantiles.
    ``more``: further aggregates to take in the first pass. ``dealt``: the scores lie in parts by one of the keys, of which none is too
    much for a task (``parts_by_score``): they are ordered where they lie, in one pass that shuffles nothing."""
    shares = [p / 100 for p in QUANTILE_PERCENTS]
    as_map = F.map_from_arrays(F.array(*[F.lit(str(p)) for p in QUANTILE_PERCENTS]), F.col("_q"))
    moments = [
        F.count(value).alias("n_samples"),
        F.avg(value).alias(f"{prefix}mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"{prefix}std"),
        F.min(value).alias(f"{prefix}min"),
        F.max(value).alias(f"{prefix}max"),
        *more,
    ]
    if dealt:
        known = scores
        for key in keys:  # as of two passes, which meet by the keys
            known = known.where(F.col(key).isNotNull())
        found = ordered_quantiles(known, keys, value, shares, "_q", moments).where(F.col("n_samples") > 0)
        middle = F.get("_q", F.lit(QUANTILE_PERCENTS.index(50)))
        return found.select(*[c for c in found.columns if c != "_q"], middle.alias(f"{prefix}median"), as_map.alias(f"{prefix}quantiles"))
    base = scores.groupBy(*keys).agg(*moments, sketch_brackets(value, shares).alias("_brackets"))
    quantiles = select_quantiles(scores, base.withColumnRenamed("n_samples", "_n"), keys, value, shares, "_q")
    median = F.get("_q", F.lit(QUANTILE_PERCENTS.index(50)))
    return base.join(quantiles, list(keys)).select(
        *[c for c in base.columns if c != "_brackets"], median.alias(f"{prefix}median"), as_map.alias(f"{prefix}quantiles")
    )


def reference_stats(panel_scores: DataFrame, samples: DataFrame, dealt: bool = False) -> DataFrame:
    """Stats per (score, population) on the AVG scale, with mean and spread of the SUM scale.

    ``panel_scores`` needs sample_id, pgs_id, score_sum, raw_score. They are written once, as two passes read them; one pass reads
    those that come ``dealt`` by score. Scores of calls that ``tagged`` gave the memberships come with the table of tags in place of
    ``samples``.
    """
    by = ["pgs_id", "population"]
    tags = [c for c in ("_tag",) if c in panel_scores.columns]
    raw = panel_scores.where(F.col("raw_score").isNotNull()).select("sample_id", "pgs_id", "score_sum", "raw_score", *tags)
    if not dealt:
        raw = written(raw, "panel-scores")
    member_scores = with_rows(raw, samples) if tags else raw.join(memberships(samples), "sample_id")
    sum_scale = [
        F.avg("score_sum").alias("sum_mean"), F.coalesce(F.stddev_samp("score_sum"), F.lit(0.0)).alias("sum_std")
    ]
    return score_distribution(member_scores, by, "raw_score", more=sum_scale, dealt=dealt)


def usable_stats(stats: DataFrame, populations: DataFrame) -> DataFrame:
    """Stats with a spread, with the population's label."""
    return stats.where(F.col("std") > 0).join(
        populations.select("population", "label"), "population", "left"
    ).withColumn("label", F.coalesce("label", "population"))


def stats_by_precedence(*sources: DataFrame) -> DataFrame:
    """One usable row per (score, population): earlier sources win."""
    ranked = None
    for rank, source in enumerate(sources):
        part = source.where(F.col("std") > 0).withColumn("source_rank", F.lit(rank))
        ranked = part if ranked is None else ranked.unionByName(part)
    return first_rows(ranked, ["pgs_id", "population"], ["source_rank", "genome_build"])


def choose_references(ancestry: DataFrame) -> DataFrame:
    """(sample, shares map) -> one row per population to compare with."""
    chosen = ancestry.withColumn("_choice", S.reference_choice(F.col("shares")))
    wanted = F.concat(
        F.array(F.struct(F.col("_choice.primary").alias("population"), F.lit(True).alias("is_primary"))),
        F.transform(
            F.col("_choice.secondary"), lambda p: F.struct(p.alias("population"), F.lit(False).alias("is_primary"))
        ),
    )
    return chosen.withColumn("_want", F.explode(wanted)).select(
        "sample_id", "_want.population", "_want.is_primary"
    )


def _expected_spread() -> Column:
    """Spread to expect of a score, among its statistics: EUR's, else MIX's."""
    usable = F.when(F.col("std") > 0, F.col("std"))
    return F.coalesce(*[F.max(F.when(F.col("population") == p, usable)) for p in ("EUR", "MIX")]).alias("expected_std")


def expected_spread(stats: DataFrame) -> DataFrame:
    """Spread to expect per score: EUR's, else MIX's."""
    eligible = stats.where(F.col("population").isin("EUR", "MIX") & (F.col("std") > 0))
    return eligible.groupBy("pgs_id").agg(_expected_spread())


def percentiles(scored: DataFrame, references: DataFrame, stats: DataFrame) -> DataFrame:
    """Percentile of every scored (sample, score) against each population chosen for the sample.

    ``stats`` holds one row per (score, population); a missing or unusable row gives a null percentile with a reason.
    Scores of calls that ``tagged`` gave the references come with the table of tags in place of ``references``.
    """
    # a sample's references and a score's statistics are a handful each: they meet the scores as lists, so that a score is shuffled once to
    # each and becomes one row per reference only after that; the lists' side is hashed, the scores are not sorted
    plain = [c for c in scored.columns if c != "_tag"]
    known = stats.groupBy("pgs_id").agg(F.collect_list(F.struct("population", "mean", "std")).alias("_known"), _expected_spread())
    if "_tag" in scored.columns:
        met = scored.join(references.withColumnRenamed("_rows", "_wanted"), "_tag")
    else:
        wanted = references.groupBy("sample_id").agg(F.collect_list(F.struct(*[c for c in references.columns if c != "sample_id"])).alias("_wanted"))
        met = scored.join(wanted.hint("shuffle_hash"), "sample_id")
    met = met.join(known.hint("shuffle_hash"), "pgs_id", "left")
    asked = met.withColumn("_want", F.explode("_wanted")).select(*plain, "_want.*", "_known", "expected_std")
    same = F.filter("_known", lambda s: s["population"] == F.col("population"))
    joined = asked.withColumn("_stat", F.explode_outer(same)).withColumns({"mean": F.col("_stat.mean"), "std": F.col("_stat.std")}).drop("_known", "_stat")
    extra = S.percentile_columns(
        F.col("raw_score"), F.col("score_sum"), F.col("mean"), F.col("std"), F.col("expected_std")
    )
    return joined.withColumns(extra)


def missing_populations(scores: DataFrame, stats: DataFrame) -> DataFrame:
    """(score, population) pairs that should have stats and have none."""
    wanted = scores.select("pgs_id").distinct().withColumn(
        "population", F.explode(F.array(*[F.lit(p) for p in BUILDABLE]))
    )
    return wanted.join(stats, ["pgs_id", "population"], "left_anti")


def build_issues(scores: DataFrame, stats: DataFrame) -> DataFrame:
    """Per score: what is wrong with its stats (empty when all populations pass)."""
    wanted = scores.select("pgs_id").distinct().withColumn(
        "population", F.explode(F.array(*[F.lit(p) for p in BUILDABLE]))
    )
    pop = F.col("population")
    issue = F.filter(
        F.array(
            F.when(F.col("n_samples").isNull(), F.concat(pop, F.lit(":missing"))),
            F.when(F.col("n_samples") < 50, F.concat(pop, F.lit(":few_samples"))),
            F.when(F.col("std") <= 0, F.concat(pop, F.lit(":zero_std"))),
            F.when(F.col("match_rate") < 0.01, F.concat(pop, F.lit(":low_match"))),
        ),
        lambda x: x.isNotNull(),
    )
    per_pop = wanted.join(stats, ["pgs_id", "population"], "left").withColumn("_issue", issue)
    # at most six populations per score, four names each
    return per_pop.groupBy("pgs_id").agg(
        F.array_sort(F.flatten(F.collect_list("_issue"))).alias("issues")
    ).withColumn("verified", F.size("issues") == 0)


def audit_stats(scores: DataFrame, stats: DataFrame) -> DataFrame:
    """ok / stale / missing per score for the EUR stats."""
    eur = stats.where((F.col("population") == "EUR") & (F.col("std") > 0)).drop("population")
    stale = (
        (F.col("genome_build") != "GRCh38")
        | (F.col("n_samples") < 50)
        | (F.col("std") / F.when(F.col("mean") != 0, F.abs("mean")) < 0.001)
    )
    return scores.select("pgs_id").distinct().join(eur, "pgs_id", "left").select(
        "pgs_id",
        F.when(F.col("n_samples").isNull(), "missing").when(F.coalesce(stale, F.lit(False)), "stale").otherwise("ok")
        .alias("audit_status"),
    )


def population_coverage(*sources: DataFrame) -> DataFrame:
    """Populations with stats per score, as one sorted comma text; at most seven populations exist."""
    pairs = sources[0].select("pgs_id", "population")
    for other in sources[1:]:
        pairs = pairs.unionByName(other.select("pgs_id", "population"))
    return pairs.groupBy("pgs_id").agg(
        F.array_join(F.array_sort(F.collect_set("population")), ",").alias("populations")
    )
