"""Tables written and merged: partitioned Parquet, upserts, append logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.picks import first_rows
from ..session import written


#: Folders of a table of weights, and into how many files the rows of one are dealt: as many for any number of scores.
WEIGHT_BUCKETS, WEIGHT_FILES = 64, 8


def write_weights(weights: DataFrame, path: str) -> None:
    """Clean weights in folders by hash of the score, in files in order of scores, so that a score's rows are skipped to.

    Scores that are stored at ``path`` and not given stay; only folders that hold a given score are read and written again.
    """
    spark = weights.sparkSession
    bucket = F.pmod(F.xxhash64("pgs_id"), F.lit(WEIGHT_BUCKETS)).cast("int")
    fresh = weights.withColumn("score_bucket", bucket)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        given = weights.select(F.col("pgs_id").alias("_given")).distinct()
        stored = spark.read.schema(fresh.schema).parquet(path).join(fresh.select("score_bucket").distinct(), "score_bucket", "left_semi")
        stayed = stored.join(given, F.col("pgs_id").eqNullSafe(F.col("_given")), "left_anti")
        fresh = fresh.unionByName(stayed.select(*fresh.columns))
    dealt = fresh.withColumn("_part", F.pmod(F.xxhash64("pgs_id", "chrom", "pos"), F.lit(WEIGHT_FILES))).repartition("score_bucket", "_part")
    dealt.drop("_part").sortWithinPartitions("score_bucket", "pgs_id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("score_bucket").parquet(path)


def write_genotypes(genotypes: DataFrame, table: str, path: str, buckets: int) -> None:
    """Genotype table bucketed by position, so joins with weights on position do not shuffle it again."""
    genotypes.write.mode("overwrite").option("path", path).bucketBy(buckets, "chrom", "pos").sortBy("chrom", "pos").format(
        "parquet"
    ).saveAsTable(table)


STATS_KEY = ["pgs_id", "population"]
#: Files of one population a table of stats or raw scores is spread over; a rewrite touches those of the scores it holds.
SCORE_BUCKETS = 16


def replace_scores(rows: DataFrame, existing: DataFrame | None, path: str) -> None:
    """Writes rows of (score, population) pairs in place of the stored rows of the same pairs; all other rows stay.

    Only the partitions that hold such a pair are read and written again; where no pair is stored yet, files are added.
    """
    place = ["population", "score_bucket"]
    bucket = F.pmod(F.xxhash64("pgs_id"), F.lit(SCORE_BUCKETS)).cast("int")
    fresh, mode = rows.withColumn("score_bucket", bucket), "overwrite"
    if existing is not None:
        fresh = written(fresh, "given-scores")  # their pairs, and then they themselves, are read
        given = fresh.select(*STATS_KEY).distinct()
        if existing.join(given, STATS_KEY, "left_semi").isEmpty():
            mode = "append"
        else:
            stored = existing.withColumn("score_bucket", bucket).join(fresh.select(*place).distinct(), place, "left_semi")
            fresh = fresh.unionByName(stored.join(given, STATS_KEY, "left_anti").select(*fresh.columns))
    fresh.repartition(*place).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*place).parquet(path)


def write_stats(stats: DataFrame, existing: DataFrame | None, path: str, force: bool = False) -> None:
    """Stats per (score, population); pairs already present stay unless ``force``, which replaces them and nothing else.

    ``existing`` holds what is stored at ``path`` (None: nothing yet).
    """
    fresh = stats if force or existing is None else stats.join(existing.select(*STATS_KEY).distinct(), STATS_KEY, "left_anti")
    replace_scores(fresh, existing, path)


def write_raw_scores(scores: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """Long table of panel scores, kept for empirical percentiles; scores already stored stay unless they are given again."""
    replace_scores(scores.select("pgs_id", "population", "sample_id", "raw_score"), existing, path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def merge_keep_old(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert in which a null never erases a stored value."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*rest).alias("_old"))
    n = new.select(*keys, F.struct(*rest).alias("_new"))
    return o.join(n, list(keys), "full_outer").select(
        *keys, *[F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")).alias(c) for c in rest]
    )


def merge_replace(old: DataFrame, new: DataFrame, keys: Sequence[str], version: Sequence[str] = ()) -> DataFrame:
    """Upsert in which the new row replaces the stored one; ``version`` columns order several new rows of a key."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    order = [F.col("_age"), *[F.col(c).desc() for c in version]]
    return first_rows(both, keys, order).drop("_age")
