"""Runs of homozygosity over whole cohorts.

Sliding windows need neighbours, so every chromosome of every sample is cut into index blocks that carry a halo of
neighbouring rows. A block is small whatever the chromosome holds; windows, hits and breaks are exact for its core.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genotype import whole
from .. import constants as K
from .running import ordinal, running_total

BLOCK = 4096
MEGABASE = 1_000_000


def with_halo(df: DataFrame, index: str, size: int, before: int, after: int) -> DataFrame:
    """Add ``_block``; rows near an edge also go to the neighbour, marked ``_core`` false there."""
    i = F.col(index)
    home = whole(i, size)
    inside = i % size
    blocks = F.filter(
        F.array(
            home, F.when((inside < after) & (home > 0), home - 1), F.when(inside >= size - before, home + 1)
        ),
        lambda b: b.isNotNull(),
    )
    return df.withColumn("_home", home).withColumn("_block", F.explode(blocks)).withColumn(
        "_core", F.col("_block") == F.col("_home")
    ).drop("_home")


def homozygous_segments(calls: DataFrame, block: int = BLOCK, **rules) -> DataFrame:
    """Segments per (sample, chromosome). ``calls``: sample_id, chrom, pos, dosage (null: missing), one row per position."""
    r = {**K.ROH, **rules}
    w = r["window"]
    autosomal = calls.where(F.col("chrom").isin(K.AUTOSOMES)).select("sample_id", "chrom", "pos", "dosage")
    keys = ["sample_id", "chrom"]
    indexed = ordinal(autosomal, keys, whole(F.col("pos"), MEGABASE), ["pos"], "idx")
    haloed = with_halo(indexed, "idx", block, before=w, after=w - 1)
    part = Window.partitionBy("sample_id", "chrom", "_block").orderBy("idx")
    ahead, behind = part.rowsBetween(0, w - 1), part.rowsBetween(-(w - 1), 0)
    het = F.when(F.col("dosage") == 1, 1).otherwise(0)
    missing = F.when(F.col("dosage").isNull(), 1).otherwise(0)
    full = F.count(F.lit(1)).over(ahead) == w
    hom = F.when(
        full,
        F.when((F.sum(het).over(ahead) <= r["max_het"]) & (F.sum(missing).over(ahead) <= r["max_missing"]), 1).otherwise(0),
    )
    windowed = haloed.withColumn("_hom", hom)
    windows, hits = F.count("_hom").over(behind), F.sum("_hom").over(behind)
    eligible = (windows > 0) & (hits / F.when(windows > 0, windows) >= r["cover_rate"])
    marked = windowed.withColumn("_in", F.coalesce(eligible, F.lit(False)))
    was_in, was_at = F.lag("_in").over(part), F.lag("pos").over(part)
    starts = marked.withColumn(
        "_start",
        F.when(~F.coalesce(was_in, F.lit(False)) | (F.col("pos") - was_at > r["max_gap_kb"] * 1000), 1).otherwise(0),
    ).where(F.col("_core") & F.col("_in"))
    islands = running_total(
        starts.select(*keys, "pos", "dosage", "_start"), keys, whole(F.col("pos"), MEGABASE), ["pos"], F.col("_start"), "_island"
    )
    segments = islands.groupBy(*keys, "_island").agg(
        F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count(F.lit(1)).alias("n_snps")
    ).withColumn("kb", (F.col("end_pos") - F.col("start_pos") + 1) / 1000)
    return segments.where(
        (F.col("n_snps") >= r["min_snps"]) & (F.col("kb") >= r["min_kb"]) & (F.col("kb") / F.col("n_snps") <= r["kb_per_snp"])
    ).drop("_island")


def roh_summary(segments: DataFrame, samples: DataFrame) -> DataFrame:
    """Segments, total and mean length and the autosomal share per sample; samples without a segment count zero."""
    per = segments.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("segments"), F.sum("kb").alias("total_kb"), F.avg("kb").alias("mean_kb")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return samples.select("sample_id").distinct().join(per, "sample_id", "left").select(
        "sample_id", F.coalesce("segments", F.lit(0)).alias("segments"), zero("total_kb"), zero("mean_kb"),
        (F.coalesce("total_kb", F.lit(0.0)) * 1000 / K.AUTOSOME_LENGTH).alias("froh"),
    )
