"""Aligned reads as a table, from SAM text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as N
from ..functions import genotype as G
from .lines import read_lines


def parse_sam(lines: DataFrame) -> DataFrame:
    """One row per alignment line; ``quals`` stays the Phred+33 text."""
    f = F.split("value", "\t")
    rows = lines.where((F.length("value") > 0) & ~F.col("value").startswith("@"))
    return rows.select(
        *[c for c in lines.columns if c not in ("value", "line_order")],
        f[0].alias("read_name"), F.get(f, F.lit(1)).try_cast("int").alias("flag"),
        G.bare_chrom(F.get(f, F.lit(2))).alias("chrom"), F.get(f, F.lit(3)).try_cast("bigint").alias("start_pos"),
        F.get(f, F.lit(4)).try_cast("int").alias("mapq"), F.get(f, F.lit(5)).alias("cigar"),
        F.upper(F.get(f, F.lit(9))).alias("seq"), F.get(f, F.lit(10)).alias("quals"),
    ).where(F.col("flag").isNotNull())


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_sam(read_lines(spark, paths)).withColumn(
        "sample_id", F.regexp_replace(N.base_name(F.col("file")), r"\.sam(\.gz)?$", "")
    )
