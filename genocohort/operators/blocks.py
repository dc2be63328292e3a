"""Reference blocks: expansion to per-position rows, and genotypes at target positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from .alleles import fill_symbolic_alt
from .intervals import interval_join
from .picks import first_rows


def blocks_over_targets(blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """Blocks that cover at least one target."""
    sites = targets.select("chrom", F.col("pos").alias("site_pos"))
    return interval_join(sites, blocks, "site_pos", "pos", "end_pos", how="left_semi")


def expand_blocks(blocks: DataFrame, sites: DataFrame, salt: int = 4) -> DataFrame:
    """One row per (block, site inside it) with the site's REF base and the block's genotype.

    Only target sites are expanded, never whole blocks. ``sites`` needs chrom, pos, ref.
    """
    asked = sites.select("chrom", F.col("pos").alias("site_pos"), F.col("ref").alias("site_ref"))
    slim = blocks.select("sample_id", "chrom", "pos", "end_pos", "gt", "min_dp")
    return interval_join(asked, slim, "site_pos", "pos", "end_pos", salt=salt).select(
        "sample_id", "chrom", F.col("site_pos").alias("pos"), F.col("site_ref").alias("ref"), "gt", "min_dp",
        F.col("pos").alias("block_pos"),
    )


def genotypes_at_targets(records: DataFrame, sites: DataFrame, alleles: DataFrame) -> DataFrame:
    """Genotype table for scoring: called records at the targets, plus expanded reference blocks.

    ``alts`` holds every ALT of the record, in the order that the genotype counts them; ``alt`` is the first real one and
    ``dosage`` its copies. Block sites get the catalogue's allele, half-calls become missing and one row per
    (sample, position) remains: a called record before a block, then the block that starts last.
    """
    end = G.block_end(F.col("info_end"), F.col("pos"))
    is_block = G.is_ref_block(F.col("alts"), F.col("gt"))
    called = records.where(~is_block).join(sites.select("chrom", "pos"), ["chrom", "pos"], "left_semi")
    real = called.withColumn("_alts", G.strip_symbolic(F.col("alts"))).where(F.size("_alts") > 0).select(
        "sample_id", "chrom", "pos", "ref", F.get("_alts", F.lit(0)).alias("alt"), "alts", "gt",
        F.lit(0).alias("_rank"), F.lit(0).cast("bigint").alias("_start"),
    )
    blocks = records.where(is_block).withColumn("end_pos", end)
    expanded = fill_symbolic_alt(expand_blocks(blocks, sites), alleles).select(
        "sample_id", "chrom", "pos", "ref", "alt", F.array("alt").alias("alts"), "gt", F.lit(1).alias("_rank"), (-F.col("block_pos")).alias("_start")
    )
    picked = first_rows(
        real.unionByName(expanded), ["sample_id", "chrom", "pos"], ["_rank", "_start", "gt", "ref", "alt"]
    )
    return picked.withColumn("from_block", F.col("_rank") == 1).drop("_rank", "_start").withColumn(
        "dosage", G.allele_dosage(F.col("ref"), F.col("alts"), F.col("gt"), F.col("alt"))
    )
