"""Allele maps, target positions, symbolic-allele handling and record views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G


def both_orientations(weights: DataFrame) -> DataFrame:
    """Panel ids in both allele orders; ``N`` stands in for a missing other allele."""
    other = F.coalesce("other_allele", F.lit("N"))
    effect, chrom, pos = F.col("effect_allele"), F.col("chrom"), F.col("pos")
    ids = F.array_distinct(F.array(G.allele_key(chrom, pos, effect, other), G.allele_key(chrom, pos, other, effect)))
    return weights.select(
        "pgs_id", F.explode(ids).alias("id"), "effect_allele", "weight"
    ).groupBy("pgs_id", "id", "effect_allele").agg(F.min("weight").alias("weight"))


def target_positions(*sources: DataFrame) -> DataFrame:
    """Distinct positions of all sources; each source is made distinct first, so the union stays small."""
    out = None
    for source in sources:
        part = source.select("chrom", "pos").distinct()
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def allele_map(weights: DataFrame) -> DataFrame:
    """Single bases the catalogue lists per position: at most four per position."""
    bases = weights.select(
        "chrom", "pos", F.explode(F.array(F.upper("effect_allele"), F.upper("other_allele"))).alias("base")
    ).where(G.single_base(F.col("base")))
    return bases.groupBy("chrom", "pos").agg(F.array_sort(F.collect_set("base")).alias("alleles"))


def fill_symbolic_alt(sites: DataFrame, alleles: DataFrame) -> DataFrame:
    """Give a symbolic site the smallest catalogue base that is not REF; sites without one drop out."""
    joined = sites.where(G.single_base(F.col("ref"))).join(alleles, ["chrom", "pos"])
    pick = F.get(F.filter("alleles", lambda a: a != F.col("ref")), F.lit(0))
    return joined.withColumn("alt", pick).where(F.col("alt").isNotNull()).drop("alleles")


def fill_missing_alt(sites: DataFrame, alleles: DataFrame) -> DataFrame:
    """As above, but a site where every listed base is REF gets ``N`` (``A`` when REF is ``N``)."""
    joined = sites.join(alleles, ["chrom", "pos"])
    pick = F.get(F.filter("alleles", lambda a: a != F.col("ref")), F.lit(0))
    fallback = F.when(F.col("ref") == "N", "A").otherwise("N")
    return joined.withColumn("alt", F.coalesce(pick, fallback)).drop("alleles")


def without_ref_blocks(records: DataFrame) -> DataFrame:
    """Records whose only ALT is not symbolic."""
    return records.where(~((F.size("alts") == 1) & G.is_symbolic(F.col("alts"))))


def variants_only(records: DataFrame) -> DataFrame:
    """Called, non-reference records with real alleles only."""
    real = records.where(~G.is_ref_block(F.col("alts"), F.col("gt")) & ~G.is_hom_ref_or_missing(F.col("gt")))
    return real.withColumn("alts", G.strip_symbolic(F.col("alts"))).where(F.size("alts") > 0)


def normalisation_counts(records: DataFrame, by: list[str]) -> DataFrame:
    """What a normalisation pass sees: all records, blocks, records that lose a symbolic ALT, records kept."""
    block = G.is_ref_block(F.col("alts"), F.col("gt"))
    mixed = ~block & (F.size(G.strip_symbolic(F.col("alts"))) < F.size("alts"))
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(block).alias("ref_blocks"),
        F.count_if(mixed).alias("stripped"),
        F.count_if(~block).alias("kept"),
    )
