"""Ancestry analyses of a cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..operators import ancestry as A
from ..operators import ld as LD
from ..operators import pca as P
from ..operators import roh as R
from ..session import written


def project_and_assign(projected: DataFrame, centres: DataFrame) -> DataFrame:
    """PCs with the closest population, the second one and the confidence."""
    return projected.join(A.closest_population(A.centroid_distances(projected, centres)), "sample_id")


def admixture_summary(distances: DataFrame) -> DataFrame:
    shares = A.admixture(distances)
    return shares.groupBy("sample_id").agg(
        F.max_by("superpop", F.struct(F.col("share"), F.col("superpop"))).alias("top_population"),
        F.round(F.max(100 * F.col("share")), 1).alias("top_percent"),
    )


def y_haplogroups(records: DataFrame, markers: DataFrame) -> DataFrame:
    """Label, headline and the five best supported labels per sample."""
    support = A.marker_support(A.derived_markers(records.where(F.col("chrom") == "Y"), markers), markers)
    text = F.concat(F.col("haplogroup"), F.lit("("), F.col("derived").cast("string"), F.lit("/"), F.col("label_total").cast("string"), F.lit(")"))
    top = A.top_labels(support).withColumn("text", text).groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "text"))).alias("_t")
    )
    return A.pick_haplogroup(support).join(top, "sample_id").select(
        "sample_id", "haplogroup",
        F.concat(F.lit("Y-DNA: "), "haplogroup", F.lit(" ("), F.col("derived").cast("string"), F.lit(" derived SNPs)")).alias("headline"),
        F.array_join(F.transform("_t", lambda e: e["text"]), ", ").alias("top"),
    )


def mt_evidence(records: DataFrame, markers: DataFrame) -> DataFrame:
    """Mitochondrial calls under the name MT, their number, and marker support per label."""
    mt = records.withColumn("chrom", G.bare_chrom(F.col("chrom"))).where(F.col("chrom") == "MT")
    counts = mt.where(G.carries_alt(F.col("gt"))).groupBy("sample_id").agg(F.count(F.lit(1)).alias("mt_variants"))
    support = A.marker_support(A.derived_positions(mt, markers), markers)
    return support.join(counts, "sample_id").select(
        "sample_id", F.lit("MT").alias("contig"), "mt_variants", "haplogroup", "derived", "label_total"
    )


def runs_of_homozygosity(calls: DataFrame, samples: DataFrame) -> DataFrame:
    s = R.roh_summary(R.homozygous_segments(calls), samples)
    return s.withColumn("headline", F.concat(F.lit("ROH: "), F.col("segments").cast("string"), F.lit(" segments")))


def prune_panel(calls: DataFrame, window: int = 1000, step: int = 50, max_r2: float = 0.1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sites that pass QC, their calls, and (chrom, pos) of the sites that linkage pruning keeps.

    Every step reads the panel: its calls are written once, then those at the sites, or each would work the panel out again.
    """
    panel = written(calls.select("sample_id", "chrom", "pos", "ref", "alt", "dosage"), "panel")
    sites = written(A.panel_sites(panel), "panel-sites")
    at_sites = written(panel.join(sites.select("chrom", "pos"), ["chrom", "pos"], "left_semi"), "panel-at-sites")
    return sites, at_sites, LD.ld_prune(LD.ld_pairs(at_sites, window, step, max_r2), sites)


def build_reference(
    calls: DataFrame, samples: DataFrame, components: int = 10, window: int = 1000, step: int = 50, max_r2: float = 0.1, rounds: int = 100
) -> dict[str, DataFrame]:
    """Panel QC, linkage pruning, frequencies, components, allele weights and centroids in the projected space."""
    sites, at_sites, kept = prune_panel(calls, window, step, max_r2)
    used = written(sites.join(kept, ["chrom", "pos"], "left_semi"), "panel-used")
    z = written(P.standardised_table(at_sites, used), "panel-z")
    scores, loadings = P.panel_components(z, components, rounds)
    weights = P.allele_weights(loadings, components)
    projected = A.project(at_sites, used, weights, components)
    return {"sites": used, "z": z, "weights": weights, "projected": projected, "centroids": A.centroids(projected, samples, components), "errors": P.component_errors(z, scores, loadings, components)}
