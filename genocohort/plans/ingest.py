"""Score files to clean weights with eligibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import lift_positions
from ..operators.qc import scoring_file_quality
from ..operators.scoring import distinct_weights


def ingest_weights(rows: DataFrame, builds: DataFrame, chain: DataFrame, order: list[str], target: str = "GRCh38") -> dict[str, DataFrame]:
    """Clean weights and one eligibility row per score.

    ``rows``: pgs_id, chrom, pos, effect_allele, other_allele, weight, weight_text and the order columns. ``builds``:
    pgs_id, build. Scores on another build are lifted; a score of which too little lifts is rejected.
    """
    built = rows.join(builds, "pgs_id")
    ready = built.where(F.col("build") == target)
    lifted = lift_positions(built.where(F.col("build") != target), chain, ["pgs_id"]).select(*ready.columns)
    positioned = ready.unionByName(lifted)
    quality = scoring_file_quality(positioned, ["pgs_id"])
    status = builds.join(quality, "pgs_id", "left").select(
        "pgs_id", "build",
        F.coalesce("variant_count", F.lit(0)).alias("variant_count"),
        F.coalesce("eligibility", F.lit("rejected")).alias("eligibility"),
        F.coalesce(F.array_join("reasons", ","), F.when(F.col("build") == target, "zero_variants").otherwise("liftover_failed")).alias("reasons"),
    )
    accepted = status.where(F.col("eligibility") != "rejected").select("pgs_id")
    clean = distinct_weights(positioned.join(accepted, "pgs_id", "left_semi"), order)
    return {"weights": clean.select("pgs_id", "chrom", "pos", "effect_allele", "other_allele", "weight"), "status": status}
