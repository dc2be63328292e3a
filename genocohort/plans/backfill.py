"""Reference statistics for every score that lacks them, resumable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BUILDABLE
from ..operators import distribution as D
from ..operators import scoring as O
from ..session import written


def pending_scores(weights: DataFrame, log: DataFrame, stats: DataFrame, force: bool = False) -> DataFrame:
    """Score ids neither logged as done nor complete in all populations."""
    ids = weights.select("pgs_id").distinct()
    if force:
        return ids
    complete = (
        stats.where(F.col("population").isin(*BUILDABLE)).groupBy("pgs_id")
        .agg(F.countDistinct("population").alias("_n")).where(F.col("_n") == len(BUILDABLE)).select("pgs_id")
    )
    done = log.where(F.col("status") == "ok").select("pgs_id").unionByName(complete)
    return ids.join(done, "pgs_id", "left_anti")


def backfill_stats(
    panel: DataFrame, weights: DataFrame, samples: DataFrame, log: DataFrame, stats: DataFrame, force: bool = False
) -> DataFrame:
    """Stats per (score, population) of the pending scores, all in one plan."""
    calls, members = D.tagged(panel, D.memberships(samples))
    calls, weights = O.settled(calls, weights)
    todo = weights.join(pending_scores(weights, log, stats, force), "pgs_id", "left_semi")
    sides = calls, written(todo, "score-weights")
    parts = O.parts_by_score(*sides)
    scored = O.sum_scores(O.match_allele_pair(*sides, parts=parts), O.pair_columns(calls))
    return D.reference_stats(scored, members, dealt=parts is not None)
