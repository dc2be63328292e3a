"""First / best row per key, and sides of joins that are never broadcast.

``row_number() <= k`` lets Spark trim every input partition to k rows per key before the shuffle
(``WindowGroupLimit``), so a key holding most rows sends k rows per task and no more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def never_broadcast(df: DataFrame) -> DataFrame:
    """For the side of a join that grows with the data while Spark takes it for small: its estimate goes by compressed files and does not
    count what an explode multiplies, and a broadcast passes the whole side through the driver."""
    return df.hint("merge")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int = 1, rank: str | None = None) -> DataFrame:
    place = rank or "_place"
    numbered = df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = numbered.where(F.col(place) <= k)
    return kept if rank else kept.drop(place)
