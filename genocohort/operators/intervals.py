"""Point-in-interval joins through nested bins.

An interval is filed under the finest bin size that is at least its length, so it lies in at most two bins whatever its
length. A point asks once per bin size. Both sides then meet in an equi join, which Spark can shuffle, split when
skewed, or broadcast when it finds a side small. The finest bin is about as long as a short read, so that with dense sites
few pairs meet that do not overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .picks import never_broadcast

FINEST_BITS = 8
STEP_BITS = 3
LEVELS = 9  # the coarsest bin is longer than any chromosome


def _row_salt(intervals: DataFrame, salt: int) -> Column:
    """A salt that depends on the row's content only, so a task that runs again gives every row the same one."""
    if salt == 1:
        return F.lit(0)
    plain = [f.name for f in intervals.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return F.pmod(F.xxhash64(*plain), F.lit(salt))


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    pos: str,
    start: str,
    end: str,
    on: Sequence[str] = ("chrom",),
    how: str = "inner",
    salt: int = 1,
    longest: int | None = None,
    small: bool = False,
) -> DataFrame:
    """Rows of ``points`` with every interval of ``intervals`` (closed ends) that contains ``pos``.

    ``salt`` spreads the intervals of one bin over that many keys and repeats the points, for data in which very many
    intervals cover one place (a targeted panel). ``how`` is ``inner`` or ``left_semi`` of the interval side, which keeps
    equal interval rows apart. ``longest`` is the length that most intervals stay below: points then ask no coarser bins,
    and the few longer intervals are filed under as many of the coarsest ones as they touch. ``small``: one side is known to
    stay small however much there is of the other, and Spark may broadcast it; else both are shuffled, as Spark does not count the
    rows that a point asks with.
    """
    semi = how == "left_semi"
    levels = LEVELS
    if longest is not None and not semi:
        levels = next((i + 1 for i in range(LEVELS) if longest <= 1 << (FINEST_BITS + STEP_BITS * i)), LEVELS)
    length = F.col(end) - F.col(start) + 1
    level = F.lit(levels - 1)
    for i in reversed(range(levels - 1)):
        level = F.when(length <= (1 << (FINEST_BITS + STEP_BITS * i)), F.lit(i)).otherwise(level)

    def bin_at(place: Column, bits: Column) -> Column:
        return F.call_function("shiftright", place.cast("bigint"), bits)

    bits = F.lit(FINEST_BITS) + F.lit(STEP_BITS) * F.col("_level")
    binned = (
        intervals.where(F.col(end) >= F.col(start))
        .withColumn("_level", level)
        .withColumn("_salt", _row_salt(intervals, salt))
        .withColumn(
            "_bin",
            # for the semi join an interval has one bin, that of its start, and points ask the bin before theirs as well
            bin_at(F.col(start), bits) if semi else F.explode(F.sequence(bin_at(F.col(start), bits), bin_at(F.col(end), bits))),
        )
    )
    asked = points.withColumn(
        "_ask",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("_level"),
                        (bin_at(F.col(pos), F.lit(FINEST_BITS + STEP_BITS * i)) - before).alias("_bin"),
                    )
                    for i in range(levels)
                    for before in ((0, 1) if semi else (0,))
                ]
            )
        ),
    ).select("*", "_ask.*").drop("_ask")
    if salt > 1:
        asked = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salt - 1).cast("bigint"))))
        binned = binned.withColumn("_salt", F.col("_salt").cast("bigint"))
    else:
        asked = asked.withColumn("_salt", F.lit(0))
    if not small:
        asked = never_broadcast(asked)
    keys = [*on, "_level", "_bin", "_salt"]
    helper = ["_level", "_bin", "_salt"]
    if semi:
        a, b = binned.alias("a"), asked.alias("b")
        same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
        inside = F.col(f"b.{pos}").between(F.col(f"a.{start}"), F.col(f"a.{end}"))
        cond = inside
        for c in same:
            cond = cond & c
        return a.join(b, cond, "left_semi").drop(*helper)
    return (
        binned.join(asked, keys).where(F.col(pos).between(F.col(start), F.col(end))).drop(*helper)
    )


def lift_positions(
    variants: DataFrame, chain: DataFrame, group: Sequence[str] = (), min_rate: float = 0.5
) -> DataFrame:
    """Move ``pos`` by the ``delta`` of the chain interval it lies in; unmapped rows drop out.

    With ``group``, a group of which less than ``min_rate`` lifts is dropped whole.
    """
    intervals = chain.select("chrom", "src_start", "src_end", "delta")
    lifted = interval_join(variants, intervals, "pos", "src_start", "src_end", small=True).select(
        *[c for c in variants.columns if c != "pos"],
        F.col("pos").alias("old_pos"),
        (F.col("pos") + F.col("delta")).alias("pos"),
    )
    if not group:
        return lifted
    rates = lift_rates(variants, lifted, group)
    return lifted.join(rates.where(F.col("lift_rate") >= min_rate).select(*group), list(group), "left_semi")


def lift_rates(variants: DataFrame, lifted: DataFrame, group: Sequence[str]) -> DataFrame:
    total = variants.groupBy(*group).agg(F.count(F.lit(1)).alias("n_total"))
    done = lifted.groupBy(*group).agg(F.count(F.lit(1)).alias("n_lifted"))
    n_lifted = F.coalesce(F.col("n_lifted"), F.lit(0))
    return total.join(done, list(group), "left").select(
        *group, "n_total", n_lifted.alias("n_lifted"), (n_lifted / F.col("n_total")).alias("lift_rate")
    )
