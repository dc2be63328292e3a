"""Running totals, ordinal numbers and exact quantiles that never gather a whole group in one task.

A group (one sample's chromosome, one score's panel) may hold a large share of all rows. Every function here splits the
group into ordered buckets, sums per bucket, carries the sums of the earlier buckets over, and orders rows only inside
a bucket. The carry window sees one row per (group, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genotype import whole

def running_total(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], value: Column, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows up to and including this one.

    ``bucket`` must not decrease along ``order`` inside a group.
    """
    tagged = df.withColumn("_bucket", bucket).withColumn("_value", value)
    per_bucket = tagged.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_bucket_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(
        *keys, "_bucket", F.coalesce(F.sum("_bucket_sum").over(earlier), F.lit(0)).alias("_carry")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        tagged.withColumn("_inside", F.sum("_value").over(inside))
        .join(carry, [*keys, "_bucket"])
        .withColumn(out, F.col("_carry") + F.col("_inside"))
        .drop("_bucket", "_value", "_carry", "_inside")
    )


def ordinal(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: 0-based place of the row in its group."""
    return running_total(df, keys, bucket, order, F.lit(1), out).withColumn(out, F.col(out) - 1)


def numbered(df: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): the distinct values, numbered from 0 in an arbitrary but fixed order."""
    spread = df.select(column).distinct().withColumn("_spread", F.pmod(F.xxhash64(column), F.lit(256)))
    return ordinal(spread, [], F.col("_spread"), ["_spread", column], out).select(column, out)


#: Half width of a bracket as a share of its group, accuracy of the sketch (a sixteenth of that), and groups too small for brackets.
MARGIN, ACCURACY, SMALL = 1 / 256, 4096, 1024


def sketch_brackets(value: str, shares: Sequence[float]) -> Column:
    """An aggregate beside others of the same pass: values of a mergeable sketch on either side of each share."""
    return F.percentile_approx(value, [x for p in shares for x in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))], ACCURACY)


def select_quantiles(df: DataFrame, sketched: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], out: str) -> DataFrame:
    """Linear-interpolation quantiles per group as array column ``out``, exact, by a second pass over ``df``.

    ``sketched`` has, per group, ``_n`` (its non-null values) and ``_brackets`` (from sketch_brackets). Values between brackets are only
    counted, one row a gap; those inside, a few hundredths, are ordered, gap by gap. All values of a small group are.
    A quantile that no bracket held would raise; the brackets are sixteen times as wide as the sketch may be off.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")).join(sketched.select(*keys, "_n", "_brackets"), list(keys))
    v = F.col("_v")
    pairs = [(F.get("_brackets", F.lit(2 * i)), F.get("_brackets", F.lit(2 * i + 1))) for i in range(len(shares))]
    inside = F.col("_n") < SMALL
    for low, high in pairs:
        inside = inside | ((v >= low) & (v <= high))
    # a place among the borders that never falls as the value rises, odd on a border itself
    gap = F.size(F.filter("_brackets", lambda b: b < v)) + F.size(F.filter("_brackets", lambda b: b <= v))
    counted = rows.select(*keys, "_n", gap.alias("_gap"), F.when(inside, v).alias("_v")).groupBy(*keys, "_gap", "_v").agg(F.count(F.lit(1)).alias("_times"), F.first("_n").alias("_n"))
    placed = running_total(counted, keys, F.col("_gap"), ["_v"], F.col("_times"), "_upto")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_times") <= place) & (place < F.col("_upto")), F.col("_v")))

    place = lambda share: F.lit(float(share)) * (F.col("_n") - 1)
    picks = [x for i, p in enumerate(shares) for x in (at(F.floor(place(p))).alias(f"_a{i}"), at(F.ceil(place(p))).alias(f"_b{i}"))]
    picked = placed.groupBy(*keys).agg(F.first("_n").alias("_n"), *picks)
    missed = F.lit(False)
    for i in range(len(shares)):
        missed = missed | F.col(f"_a{i}").isNull() | F.col(f"_b{i}").isNull()
    part = lambda p: place(p) - F.floor(place(p))
    values = F.array(*[F.col(f"_a{i}") * (1 - part(p)) + F.col(f"_b{i}") * part(p) for i, p in enumerate(shares)])
    return picked.select(*keys, F.when(missed, F.raise_error(F.lit("a quantile lies outside its bracket"))).otherwise(values).alias(out))


def ordered_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], out: str, more: Sequence[Column]) -> DataFrame:
    """Linear-interpolation quantiles per group as array column ``out``, exact, beside the aggregates ``more``.

    One pass that sorts each group in a task (on disk, if need be): for rows that lie by a key already and groups known to be small enough."""
    group = Window.partitionBy(*keys)
    placed = df.withColumn("_at", F.row_number().over(group.orderBy(F.col(value).asc_nulls_last())) - 1).withColumn("_n", F.count(value).over(group))
    place = lambda share: F.lit(float(share)) * (F.col("_n") - 1)
    at = lambda where: F.max(F.when(F.col("_at") == where, F.col(value)))
    picks = [x for i, p in enumerate(shares) for x in (at(F.floor(place(p))).alias(f"_a{i}"), at(F.ceil(place(p))).alias(f"_b{i}"))]
    picked = placed.groupBy(*keys).agg(*more, F.first("_n").alias("_n"), *picks)
    part = lambda p: place(p) - F.floor(place(p))
    values = F.array(*[F.col(f"_a{i}") * (1 - part(p)) + F.col(f"_b{i}") * part(p) for i, p in enumerate(shares)])
    hidden = {"_n", *(f"_{side}{i}" for side in "ab" for i in range(len(shares)))}
    return picked.withColumn(out, values).select(*[c for c in picked.columns if c not in hidden], out)


def nth_value(df: DataFrame, keys: Sequence[str], value: str, place_of_total, out: str) -> DataFrame:
    """Value at an exact 0-based place among the sorted non-null values; ``place_of_total`` maps n to the place."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    bucket = whole(F.col(value), 16)
    placed = running_total(counted.join(totals, list(keys)), keys, bucket, [value], F.col("_n"), "_upto")
    place = place_of_total(F.col("_total"))
    return placed.where((F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto"))).select(
        *keys, F.col(value).alias(out)
    )
