"""Mixing sources to target weights along a curriculum whose source weights change over training time.

Each source has a weight, and a schedule says how its weight runs over training time. The integral of the schedule is the
source's cumulative demand; a document's place in its source's (pseudo-random) order is inverted through that integral, which
gives its training position in [0, 1]. Sorting by position interleaves the sources as the curriculum asks at every moment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words to take, as a share of all; a source gives at most CAP times its words.
SHARE, CAP = 1.5, 2
#: Relative weight at the knots of training time 0, 1/2 and 1, for each class of weight: the heavy class grows, the light one fades.
#: Between knots it runs straight; only its shape counts, as targets fix the integral.
SCHEDULES = ((0.5, 1.0, 1.5), (1.0, 1.0, 1.0), (1.5, 1.0, 0.5))


def sized(docs: DataFrame) -> DataFrame:
    """Adds _size: the number of words `[^\\x20\\x09-\\x0D]+` of the text (null: 0)."""
    return docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, class, source_size, target): the share by weight, no source above cap times its size, the excess going to the
    others by weight until none is above. One row per source; the windows below run over sources, not over documents."""
    totals = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"))
    # Spark orders texts by their UTF-8 bytes, which is code point order
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    kind = (F.col("_number") % len(weights)).alias("class")
    rated = totals.withColumn("_number", number).select(
        "source", "source_size", kind, F.element_at(F.array(*map(F.lit, weights)), (F.col("_number") % len(weights) + 1).cast("int")).alias("weight")
    )
    order = [(F.col("source_size") * cap / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # a source is capped when the level that those from it on could share lies above its cap
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * cap).over(upto), F.lit(0))) / F.sum("weight").over(onward)
    levelled = rated.withColumn("_level", level).withColumn("_free", F.col("source_size") * cap / F.col("weight") > F.col("_level"))
    at = F.max(F.when(F.col("_free"), F.col("_level"))).over(everything)
    return levelled.select(
        "source", "class", "source_size",
        F.when(F.col("_free"), F.col("weight") * at).otherwise((F.col("source_size") * cap).cast("double")).alias("target"),
    )


def cumulative(sizes: DataFrame) -> DataFrame:
    """Adds _before: the words of the same source that come before, in an order fixed by a hash of doc_id.

    Three levels of hash buckets keep every window small whatever the source's share of the rows.
    """
    hashed = sizes.withColumn("_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    hashed = hashed.withColumn("_b1", F.substring("_hash", 1, 2)).withColumn("_b2", F.substring("_hash", 3, 2))
    second = hashed.groupBy("source", "_b1", "_b2").agg(F.sum("_size").alias("_sum"))
    first = second.groupBy("source", "_b1").agg(F.sum("_sum").alias("_sum"))
    before = lambda w: F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.select("source", "_b1", before(Window.partitionBy("source").orderBy("_b1")).alias("_base1"))
    second = second.select("source", "_b1", "_b2", before(Window.partitionBy("source", "_b1").orderBy("_b2")).alias("_base2"))
    bases = second.alias("s").join(first.alias("f"), F.expr("s.source <=> f.source AND s._b1 <=> f._b1")).select("s.source", "s._b1", "s._b2", (F.col("_base1") + F.col("_base2")).alias("_base"))
    within = Window.partitionBy("source", "_b1", "_b2").orderBy("_hash", "doc_id", "_row").rowsBetween(Window.unboundedPreceding, -1)
    inner = hashed.withColumn("_inner", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    joined = inner.alias("d").join(bases.alias("b"), F.expr("d.source <=> b.source AND d._b1 <=> b._b1 AND d._b2 <=> b._b2"))
    return joined.select("d.*", "_base").withColumn("_before", F.col("_base") + F.col("_inner")).drop("_b1", "_b2", "_base", "_inner", "_hash")


def position(share: F.Column, kind: F.Column, schedules=SCHEDULES) -> F.Column:
    """Training time at which a source's cumulative demand reaches a share of its whole: the schedule's integral, inverted.

    Between two knots the demand is a quadratic, which has one root in the segment.
    """
    found = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        step = 1.0 / (len(knots) - 1)
        areas = [(a + b) / 2 * step for a, b in zip(knots, knots[1:])]
        begun = 0.0
        at = F.lit(1.0)
        pieces = []
        for i, area in enumerate(areas):
            pieces.append((begun, area, knots[i], knots[i + 1], i * step))
            begun += area
        for start, area, a, b, t in reversed(pieces):
            rest = F.least(F.greatest(share * begun - start, F.lit(0.0)), F.lit(area))
            slope = (b - a) / step
            root = rest / a if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + 2 * slope * rest, F.lit(0.0))) - a) / slope
            at = F.when(share * begun <= start + area, t + root).otherwise(at)
        found = F.when(kind == k, at).otherwise(found)
    return found


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, schedules=SCHEDULES) -> DataFrame:
    """(doc_id, source, _row, size, source_size, target, taken, position) of every document, range-sorted by position.

    Every document is taken floor(target / source_size) times whole; the first documents of the source's order are taken once
    more until the target is met, the last of them in part. So each source takes its target rounded to words, and no document
    more than cap times its size. Rows that repeat are documents of their own; their order among themselves is by text hash
    and otherwise immaterial, as they are equal. Null ids and sources are values like others; empty texts take nothing.
    """
    sizes = stored(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "_size", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_row")), "sizes")
    targets = source_targets(sizes, weights, share, cap)
    placed = cumulative(sizes).alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).select("d.*", "class", "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    extra = F.round(F.col("target") - rate * F.col("source_size")).cast("long")
    part = F.least(F.greatest(extra - F.col("_before"), F.lit(0)), F.col("_size"))
    done = F.when(F.col("source_size") > 0, F.col("_before") / F.col("source_size")).otherwise(0.0)
    return placed.select(
        "doc_id", "source", "_row", F.col("_size").alias("size"), "source_size", "target",
        (rate * F.col("_size") + part).cast("long").alias("taken"), position(done, F.col("class"), schedules).alias("position"),
    ).repartitionByRange(F.col("position"), F.col("doc_id")).sortWithinPartitions("position", "doc_id")


def mix_rows(docs: DataFrame, **parameters) -> DataFrame:
    """The documents of the mix with all their columns, as often as they are taken, in training order.

    Texts stay whole: a document taken in part counts as one more copy when half of it or more is taken.
    """
    plan = mixed_documents(docs, **parameters)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + F.lit(0.5))).otherwise(0).cast("int")
    # rows that repeat share an id and a text: one row of the plan stands for each of them, with the larger count
    plan = plan.groupBy("doc_id", "source", "_row").agg(F.max(copies).alias("copies"), F.min("position").alias("at")).where("copies > 0").alias("p")
    whole = docs.select("doc_id", "source", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_row"), F.struct(*docs.columns).alias("doc")).alias("d")
    joined = whole.join(plan, F.expr("d.doc_id <=> p.doc_id AND d.source <=> p.source AND d._row = p._row")).select("d.doc", "p.copies", "p.at")
    repeated = joined.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("at", F.col("at") + F.col("copy") / F.col("copies") * (1 - F.col("at")))
    return repeated.repartitionByRange("at", "doc.doc_id").sortWithinPartitions("at", "doc.doc_id").select("doc.*")
