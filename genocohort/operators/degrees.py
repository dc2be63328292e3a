"""Equi joins planned by the degree of each key.

A position may be listed by nearly all scores and called in nearly all samples: its output is the product of the two, far more than
either side shows. So both degrees are counted first. The listed side is folded to one row per key, an array of what it lists, in
several rows where the list is long; the other side's rows of a key are salted into as many parts as the product needs, and the lists,
which are few, are repeated for them. What a task gets is then bounded by output, not by input rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Joined rows that one (key, list, salt) makes, at most, and entries of one list.
PAIRS_OF_A_PART = 1 << 18
ENTRIES_OF_A_LIST = 4096
#: Partitions of the join for each of the session's shuffle partitions. The two sides are small against what they make: Spark would deal
#: them by their bytes, into a few tasks whose sums do not fit in memory.
PARTS_FOR_OUTPUT = 4


def degrees(many: DataFrame, listed: DataFrame, on: Sequence[str], pairs: int = PAIRS_OF_A_PART, entries: int = ENTRIES_OF_A_LIST) -> DataFrame:
    """(on, _n_listed, _n_many, _lists, _salts) of the keys that both sides have: how often either side has the key, into how many lists
    the listed side is folded, and into how many salts the other side's rows of a list are spread."""
    keys = list(on)
    both = listed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_listed")).join(many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_many")), keys)
    lists = F.ceil(F.col("_n_listed") / entries)
    salts = F.ceil(F.ceil(F.col("_n_listed") / lists) * F.col("_n_many") / pairs)
    return both.withColumn("_lists", lists.cast("int")).withColumn("_salts", F.greatest(salts, F.lit(1)).cast("int"))


def degree_lists(
    many: DataFrame, listed: DataFrame, on: Sequence[str], spread: Sequence[str], split: Sequence[str], pairs: int = PAIRS_OF_A_PART, entries: int = ENTRIES_OF_A_LIST,
    apart: Sequence[str] = (), fold: Callable[[Column], dict[str, Column]] = lambda found: {"_entries": found}, settled: bool = False,
) -> DataFrame:
    """Inner join of ``many`` with ``listed`` on equal keys, the listed side still folded: rows of ``many`` with lists of structs ``_entries``.
    ``spread``: columns of ``many`` that tell its rows of a key apart; ``split``: columns of ``listed`` that tell its entries apart. Salts
    are hashes of them, so a task that runs again deals alike. ``apart``: columns of ``listed`` that all entries of a list have in common,
    given beside it. ``fold``: the columns to make of a list, once for all rows that it meets. ``settled``: both sides are files, of which
    the degrees are taken at once, and known when the join is planned."""
    keys = list(on)
    planned = degrees(many, listed, keys, pairs, entries)
    if settled:
        planned = written(planned, "degrees")
    rest = [c for c in listed.columns if c not in keys and c not in apart]
    folded = (
        listed.join(planned.select(*keys, "_lists", "_salts"), keys)
        .withColumn("_list", F.pmod(F.xxhash64(*split), F.col("_lists")).cast("int"))
        .groupBy(*keys, "_list", *apart)
        .agg(F.collect_list(F.struct(*rest)).alias("_found"), F.first("_salts").alias("_salts"))
    )
    made = fold(F.col("_found"))
    folded = folded.select(*keys, "_list", *apart, "_salts", *[x.alias(c) for c, x in made.items()]).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    ).drop("_salts")
    # few keys need more than one part: Spark broadcasts them if they are small, which it sees of files
    hot = planned.where((F.col("_lists") > 1) | (F.col("_salts") > 1)).select(*keys, "_lists", "_salts")
    if settled:
        hot = written(hot, "hot-keys")
    one = F.lit(1)
    dealt = (
        many.join(hot, keys, "left")
        .withColumn("_list", F.explode(F.sequence(F.lit(0), F.coalesce("_lists", one) - 1)))
        .withColumn("_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_salts", one)).cast("int"))
        .drop("_lists", "_salts")
    )
    meet = [*keys, "_list", "_salt"]
    parts = PARTS_FOR_OUTPUT * int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *meet).join(folded.repartition(parts, *meet), meet).select(*many.columns, *apart, *made)


def degree_join(
    many: DataFrame, listed: DataFrame, on: Sequence[str], spread: Sequence[str], split: Sequence[str], pairs: int = PAIRS_OF_A_PART, entries: int = ENTRIES_OF_A_LIST
) -> DataFrame:
    """Inner join of ``many`` with ``listed`` on equal keys, a row for every pair; for the parameters see ``degree_lists``."""
    rest = [c for c in listed.columns if c not in on]
    joined = degree_lists(many, listed, on, spread, split, pairs, entries)
    return joined.withColumn("_entry", F.explode("_entries")).select(*many.columns, *[F.col(f"_entry.{c}").alias(c) for c in rest])


def packed(values: Column, low: int, name: str = "_id") -> dict[str, Column]:
    """A list of whole numbers as ``low`` lists of their lowest bytes and one of the rest. A shuffle's compression drops equal runs only
    of four bytes and more: the rest, mostly equal, costs next to nothing then, and a number no more than the bytes that tell it apart."""
    byte = lambda k: F.transform(values, lambda x: (F.shiftright(x.cast("bigint"), 8 * k).bitwiseAND(F.lit(255)) - 128).cast("tinyint"))
    return {f"{name}_{k}": byte(k) for k in range(low)} | {f"{name}_rest": F.transform(values, lambda x: F.shiftright(x.cast("bigint"), 8 * low))}


def unpacked(of: Callable[[str], Column], low: int, name: str = "_id") -> Column:
    """The number again, from a function that gives an entry's parts by name."""
    whole = F.shiftleft(of(f"{name}_rest"), 8 * low)
    for k in range(low):
        whole = whole + F.shiftleft(of(f"{name}_{k}").cast("bigint") + 128, 8 * k)
    return whole
