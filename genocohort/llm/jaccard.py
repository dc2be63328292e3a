"""N-gram Jaccard join by rare-first prefix filtering.

Texts are sets of hashed word shingles. All sets are put in one global order, rarest shingle first, by a count sketch over all
documents. Two sets that are similar enough share a shingle among the first few of either (the prefix), so pairs meet on prefix
shingles, pass length, positional and suffix filters, and are verified once on whole sets.

Equal sets are one class. Within the documents of a prefix shingle, all first meet one of them, the leader; then only those
meet each other whose classes are not yet connected: no link that joins two components is lost, and a thousand near
copies of one text do not meet in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .graphs import components
from .shared import lean, may_hold, membership_filter, removed, stored
from .words import SPACED, lower, mixed, pieces, prefix_codes, span_codes, word_spans

#: Words of a shingle, and the similarity as a fraction. A contract may give others.
WORDS, SHARE = 5, (80, 100)
#: Bytes of text cut into shingles at once.
AT_ONCE = 1 << 17
#: A text without words.
WORDLESS = r"^[\x20\x09-\x0D]*\z"
#: Cells of the count sketch (fixed size) and of a set's histogram for the suffix filter.
SKETCH_CELLS, HISTOGRAM = 1 << 22, 64
_SKETCH_PART = 1 << 14
#: A histogram's count that stands for itself and all above.
FULL = 2**15 - 1


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes of all texts, each text's distinct and sorted, and where each text's begin)."""
    for first, data, offsets in pieces(column, AT_ONCE):
        data = lower(data)
        starts, ends, firsts = word_spans(data, offsets, SPACED)
        codes = span_codes(prefix_codes(data), starts, ends)
        n = np.diff(firsts)
        own = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(codes)) - firsts[:-1][own]
        length = np.minimum(n, words)[own]  # of the shingle: all words, where there are fewer
        held = place <= n[own] - length
        shingles = np.zeros(len(codes), np.uint64)
        padded = np.concatenate([codes, np.zeros(words, np.uint64)])
        for k in range(words):
            shingles = np.where(k < length, mixed(shingles * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(codes)]), shingles)
        shingles, own = shingles[held], own[held]
        order = np.lexsort((shingles, own))
        shingles, own = shingles[order], own[order]
        if len(own):
            new = np.concatenate([[True], (shingles[1:] != shingles[:-1]) | (own[1:] != own[:-1])])
            shingles, own = shingles[new], own[new]
        yield first, shingles, np.searchsorted(own, np.arange(len(n) + 1))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sum_by(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return upto[begins[1:]] - upto[begins[:-1]]


def _keys(shingles: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set: equal sets have equal keys."""
    twice = [_sum_by(mixed(shingles + np.uint64(salt)), begins) for salt in (1, 2)]
    return mixed(twice[0] + mixed(twice[1] + np.diff(begins).astype(np.uint64)))


_MARKS = "doc_id long, n long, key long, part int, cells binary, counts binary"
_MARKS_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("part", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])


def _marked(words: int):
    """Size and key of each text's set; then, without doc_id and set, what the task adds to each part of the sketch: all counts, or,
    where most are 0, the others with their cells."""

    def padded(length: int, known: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([known.get(f.name, pa.nulls(length, f.type)) for f in _MARKS_ARROW], schema=_MARKS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH_CELLS, np.int32)
        for batch in batches:
            for first, shingles, begins in _sets(batch.column(1), words):
                n = np.diff(begins)
                yield padded(len(n), {"doc_id": batch.column(0).slice(first, len(n)), "n": pa.array(n), "key": _signed(_keys(shingles, begins))})
                cells, times = np.unique((shingles & np.uint64(SKETCH_CELLS - 1)).astype(np.int64), return_counts=True)
                counts[cells] += times.astype(np.int32)
        for part, own in enumerate(counts.reshape(-1, _SKETCH_PART)):
            some = np.flatnonzero(own)
            if len(some):
                dense = 2 * len(some) > len(own)
                held = (b"", own.tobytes()) if dense else (some.astype(np.int32).tobytes(), own[some].tobytes())
                yield padded(1, {"part": pa.array([part], pa.int32()), "cells": pa.array(held[:1], pa.binary()), "counts": pa.array(held[1:], pa.binary())})

    return lean(run)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
            own = sums.setdefault(part, np.zeros(_SKETCH_PART, np.int64))
            where = np.frombuffer(cells, np.int32) if cells else slice(None)
            own[where] += np.frombuffer(counts, np.int32)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])


def frequency_sketch(marks: DataFrame) -> np.ndarray:
    """How many documents' shingles fall into each cell, over all documents: fixed size, added up by parts."""
    parts = marks.where("part IS NOT NULL").select("part", "cells", "counts").repartition("part").mapInArrow(_summed, "part int, counts binary")
    counts = np.zeros((SKETCH_CELLS // _SKETCH_PART, _SKETCH_PART), np.int32)
    for row in parts.collect():
        counts[row["part"]] = np.frombuffer(row["counts"], np.int32)
    return counts.ravel()


def _prefixes(words: int, share: tuple[int, int], sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = sketch.value
        for batch in batches:
            for first, shingles, begins in _sets(batch.column(0), words):
                n = np.diff(begins)
                own = np.repeat(np.arange(len(n)), n)
                rate = frequency[(shingles & np.uint64(SKETCH_CELLS - 1)).astype(np.int64)]
                order = np.lexsort((shingles, rate, own))
                shingles, rate = shingles[order], rate[order]
                # sets of n share at least share * n with any similar one: of the first n - that + 1, one is shared
                length = np.where(n > 0, n - (-(-share[0] * n // share[1])) + 1, 0)
                place = np.arange(len(shingles)) - begins[:-1][own]
                kept = place < length[own]
                cells = np.bincount(own * HISTOGRAM + (shingles >> np.uint64(32)).astype(np.int64) % HISTOGRAM, minlength=len(n) * HISTOGRAM)
                weight = _sum_by(rate.astype(np.uint64), begins) / np.maximum(n, 1)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), _signed(shingles[kept]))
                histogram = pa.ListArray.from_arrays(pa.array(np.arange(0, len(n) * HISTOGRAM + 1, HISTOGRAM, dtype=np.int32)), pa.array(np.minimum(cells, FULL).astype(np.int16)))
                yield pa.RecordBatch.from_arrays([_signed(_keys(shingles, begins)), pa.array(n), pa.array(weight), tokens, histogram], names=["key", "n", "weight", "tokens", "histogram"])

    return lean(run)


def _sets_of(words: int, members):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, shingles, begins in _sets(batch.column(0), words):
                keys = _keys(shingles, begins)
                lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), _signed(shingles))
                kept = np.flatnonzero(may_hold(members.value, keys))
                yield pa.RecordBatch.from_arrays([_signed(keys[kept]), lists.take(pa.array(kept))], names=["key", "shingles"])

    return lean(run)


def _entries(common):
    """(set, its size, weight, place, token) of the prefix tokens that the filter of common ones may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            flat, offsets = tokens.flatten().to_numpy(zero_copy_only=False), tokens.offsets.to_numpy()
            begins = offsets - offsets[0]
            kept = np.flatnonzero(may_hold(common.value, flat.view(np.uint64)))
            own = np.searchsorted(begins, kept, "right") - 1
            rows = pa.array(own)
            columns = [batch.column(c).take(rows) for c in ("key", "n", "weight")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((kept - begins[own]).astype(np.int32)), pa.array(flat[kept])], names=["a", "na", "weight", "ia", "token"])

    return lean(run)


def _needed(share: tuple[int, int]) -> F.Column:
    """Shingles that two sets of na and nb must share: 100 * i >= s * (na + nb - i)."""
    return F.ceil((F.col("na") + F.col("nb")) * share[0] / F.lit(float(share[0] + share[1])) - F.lit(1e-9))


def _filtered(pairs: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Length filter, and the positional one: were the shingle at places ia and ib the first that both have, they could share
    it and what follows. A pair that is similar enough passes with its first common shingle, so the others need not."""
    rest = 1 + F.least(F.col("na") - F.col("ia") - 1, F.col("nb") - F.col("ib") - 1)
    long_enough = F.least("na", "nb") * share[1] >= F.greatest("na", "nb") * share[0]
    return pairs.where(long_enough & (rest >= _needed(share))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _possible(pairs: DataFrame, prefixes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The distinct pairs (a, b) that pass the suffix filter: what the histograms of their sets can share at most."""
    side = lambda x: prefixes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("histogram").alias(f"h{x}"))
    shared = F.zip_with("ha", "hb", lambda x, y: F.when(F.least(x, y) < FULL, F.least(x, y).cast("long")).otherwise(F.least("na", "nb")))
    most = F.aggregate(shared, F.lit(0).cast("long"), lambda s, x: s + x)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(most >= _needed(share)).select("a", "b", "na", "nb")


def _verified(pairs: DataFrame, text: DataFrame, words: int, share: tuple[int, int], places: list[str]) -> DataFrame:
    """The linked ones of pairs (a, b), by their whole sets, which are read for the documents of these pairs only."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    members = text.sparkSession.sparkContext.broadcast(membership_filter(keys))
    sets = text.mapInArrow(_sets_of(words, members), "key long, shingles array<long>").dropDuplicates(["key"])
    sets = stored(sets, "sets", own := [])
    of = lambda x: sets.select(F.col("key").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    links = stored(both.where(F.size(F.array_intersect("sa", "sb")) >= _needed(share)).select("a", "b"), "links", places)
    removed(text.sparkSession, own)
    members.destroy()
    return links


def set_roots(docs: DataFrame, marks: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """(node, root) of every set key that is linked with another: the smallest key reachable by links."""
    text = docs.select("text")
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(marks))
    prefixes = text.mapInArrow(_prefixes(words, share, sketch), "key long, n long, weight double, tokens array<long>, histogram array<smallint>")
    places: list[str] = []
    keep = lambda df, name: stored(df, name, places)
    prefixes = keep(prefixes.where("n > 0").dropDuplicates(["key"]), "prefixes")
    sketch.destroy()

    # most prefix shingles are of one set: they are counted alone, and only the others move with their sets
    counts = prefixes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("sets"))
    common = docs.sparkSession.sparkContext.broadcast(membership_filter(keep(counts.where("sets > 1").select("token"), "common")))
    entries = prefixes.select("key", "n", "weight", "tokens").mapInArrow(_entries(common), "a long, na long, weight double, ia int, token long")
    # the leader is the set whose shingles are the most common ones: the text that its near copies were made from
    leader = F.max(F.struct("weight", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("ia").alias("ib"))).alias("leader")
    leaders = entries.groupBy("token").agg(leader, F.count("*").alias("sets")).where("sets > 1")
    shared = keep(entries.join(leaders, "token").select("token", "a", "na", "ia", "leader.b", "leader.nb", "leader.ib"), "entries")
    met = keep(_filtered(shared.where("a <> b"), share), "pairs")
    links = _verified(keep(_possible(met, prefixes, share), "pairs"), text, words, share, places)
    roots = components(links)
    # sets of one shingle that are not connected yet
    labelled = shared.select("token", "a", "na", "ia").join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    apart = labelled.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    open_ = keep(labelled.join(apart, "token", "left_semi"), "apart")
    other = open_.select("token", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("ia").alias("ib"), F.col("root").alias("root_b"))
    rest = _filtered(open_.join(other, "token").where("root < root_b"), share).join(met, ["a", "b"], "left_anti")
    more = _verified(keep(_possible(rest, prefixes, share), "pairs"), text, words, share, places)
    found = components(links.unionAll(more))
    removed(docs.sparkSession, places)
    return found


def _all_marks(docs: DataFrame, words: int) -> DataFrame:
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_marked(words), _MARKS), "marks")


def joined(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text); doc_id is cast to long.

    Words are runs of other characters than white space, A-Z lower-cased; a text with fewer words than a shingle is one shingle,
    a text without words (or null) the empty set, linked with nothing. Two documents are linked when the share of common
    shingles among all of theirs is at least `share`; component_id is the smallest doc_id reachable by links. Documents
    with equal sets are linked, rows that repeat too. A null doc_id is never the smallest unless there is no other. Shingles
    and sets go by 64-bit hashes.
    """
    held = _all_marks(docs, words)
    roots = set_roots(docs, held, words, share).withColumnRenamed("node", "key")
    marks = held.where("part IS NULL").select("doc_id", "n", "key")
    rooted = marks.where("n > 0").join(roots, "key", "left").select("doc_id", "n", "key", F.coalesce("root", "key").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    found = rooted.join(smallest, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionAll(marks.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _keyed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, shingles, begins in _sets(batch.column(1), words):
                n = np.diff(begins)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n)), pa.array(n), _signed(_keys(shingles, begins))], names=["row", "n", "key"])

    return lean(run)


def one_of_each_group(docs: DataFrame, words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """The documents, with their columns, that stand for their component: one row of each, that of the smallest doc_id (null last, then
    by set).

    Rows are grouped by their texts alone: rows that share a doc_id but differ in text are documents of their own, rows without
    doc_id are grouped like any others. Texts without words are linked with nothing and stay.
    """
    held = _all_marks(docs, words)
    roots = set_roots(docs, held, words, share).withColumnRenamed("node", "key")
    marks = held.where("part IS NULL AND n > 0").select("doc_id", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    # of a component, each task hands on one row; a null id is the last
    rows = marks.groupBy("root", "doc_id", "key").agg(F.count("*").alias("copies"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key", "copies"))
    chosen = stored(rows.groupBy("root").agg(least.alias("m")).select("m.key", F.col("m.doc_id").alias("id"), "m.copies"), "chosen")
    row = StructType([StructField("row", docs.schema), StructField("n", LongType()), StructField("key", LongType())])

    def of(some: DataFrame) -> DataFrame:
        keyed = docs.select(F.struct("*").alias("row"), "text").mapInArrow(_keyed(words), row).where("n > 0")
        return keyed.join(some, (keyed["key"] == some["key"]) & F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")), "left_semi")

    # texts move once: the rows of a chosen set and id; where there are several, one of them stays
    kept = of(chosen.where("copies = 1")).select("row.*")
    several = chosen.where("copies > 1")
    if not several.isEmpty():
        one = of(several).withColumn("id", F.col("row.doc_id").cast("long")).dropDuplicates(["key", "id"])
        kept = kept.unionByName(one.select("row.*"))
    return kept.unionByName(docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(WORDLESS)))
