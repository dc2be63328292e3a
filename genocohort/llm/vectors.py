"""Near-duplicate vectors by collision counting.

Many random projections, each sorted; a query's window in a projection holds the vectors whose value lies near its own. Pairs are
counted over the projections, and those with as many collisions as a pair at the threshold has with high probability are
verified in double precision.

So that counting does not run over all pairs, vectors meet in cells: a table cuts a few further projections into intervals, a cell
is one interval of each, and there are as many tables as the wanted recall takes. Both numbers follow from the number of
vectors and the threshold by the projections' known distribution. Large cells are cut into tiles of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graphs import components
from .shared import stored

#: Cosine of a link.
THRESHOLD = 0.9
#: Share of the pairs exactly at the threshold that meet in a cell, and of those, that pass the count. Nearer pairs fare better.
CELL_RECALL, COUNT_RECALL = 0.96, 0.98
#: Counted projections; unrelated vectors expected beside one in its cell; vectors of one side of a tile.
PROJECTIONS, CELL_MATES, TILE = 32, 256, 512
#: Width of a cell's interval in distances of a pair at the threshold.
WIDTH = 5.0


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def same_interval(width: float) -> float:
    """Chance that two values fall into one interval, its width given in standard deviations of their difference."""
    return 1 - 2 * _phi(-width) - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


@dataclass(frozen=True)
class Plan:
    """What follows from the number of vectors and the threshold."""

    distance: float  # of unit vectors at the threshold
    cuts: int  # projections of a table
    tables: int
    window: float
    least: int  # collisions

    @staticmethod
    def of(n: int, threshold: float) -> Plan:
        distance = math.sqrt(2 - 2 * threshold)
        near = same_interval(WIDTH)
        far = same_interval(WIDTH * distance / math.sqrt(2))
        cuts = max(1, math.ceil(math.log(max(n / CELL_MATES, 1.0)) / -math.log(far)))
        tables = max(1, math.ceil(math.log(1 - CELL_RECALL) / math.log(1 - near**cuts)))
        # a pair at the threshold collides in each projection with this chance: the binomial's quantile is the count asked for
        p = 2 * _phi(1.0) - 1
        below, least = 0.0, 0
        while (below := below + math.comb(PROJECTIONS, least) * p**least * (1 - p) ** (PROJECTIONS - least)) < 1 - COUNT_RECALL:
            least += 1
        return Plan(distance, cuts, tables, distance, least)


def _directions(dim: int, count: int, salt: int) -> np.ndarray:
    return np.random.default_rng([dim, salt]).standard_normal((dim, count))


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def _celled(plan: Plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, some in batch.groupby(batch["vector"].map(len)):
                units = _units(np.array(some["vector"].tolist(), np.float64))
                values = units @ _directions(dim, plan.cuts * plan.tables, 1)
                width = WIDTH * plan.distance
                shift = np.random.default_rng([dim, 2]).random(plan.cuts * plan.tables) * width
                places = np.floor((values + shift) / width).astype(np.int64).reshape(len(some), plan.tables, plan.cuts)
                cells = np.full((len(some), plan.tables), dim, np.int64)
                for k in range(plan.cuts):
                    cells = (cells * 6364136223846793005 + places[:, :, k]) * 2862933555777941757 + 3037000493
                yield pd.DataFrame({"key": some["key"], "copies": some["copies"], "vector": list(units), "cells": list(cells)})

    return run


#: Pairs times projections up to which a tile's windows are laid over all its values at once, without sorting them.
AT_ONCE = 1 << 18


def _collisions(left: np.ndarray, right: np.ndarray, window: float) -> np.ndarray:
    """For each query of left and each row of right the number of projections in which it lies in the query's window."""
    if left.size * len(right) <= AT_ONCE:
        return (np.abs(left[:, None, :] - right[None, :, :]) <= window).sum(2)
    count = np.zeros((len(left), len(right)), np.int16)
    for k in range(left.shape[1]):
        order = np.argsort(right[:, k])
        line = right[order, k]
        rank = np.empty(len(right), np.int32)
        rank[order] = np.arange(len(right))
        low = np.searchsorted(line, left[:, k] - window, "left")[:, None]
        high = np.searchsorted(line, left[:, k] + window, "right")[:, None]
        count += (rank >= low) & (rank < high)
    return count


def _tile_links(plan: Plan, threshold: float, units: np.ndarray, values: np.ndarray, cells: np.ndarray, left: np.ndarray, right: np.ndarray, table: int):
    """Linked pairs (rows of left, rows of right) of a tile that meet in no earlier table; within one block each pair once."""
    a, b = np.nonzero(_collisions(values[left], values[right], plan.window) >= plan.least)
    a, b = left[a], right[b]
    if left is right:
        a, b = a[a < b], b[a < b]
    links = np.zeros(len(a), bool)
    for i in range(0, len(a), 100_000):
        x, y = a[i : i + 100_000], b[i : i + 100_000]
        near = np.einsum("ij,ij->i", units[x], units[y]) >= threshold
        links[i : i + 100_000] = near & ~(cells[x, :table] == cells[y, :table]).any(1)
    return a[links], b[links]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable row of each of n rows of a tile."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _rows(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column and where each row's begin."""
    column = batch.column(name)
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _counted(plan: Plan, threshold: float):
    """Links of the tiles of a sorted partition: (key, its links in a tile, a key that all it reaches there share)."""
    marks = ["table", "cell", "low", "high"]

    def tiles(batch: pa.RecordBatch, borders: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        keys, copies, block, table, low, high = (batch.column(c).to_numpy() for c in ("key", "copies", "block", "table", "low", "high"))
        flat, begins = _rows(batch, "vector")
        marked, _ = _rows(batch, "cells")
        cells = marked.reshape(len(keys), plan.tables)
        for start, end in zip(borders[:-1], borders[1:]):
            if end - start < 2:
                continue
            units = flat[begins[start] : begins[end]].reshape(end - start, -1)
            values = units @ _projections(units.shape[1])
            own = block[start:end]
            left = np.flatnonzero(own == low[start])
            right = left if low[start] == high[start] else np.flatnonzero(own == high[start])
            a, b = _tile_links(plan, threshold, units, values, cells[start:end], left, right, int(table[start]))
            if len(a):
                links = np.bincount(a, copies[start:end][b], end - start) + np.bincount(b, copies[start:end][a], end - start)
                some = np.flatnonzero(links)
                yield keys[start:end][some], links[some].astype(np.int64), keys[start:end][_roots(end - start, a, b)[some]]

    def whole(batch: pa.RecordBatch, last: bool) -> tuple[np.ndarray, int]:
        """Borders of the tiles of a batch, and the row from which on a tile may go on in the next one."""
        ids = [batch.column(c).to_numpy() for c in marks]
        changes = np.zeros(max(batch.num_rows - 1, 0), bool)
        for x in ids:
            changes |= x[1:] != x[:-1]
        borders = np.concatenate([[0], np.flatnonzero(changes) + 1, [batch.num_rows]])
        return (borders, batch.num_rows) if last else (borders[:-1], int(borders[-2]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            borders, rest = whole(batch, last)
            held[:] = [batch.slice(rest)] if rest < batch.num_rows else []
            out = list(tiles(batch, borders))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["key", "links", "near"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from done(last=False)
        if held:
            yield from done(last=True)

    return run


@lru_cache(maxsize=8)
def _projections(dim: int) -> np.ndarray:
    return _directions(dim, PROJECTIONS, 3)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding).

    Vectors with a cosine of at least `threshold` are linked. A vector that is null, empty, zero or has null or non-finite
    components is linked with nothing, so are vectors of different lengths. Equal vectors are one class: they are linked with one
    another and have the same other links. component_id is the smallest vec_id reachable; a null vec_id is the smallest only
    where there is no other. Rows that repeat are vectors of their own.
    """
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    sound &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    marked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(sound, F.lit(False)).alias("sound"))
    marked = marked.withColumn("key", F.when(F.col("sound"), F.xxhash64("embedding")))
    classes = stored(marked.where("sound").groupBy("key").agg(F.first("embedding").alias("vector"), F.count("*").alias("copies")), "vectors")
    plan = Plan.of(classes.count(), threshold)
    celled = stored(classes.mapInPandas(_celled(plan), "key long, copies long, vector array<double>, cells array<long>"), "celled")
    placed = celled.select("key", F.posexplode("cells").alias("table", "cell"))
    blocks = placed.groupBy("table", "cell").agg(F.count("*").alias("n")).where("n > 1").select("table", "cell", F.ceil(F.col("n") / TILE).cast("int").alias("blocks"))
    tiles = (
        celled.select("*", F.posexplode("cells").alias("table", "cell")).join(blocks, ["table", "cell"])
        .withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("table", "cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "copies", "vector", "cells")
    )
    ordered = tiles.repartition("table", "cell", "low", "high").sortWithinPartitions("table", "cell", "low", "high")
    found = stored(ordered.mapInArrow(_counted(plan, threshold), "key long, links long, near long"), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("near").alias("b"))).withColumnRenamed("node", "key")
    rooted = (
        marked.where("sound").select("vec_id", "key").join(classes.select("key", "copies"), "key").join(links, "key", "left").join(roots, "key", "left")
        .select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("root"))
    )
    smallest = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    whole = rooted.join(smallest, "root").select("vec_id", "n_links", "component_id")
    alone = marked.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
