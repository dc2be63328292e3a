"""Hard negatives by angular triangle filtering.

Every row stores its norm and its angles to a few reference directions. Two rows at angles s and t to a reference are at least |s - t|
and at most s + t apart, so each reference gives an interval of their cosine; the intersection over the references, times both
norms and widened for rounding, bounds their score. Only pairs whose bounds reach a window of scores that is asked for are scored,
in whole numbers.

Rows stand in order of label, nearest reference and angle, packed into blocks of bounded size, the anchors too. A pair of blocks is
scored as a whole in one task, and left out where the bounds of the two blocks reach no window. Per anchor each pair of blocks
hands on only the first few rows of each window, so what is gathered for an anchor grows with the number of blocks, not of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Positives of an anchor, negatives of a positive, and the window of a negative's score, as hundredths of the positive's.
POSITIVES, NEGATIVES, WINDOW = 5, 3, (50, 95)
#: Reference directions; rows they are chosen among, a bounded sample in the order of their hashes.
REFERENCES, CHOSEN_AMONG = 8, 512
#: Rows of a block and anchors of a block of anchors, pairs of blocks of a task, anchors whose bounds are worked out at once.
ROWS, ANCHORS, PAIRS_OF_A_TASK, STRIP = 4096, 1024, 4, 64
#: Bounds are widened by this share of the norms' product: over twice what angles stored in single precision are off.
SLACK = 2e-6

BLOCK = "uid array<long>, id binary, named binary, label binary, vector binary, norm binary, angles binary"
_BLOCK_SCHEMA = (
    f"block long, dim int, n int, low_label long, high_label long, low_norm double, high_norm double, low_angles array<double>, high_angles array<double>, {BLOCK}"
)
_BLOCK_ARROW = pa.schema(
    [("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("low_label", pa.int64()), ("high_label", pa.int64()), ("low_norm", pa.float64()), ("high_norm", pa.float64())]
    + [("low_angles", pa.list_(pa.float64())), ("high_angles", pa.list_(pa.float64()))]
    + [(c.split()[0], pa.binary() if c.endswith("binary") else pa.list_(pa.int64())) for c in BLOCK.split(", ")]
)


def rounded(vector: Column, scale: int = 256) -> Column:
    """A vector's components times scale, rounded down to whole numbers; null where it or any component is null or not finite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    real = vectors.astype(np.float64)
    norm = np.sqrt((real * real).sum(1))
    return real / np.where(norm > 0, norm, 1)[:, None], norm


def references(rows: DataFrame) -> dict[int, np.ndarray]:
    """Directions by dimension: of a bounded sample, each the one farthest from those before it."""
    sample = rows.select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(CHOSEN_AMONG).collect()
    found: dict[int, np.ndarray] = {}
    for dim in {len(r["vector"]) for r in sample} - {0}:
        units, norm = _unit(np.array([r["vector"] for r in sample if len(r["vector"]) == dim], np.int64).reshape(-1, dim))
        units = units[norm > 0]
        if len(units):
            chosen, near = [0], units @ units[0]
            while len(chosen) < min(REFERENCES, len(units)):
                chosen.append(int(near.argmin()))
                near = np.maximum(near, units @ units[chosen[-1]])
            found[dim] = units[chosen]
    return found


def _directions(known: dict[int, np.ndarray], dim: int) -> np.ndarray:
    """References for a dimension, as many for each; axes where the sample held none."""
    axes = np.eye(max(dim, 1))[:, :dim] if dim else np.zeros((1, 0))
    given = known.get(dim, axes[:1])
    return np.concatenate([given] * (-(-REFERENCES // len(given))))[:REFERENCES]


def _angles(known: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            offsets = column.offsets.to_numpy()
            flat, begins = column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]
            dims = np.diff(begins)
            angles, norms = np.zeros((batch.num_rows, REFERENCES), np.float32), np.zeros(batch.num_rows)
            for dim in np.unique(dims).tolist():
                some = np.flatnonzero(dims == dim)
                units, norms[some] = _unit(flat[begins[some][:, None] + np.arange(dim)])
                angles[some] = np.arccos(np.clip(units @ _directions(known, dim).T, -1, 1))
            near = angles.argmin(1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, angles.size + 1, REFERENCES, dtype=np.int32)), pa.array(angles.ravel()))
            more = [pa.array(dims.astype(np.int32)), pa.array(norms), lists, pa.array(near.astype(np.int32)), pa.array(angles[np.arange(len(near)), near])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "dim", "norm", "angles", "near", "angle"])

    return run


def _packed(size: int):
    """Blocks of at most size consecutive rows of one dimension."""

    def block(number: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        norm, label = batch.column("norm").to_numpy(), batch.column("label").to_numpy()
        angles = batch.column("angles").flatten().to_numpy().reshape(batch.num_rows, REFERENCES)
        ids = batch.column("id")
        values = {
            "uid": batch.column("uid").to_numpy(), "id": ids.fill_null(0).to_numpy(), "named": ids.is_valid().to_numpy(zero_copy_only=False),
            "label": label, "vector": batch.column("vector").flatten().to_numpy(), "norm": norm, "angles": angles,
        }
        row = {
            "block": number, "dim": batch.column("dim")[0].as_py(), "n": batch.num_rows, "low_label": label.min(), "high_label": label.max(), "low_norm": norm.min(),
            "high_norm": norm.max(), "low_angles": angles.min(0).astype(np.float64), "high_angles": angles.max(0).astype(np.float64),
        }
        row |= {k: v if k == "uid" else v.tobytes() for k, v in values.items()}
        return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _BLOCK_ARROW], schema=_BLOCK_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            rows = sum(b.num_rows for b in held)
            if not rows or (batch is not None and rows < size):
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            dims = whole.column("dim").to_numpy()
            first = 0
            while first < rows and (batch is None or rows - first >= size):
                last = min(first + size, rows)
                last = first + int(np.searchsorted(dims[first:last] != dims[first], True))
                yield block(number, whole.slice(first, last - first))
                number, first = number + 1, last
            held = [whole.slice(first)] if first < rows else []

    return run


def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows in order of dimension, label, nearest reference and angle, packed. Neighbouring ranges that are shorter than a block together
    make one, so the number of blocks follows from that of the rows, whatever the number of partitions."""
    keys = ["dim", "label", "near", "angle", "uid"]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).coalesce(max(1, -(-rows.count() // size)))
    return stored(ordered.mapInArrow(_packed(size), _BLOCK_SCHEMA), name)


class _Rows:
    """One packed block."""

    def __init__(self, row: dict, side: str):
        def of(name: str, kind) -> np.ndarray:
            return np.frombuffer(row[f"{side}_{name}"], kind)

        n, dim = row[f"{side}_n"], row["dim"]
        self.uid = np.array(row[f"{side}_uid"], np.int64)
        self.id, self.named, self.label = of("id", np.int64), of("named", bool), of("label", np.int64)
        self.vector, self.norm = of("vector", np.int64).reshape(n, dim), of("norm", np.float64)
        angles = of("angles", np.float32).reshape(n, REFERENCES).astype(np.float64)
        self.cos, self.sin = np.cos(angles), np.sin(angles)
        self.most = max(int(self.vector.max(initial=0)), -int(self.vector.min(initial=0)))

    def name(self, i: int) -> int | None:
        return int(self.id[i]) if self.named[i] else None


def score_bounds(a: _Rows, some: slice, b: _Rows) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scores that the angles leave open, for some rows of a and all of b."""
    least, most = np.full((len(a.norm[some]), len(b.norm)), -1.0), np.full((len(a.norm[some]), len(b.norm)), 1.0)
    for r in range(REFERENCES):
        along = np.multiply.outer(a.cos[some, r], b.cos[:, r])
        across = np.multiply.outer(a.sin[some, r], b.sin[:, r])
        np.maximum(least, along - across, out=least)  # cosine of the sum of angles
        np.minimum(most, along + across, out=most)  # and of their difference
    norms = np.multiply.outer(a.norm[some], b.norm)
    return np.floor((least - SLACK) * norms), np.ceil((most + SLACK) * norms)


def scores(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Inner products of whole numbers of at most `most`, exact."""
    bound = a.shape[1] * most * most
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    product = a.astype(object) @ b.astype(object).T
    if max(map(abs, product.ravel().tolist()), default=0) >= 1 << 63:
        raise OverflowError("a score does not fit into 64 bits")
    return product.astype(np.int64)


def _scored(a: _Rows, b: _Rows, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of a, rows of b, their scores) of the pairs that `wanted(rows of a, least, most)` asks for, a mask by rows of a and b."""
    for first in range(0, len(a.norm), STRIP):
        strip = slice(first, min(first + STRIP, len(a.norm)))
        mask = wanted(strip, *score_bounds(a, strip, b))
        rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
        if not len(rows):
            continue
        found = scores(a.vector[strip][rows], b.vector[columns], max(a.most, b.most))
        for k, i in enumerate(rows.tolist()):
            own = np.flatnonzero(mask[i, columns])
            yield first + i, columns[own], found[k, own]


def _first(b: _Rows, rows: np.ndarray, score: np.ndarray, count: int) -> np.ndarray:
    """The first of the rows by score, ties by id (null last) and row."""
    if len(rows) > 4 * count:  # only those that can be among the first
        least = np.partition(score, len(score) - count)[len(score) - count]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(rows))
    order = np.lexsort((b.uid[rows[some]], b.id[rows[some]], ~b.named[rows[some]], -score[some]))
    return some[order[:count]]


def _positives(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                a, b = _Rows(row, "a"), _Rows(row, "b")
                out: list[tuple] = []

                def wanted(strip: slice, least: np.ndarray, most: np.ndarray) -> np.ndarray:
                    mask = (a.label[strip, None] == b.label[None, :]) & (a.uid[strip, None] != b.uid[None, :])
                    if len(b.norm) > count:  # as many rows score at least this much, so one that cannot reach it is not among them
                        sure = np.partition(np.where(mask, least, -np.inf), len(b.norm) - count, axis=1)[:, len(b.norm) - count]
                        mask &= most >= sure[:, None]
                    return mask

                for i, rows, score in _scored(a, b, wanted):
                    for k in _first(b, rows, score, count):
                        out.append((int(a.uid[i]), a.name(i), int(b.uid[rows[k]]), b.name(rows[k]), int(score[k])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["anchor_uid", "anchor_id", "uid", "positive_id", "positive_score"])

    return run


def _negatives(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                a, b = _Rows(row, "a"), _Rows(row, "b")
                begins = np.frombuffer(row["a_begins"], np.int64)
                low, high, places = (np.frombuffer(row[f"a_{x}"], np.int64) for x in ("low", "high", "places"))
                out: list[tuple] = []

                def wanted(strip: slice, least: np.ndarray, most: np.ndarray) -> np.ndarray:
                    mask = np.zeros(least.shape, bool)
                    for k, i in enumerate(range(strip.start, strip.stop)):
                        for w in range(begins[i], begins[i + 1]):
                            mask[k] |= (most[k] >= low[w]) & (least[k] <= high[w])
                    return mask & (a.label[strip, None] != b.label[None, :])

                for i, rows, score in _scored(a, b, wanted):
                    for w in range(begins[i], begins[i + 1]):
                        inside = np.flatnonzero((score >= low[w]) & (score <= high[w]))
                        for k in inside[_first(b, rows[inside], score[inside], count)].tolist():
                            out.append((int(a.uid[i]), int(places[w]), int(b.uid[rows[k]]), b.name(rows[k]), int(score[k])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["anchor_uid", "place", "uid", "negative_id", "negative_score"])

    return run


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def _paired(anchors: DataFrame, rows: DataFrame, condition: Column) -> DataFrame:
    """Pairs of blocks of one dimension (columns a_*, b_*) that meet the condition, dealt evenly over tasks.

    Summaries of the blocks meet first: those of rows are dealt to lanes, so that no task holds all of them.
    """
    summary = ["block", "low_label", "high_label", "low_norm", "high_norm", "low_angles", "high_angles"]
    side = lambda df, x, columns: df.select("dim", *(F.col(c).alias(f"{x}_{c}") for c in columns))
    windows = [c for c in ("least", "greatest") if c in anchors.columns]
    lanes = max(1, rows.count() // 256)
    left = side(anchors, "a", summary + windows).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    right = side(rows, "b", summary).withColumn("lane", F.pmod(F.xxhash64("b_block"), F.lit(lanes)).cast("int"))
    pairs = stored(left.join(right, ["dim", "lane"]).where(condition).select("a_block", "b_block"), "pairs")
    tasks = -(-pairs.count() // PAIRS_OF_A_TASK)
    held = [c.split()[0] for c in BLOCK.split(", ")]
    more = [c for c in ("begins", "low", "high", "places") if c in anchors.columns]
    both = pairs.join(side(anchors, "a", ["block", "n", *held, *more]), "a_block").join(side(rows, "b", ["block", "n", *held]).drop("dim"), "b_block")
    return both.repartition(max(tasks, 1), "a_block", "b_block")


def _reaches() -> Column:
    """Whether a pair of rows of two blocks may score within the least and the greatest bound asked for: the triangle filter on what
    the blocks span."""
    spans = F.arrays_zip("a_low_angles", "a_high_angles", "b_low_angles", "b_high_angles")
    apart = F.transform(spans, lambda s: F.greatest(F.lit(0.0), s["a_low_angles"] - s["b_high_angles"], s["b_low_angles"] - s["a_high_angles"]))
    # the cosine falls up to pi and rises again behind it
    both = F.transform(spans, lambda s: F.least(F.lit(float(np.pi)), s["a_high_angles"] + s["b_high_angles"]))
    most, least = F.cos(F.array_max(apart)) + SLACK, F.cos(F.array_min(both)) - SLACK
    high, low = F.col("a_high_norm") * F.col("b_high_norm"), F.col("a_low_norm") * F.col("b_low_norm")
    top = F.ceil(most * F.when(most >= 0, high).otherwise(low))
    bottom = F.floor(least * F.when(least >= 0, low).otherwise(high))
    return (top >= F.col("a_least")) & (bottom <= F.col("a_greatest"))


def _with_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of anchors with the windows of their rows: where each row's begin, and their bounds."""
    for batch in batches:
        for row in _each(batch):
            own = {x["uid"]: x["windows"] for x in row["asked"]}
            lists = [own.get(u, []) for u in row["uid"]]
            begins = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            low, high, places = (np.array([w[k] for x in lists for w in x], np.int64) for k in ("low", "high", "place"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"]], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (begins, low, high, places)), pa.array([low.min()], pa.int64()), pa.array([high.max()], pa.int64())],
                names=["block", "begins", "low", "high", "places", "least", "greatest"],
            )


def mined(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, label, vector), vectors of whole numbers.

    A score is the inner product of two vectors; higher ones come first, ties by smaller vec_id, null last. An anchor's positives are
    the first other rows of its label; to each belong the first rows of other labels whose score is between window[0] and
    window[1] hundredths of the positive's (none where that is negative), ranked from 1.

    Rows with a null label or vector take no part. Rows that repeat, or share a vec_id, are rows of their own, also as anchors;
    a null vec_id is no anchor unless the condition says so. Vectors of different lengths do not meet; a zero or empty vector
    scores 0. A score beyond 64 bits raises OverflowError. No rows, anchors or negatives give no row.
    """
    sound = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull())
    taken = sound.select(
        F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector",
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    taken = stored(taken, "rows")
    schema = "uid long, id long, label long, vector array<long>, anchor boolean, dim int, norm double, angles array<float>, near int, angle float"
    placed = stored(taken.mapInArrow(_angles(references(taken)), schema), "angles")
    every = blocks(placed.drop("anchor"), ROWS, "blocks")
    asked = blocks(placed.where("anchor").drop("anchor"), ANCHORS, "anchors")

    alike = (F.col("a_low_label") <= F.col("b_high_label")) & (F.col("b_low_label") <= F.col("a_high_label"))
    found = _paired(asked, every, alike).mapInArrow(_positives(positives), "anchor_uid long, anchor_id long, uid long, positive_id long, positive_score long")
    first = lambda keys, score, name: Window.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last(name), "uid")
    ranked = found.withColumn("place", F.row_number().over(first(["anchor_uid"], "positive_score", "positive_id"))).where(F.col("place") <= positives)
    chosen = stored(ranked.withColumnRenamed("uid", "positive_uid"), "positives")

    score = F.col("positive_score")
    # hundredths in whole numbers, without passing 64 bits
    low = F.expr("positive_score div 100") * window[0] + F.ceil(score % 100 * window[0] / 100)
    high = F.expr("positive_score div 100") * window[1] + F.floor(score % 100 * window[1] / 100)
    windows = chosen.where(score >= 0).groupBy("anchor_uid").agg(F.array_sort(F.collect_list(F.struct("place", low.alias("low"), high.alias("high")))).alias("windows"))
    # each anchor's place among the blocks; a block holds a bounded number of anchors, an anchor of windows
    members = asked.select("block", F.explode("uid").alias("anchor_uid")).join(windows, "anchor_uid")
    of_block = members.groupBy("block").agg(F.collect_list(F.struct(F.col("anchor_uid").alias("uid"), "windows")).alias("asked"))
    bound = asked.select("block", "uid").join(of_block, "block").mapInArrow(_with_windows, "block long, begins binary, low binary, high binary, places binary, least long, greatest long")
    open_ = stored(asked.join(bound, "block"), "windows")

    unlike = ~((F.col("a_low_label") == F.col("a_high_label")) & (F.col("b_low_label") == F.col("b_high_label")) & (F.col("a_low_label") == F.col("b_low_label")))
    met = _paired(open_, every, unlike & _reaches()).mapInArrow(_negatives(negatives), "anchor_uid long, place long, uid long, negative_id long, negative_score long")
    order = first(["anchor_uid", "place"], "negative_score", "negative_id")
    kept = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).drop("uid")
    return kept.join(chosen, ["anchor_uid", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
