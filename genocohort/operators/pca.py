"""Principal components of a panel by randomised subspace steps over blocks of variants.

The standardised genotypes are shuffled once, to one row a variant, and written. Every step is then one pass without a shuffle: a task
multiplies its blocks of variants with the samples x width matrix, and back, and hands on the sum of its products. That matrix is the
only dense piece; its size is checked against a bound, genotypes never reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ancestry import standardised
from .running import numbered

#: Cells of the samples x width matrix, at most: 128 MB. Variants multiplied at once. Samples of one row of a sum.
MOST_CELLS = 1 << 24
BLOCK = 128
PART = 4096
#: Steps whose results are searched together for the components.
DEPTH = 3


def _times(z: DataFrame, table: DataFrame, on: str, to: str, k: int) -> DataFrame:
    return z.join(table, on).groupBy(to).agg(*[F.sum(F.col("z") * F.col(f"q{j}")).alias(f"q{j}") for j in range(k)])


def standardised_table(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """(sample_id, variant, z) of called genotypes at the given sites."""
    f = sites.select("chrom", "pos", "alt_freq")
    return calls.where(F.col("dosage").isNotNull()).join(f, ["chrom", "pos"]).select(
        "sample_id", F.concat_ws(":", "chrom", F.col("pos").cast("string")).alias("variant"),
        standardised(F.col("dosage"), F.col("alt_freq")).alias("z"),
    ).where(F.col("z").isNotNull())


def variant_rows(z: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variant, at, z): the numbers of the samples with a value, and the values, one row a variant; and (sample_id, _s), the numbers."""
    numbers = cut_lineage(numbered(z, "sample_id", "_s"))
    held = z.join(numbers, "sample_id").groupBy("variant").agg(F.collect_list(F.struct(F.col("_s").cast("int").alias("s"), "z")).alias("_v"))
    return cut_lineage(held.select("variant", F.col("_v.s").alias("at"), F.col("_v.z").alias("z"))), numbers


def _dense(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, variants x samples) of some variants at a time."""
    at, z = batch.column("at"), batch.column("z")
    for first in range(0, batch.num_rows, BLOCK):
        a, v = at.slice(first, BLOCK), z.slice(first, BLOCK)
        block = np.zeros((len(a), n))
        rows = np.repeat(np.arange(len(a)), np.diff(a.offsets.to_numpy()))
        block[rows, a.flatten().to_numpy()] = v.flatten().to_numpy()
        yield first, block


def _there_and_back(q):
    """Sums over a task's variants of z^T z q, in parts of the samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = q.value
        total, seen = np.zeros_like(matrix), False
        for batch in batches:
            for _, block in _dense(batch, len(matrix)):
                total += block.T @ (block @ matrix)
                seen = True
        if seen:
            for part in range(0, len(total), PART):
                yield pa.RecordBatch.from_arrays([pa.array([part // PART], pa.int32()), pa.array([total[part : part + PART].tobytes()], pa.binary())], names=["part", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, own in zip(*(c.to_pylist() for c in batch.columns)):
            sums[part] = sums[part] + np.frombuffer(own) if part in sums else np.frombuffer(own)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "sums"])


def covariance_times(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """z^T z q, of the size of q."""
    sent = rows.sparkSession.sparkContext.broadcast(q)
    parts = rows.select("at", "z").mapInArrow(_there_and_back(sent), "part int, sums binary").repartition("part").mapInArrow(_added, "part int, sums binary").collect()
    sent.destroy()
    out = np.zeros_like(q)
    for row in parts:
        first = row["part"] * PART
        out[first : first + PART] = np.frombuffer(row["sums"]).reshape(-1, q.shape[1])
    return out


def _loadings(q, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, block in _dense(batch, len(q.value)):
                own = block @ q.value
                yield pa.RecordBatch.from_arrays([batch.column("variant").slice(first, len(own)), *(pa.array(own[:, j]) for j in range(k))], names=["variant", *(f"q{j}" for j in range(k))])

    return run


def panel_components(
    z: DataFrame, k: int = 10, rounds: int = 100, tolerance: float = 1e-6, more: int = 10
) -> tuple[DataFrame, DataFrame]:
    """(sample scores q0..qk-1 with unit norm, variant loadings q0..qk-1), largest component first.

    Starts from k + ``more`` random vectors, multiplies them by the covariance (z^T z) DEPTH times, takes the best vectors of all that these
    steps span, and goes on from them until each component u of variance v leaves |z^T z u - v u| within ``tolerance`` of the
    largest variance; raises when ``rounds`` multiplications do not reach that. A random start holds a part of every component, so
    the largest ones come out first. More samples than MOST_CELLS allows raise ValueError.
    """
    rows, numbers = variant_rows(z)
    n = numbers.count()
    width = min(k + more, n)
    if n * width * DEPTH > MOST_CELLS:
        raise ValueError(f"{n} samples times {width * DEPTH} vectors are more than {MOST_CELLS} cells")
    if n < k:
        raise ValueError(f"{n} samples have no {k} components")
    start, _ = np.linalg.qr(np.random.default_rng(n).standard_normal((n, width)))
    done = 0
    while done < rounds:
        basis, images = [start], []
        for step in range(DEPTH):
            images.append(covariance_times(rows, basis[-1]))
            done += 1
            if step + 1 < DEPTH:
                rest = images[-1]
                for _ in range(2):  # twice, as once leaves rounding errors
                    for known in basis:
                        rest = rest - known @ (known.T @ rest)
                q, r = np.linalg.qr(rest)
                alive = np.abs(np.diag(r)) > 1e-10 * max(np.abs(images[0]).max(), 1e-300)
                if not alive.any():
                    break
                basis.append(q[:, alive])
        whole, image = np.hstack(basis), np.hstack(images)
        values, vectors = np.linalg.eigh((whole.T @ image + image.T @ whole) / 2)
        order = np.argsort(values)[::-1][:width]
        best, its_image = whole @ vectors[:, order], image @ vectors[:, order]
        off = np.linalg.norm(its_image[:, :k] - best[:, :k] * values[order][:k], axis=0)
        if off.max() <= tolerance * max(values.max(), 1e-300):
            found = best[:, :k]
            spark = z.sparkSession
            names = ", ".join(f"q{j} double" for j in range(k))
            scores = spark.createDataFrame([(i, *x) for i, x in enumerate(found.tolist())], f"_s long, {names}").join(numbers, "_s").select("sample_id", *(f"q{j}" for j in range(k)))
            return scores, cut_lineage(rows.mapInArrow(_loadings(spark.sparkContext.broadcast(found), k), f"variant string, {names}"))
        start, _ = np.linalg.qr(best)
    raise ArithmeticError(f"the components have not settled after {rounds} products")


def component_errors(z: DataFrame, scores: DataFrame, loadings: DataFrame, k: int) -> DataFrame:
    """(component, variance, norm_error, residual): how far a component's scores are from unit length, and from being an
    eigenvector of the sample covariance, as a share of its variance."""
    spread = loadings.agg(*[F.sum(F.col(f"q{j}") * F.col(f"q{j}")).alias(f"v{j}") for j in range(k)]).first()
    variance = [float(spread[f"v{j}"] or 0.0) for j in range(k)]
    again = _times(z, loadings, "variant", "sample_id", k).select("sample_id", *[F.col(f"q{j}").alias(f"w{j}") for j in range(k)])
    off = lambda j: F.col(f"w{j}") - F.col(f"q{j}") * variance[j]
    sums = scores.join(again, "sample_id").agg(
        *[F.sum(off(j) * off(j)).alias(f"e{j}") for j in range(k)], *[F.sum(F.col(f"q{j}") * F.col(f"q{j}")).alias(f"n{j}") for j in range(k)]
    )
    rows = [
        F.struct(F.lit(j).alias("component"), F.lit(variance[j]).alias("variance"), F.abs(F.col(f"n{j}") - 1).alias("norm_error"), (F.sqrt(f"e{j}") / F.lit(max(variance[j], 1e-300))).alias("residual"))
        for j in range(k)
    ]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def allele_weights(loadings: DataFrame, k: int = 10) -> DataFrame:
    """Loadings with unit norm, signs fixed so that the largest entry is positive."""
    norms = loadings.agg(*[F.sqrt(F.sum(F.col(f"q{j}") * F.col(f"q{j}"))).alias(f"n{j}") for j in range(k)],
                         *[F.max_by(F.col(f"q{j}"), F.abs(F.col(f"q{j}"))).alias(f"s{j}") for j in range(k)]).first()
    scaled = [
        (F.col(f"q{j}") * float((1.0 if (norms[f"s{j}"] or 0) >= 0 else -1.0) / (norms[f"n{j}"] or 1.0))) for j in range(k)
    ]
    parts = F.split("variant", ":")
    return loadings.select(
        parts[0].alias("chrom"), parts[1].cast("bigint").alias("pos"), F.array(*scaled).alias("loadings")
    )
