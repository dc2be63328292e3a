"""Hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from genocohort.llm import negatives, queries
from genocohort.llm.shared import shipped
from tests.llm.helpers import empty

SCHEMA = "vec_id long, label int, vector array<long>"


def brute(rows, is_anchor, positives=5, count=3, window=(50, 95)):
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    last = lambda x: (x[0] is None, x[0] or 0)
    out = []
    for i, a in enumerate(rows):
        if not is_anchor(a):
            continue
        scored = [(sum(x * y for x, y in zip(a[2], b[2])), b) for j, b in enumerate(rows) if j != i and len(b[2]) == len(a[2])]
        own = sorted((s for s in scored if s[1][1] == a[1]), key=lambda s: (-s[0], last(s[1])))[:positives]
        for p, b in own:
            fit = sorted((s for s in scored if s[1][1] != a[1] and window[0] * p <= 100 * s[0] <= window[1] * p), key=lambda s: (-s[0], last(s[1])))
            out += [(a[0], b[0], k + 1, c[0], p, s) for k, (s, c) in enumerate(fit[:count])]
    return sorted(out, key=str)


def found(spark, rows, anchor, **more):
    shipped(spark)
    return sorted((tuple(r) for r in negatives.mined(spark.createDataFrame(rows, SCHEMA), anchor, **more).collect()), key=str)


def cloud(seed, n, dim, labels, spread):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, dim))
    return [(i, int(r.integers(labels)), np.floor(40 * (centres[i % 12] + spread * r.standard_normal(dim))).astype(int).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_as_brute_force_over_many_blocks(spark, monkeypatch, spread):
    monkeypatch.setattr(negatives, "ROWS", 32)
    monkeypatch.setattr(negatives, "ANCHORS", 16)
    rows = cloud(1, 400, 8, 3, spread)
    assert found(spark, rows, F.col("vec_id") % 5 == 0) == brute(rows, lambda r: r[0] % 5 == 0)
    assert found(spark, rows, F.col("vec_id") % 5 == 0, positives=2, negatives=7, window=(-20, 80)) == brute(rows, lambda r: r[0] % 5 == 0, 2, 7, (-20, 80))


def test_odd_rows(spark):
    """Nulls, ties, repeated rows, other lengths, zero and empty vectors, and one vector with a third of all rows."""
    rows = cloud(2, 120, 4, 3, 0.3) + [(1000 + i, i % 3, [3, 4, 0, 1]) for i in range(60)]
    rows += [(0, None, [1, 2, 3, 4]), (5, 1, None), (None, 1, [200, 200, 200, 200]), (None, 2, [-90, 100, 100, 90]), (10, 0, [0, 0, 0, 0]), (15, 1, [5, 5]), (20, 1, [4, 6]), (21, 2, [3, 4]), (25, 1, []), (26, 1, []), (27, 2, [])]
    rows += [rows[3], rows[3], rows[125]]
    got = found(spark, rows, F.col("vec_id") % 5 == 0)
    expected = brute(rows, lambda r: r[0] is not None and r[0] % 5 == 0)
    assert got == expected and any(r[3] is None or r[1] is None for r in got)


def test_large_numbers(spark):
    big = 1 << 30
    rows = [(0, 1, [big, big, 3]), (1, 1, [big, big, 1]), (2, 2, [big // 2, big, 7]), (3, 2, [big, big // 2, 7]), (4, 2, [big // 2, big, 8])]
    assert found(spark, rows, F.col("vec_id") == 0) == brute(rows, lambda r: r[0] == 0)
    with pytest.raises(OverflowError):
        negatives.scores(np.array([[1 << 40, 0]]), np.array([[1 << 40, 0]]), 1 << 40)
    assert negatives.scores(np.array([[1 << 40, 1]]), np.array([[1, 1 << 40]]), 1 << 40).tolist() == [[1 << 41]]


def test_bounds_hold_every_score():
    r = np.random.default_rng(4)
    vectors = r.integers(-300, 300, (200, 16))
    vectors[5] = 2 * vectors[4]
    known = {16: negatives._unit(vectors[:8])[0]}
    units, norm = negatives._unit(vectors)
    angles = np.arccos(np.clip(units @ negatives._directions(known, 16).T, -1, 1)).astype(np.float32)
    row = {"x_n": 200, "dim": 16, "x_uid": list(range(200))} | {f"x_{k}": v.tobytes() for k, v in {"id": np.arange(200), "named": np.ones(200, bool), "label": np.zeros(200, np.int64), "vector": vectors, "norm": norm, "angles": angles}.items()}
    block = negatives._Rows(row, "x")
    least, most = negatives.score_bounds(block, slice(0, 200), block)
    score = negatives.scores(block.vector, block.vector, block.most)
    assert (least <= score).all() and (score <= most).all() and (most[:8] - least[:8] < norm[:8, None] * norm[None, :]).any()


def test_rounding_down(spark):
    df = spark.createDataFrame([([0.5, -0.001], 1), ([float("nan"), 1.0], 2), ([None, 1.0], 3), (None, 4), ([float("inf")], 5), ([], 6)], "e array<float>, k int")
    got = [r["v"] for r in df.orderBy("k").select(negatives.rounded(F.col("e")).alias("v")).collect()]
    assert got == [[128, -1], None, None, None, None, []]


def test_empty_and_extra_columns(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, label int"
    empty(spark, schema).write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert queries.op13_hard_negatives(spark, f"{tmp_path}/a").count() == 0
    rows = [(i * 50, [0.1 * i, 1.0, -0.5], i % 2) for i in range(12)]
    spark.createDataFrame(rows, schema).selectExpr("*", "1 AS uid", "'x' AS dim", "2 AS block").write.parquet(f"{tmp_path}/b/embeddings.parquet")
    floor = [(i, (y + 1) % 10 if i % 7 == 0 else y, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist()) for i, v, y in rows]
    assert sorted((tuple(r) for r in queries.op13_hard_negatives(spark, f"{tmp_path}/b").collect()), key=str) == brute(floor, lambda r: True)
