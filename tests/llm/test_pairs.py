"""Jaccard join, vector links, components."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from genocohort.llm import graphs, jaccard, vectors
from genocohort.llm.shared import may_hold, membership_filter, shipped
from tests.llm.helpers import awkward_texts, documents, empty, prose, rooted


def brute_sets(texts, words):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    return out


def near_copies():
    """Copies of two texts with one to three words changed, copies linked to a base but not to each other, and bystanders."""
    r = random.Random(4)
    texts = []
    for base in (prose(11, 150), prose(12, 60)):
        for k in range(25):
            words = base.split()
            for _ in range(k % 4):
                words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(words))
    line = prose(13, 30)
    return texts + [line + " " + prose(100 + i, 50) for i in range(20)]


@pytest.mark.parametrize("words,share", [(4, (85, 100)), (5, (80, 100))])
def test_joined_as_brute_force(spark, words, share):
    texts = awkward_texts() + near_copies()
    ids = [i * 7 % 1000 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    shipped(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.joined(df, words, share).collect()}
    sets = brute_sets(texts, words)
    order = sorted(range(len(texts)), key=lambda i: ids[i])
    links = [(a, b) for a in range(len(order)) for b in range(a) if sets[order[a]] and share[1] * len(sets[order[a]] & sets[order[b]]) >= share[0] * len(sets[order[a]] | sets[order[b]])]
    root = rooted(len(order), links)
    assert got == {ids[i]: (len(sets[i]), ids[order[root[k]]]) for k, i in enumerate(order)}
    assert any(len(sets[i]) and root[k] != k for k, i in enumerate(order))


def test_one_of_each_group(spark):
    shipped(spark)
    df = documents(spark, extra="key root row n")
    odd = documents(spark, [prose(901, 60), prose(902, 60)]).select(F.lit(5).cast("long").alias("doc_id"), "text")
    copies = documents(spark, [prose(903, 60)] * 3).select(F.lit(None).cast("long").alias("doc_id"), "text")
    kept = jaccard.one_of_each_group(df.unionAll(df.where("doc_id = 5")).unionByName(odd, allowMissingColumns=True).unionByName(copies, allowMissingColumns=True))
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # 5 and 6 are the same words, 7 and 8 the same text, 11 and 12 nearly; two other texts have the id 5, three copies of one none
    assert sorted(x for x in ids if x is not None) == [0, 1, 2, 4, 5, 5, 5, 7, 9, 10, 11, 13, 14] and ids.count(None) == 2
    assert jaccard.one_of_each_group(empty(spark)).count() == 0


def test_components(spark):
    r = random.Random(1)
    n = 300
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(r.randrange(200, n), r.randrange(200, n)) for _ in range(70)] + [(5, 5), (1, 0)]
    got = {x["node"]: x["root"] for x in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = rooted(n, links)
    met = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root[x] for x in met}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(rows, threshold):
    def sound(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    out = []
    for a, (_, x) in enumerate(rows):
        for b in range(a):
            y = rows[b][1]
            if sound(x) and sound(y) and len(x) == len(y):
                x_, y_ = np.array(x, np.float64), np.array(y, np.float64)
                if x_ @ y_ / np.linalg.norm(x_) / np.linalg.norm(y_) >= threshold:
                    out.append((a, b))
    return out


def test_vectors_as_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.standard_normal(16).astype(np.float32).tolist()) for i in range(300)]
    for i in range(300, 420):
        rows.append((i, (np.array(rows[i % 40][1]) + 0.05 * r.standard_normal(16)).astype(np.float32).tolist()))
    rows += [(420, rows[0][1]), (421, rows[0][1]), (422, None), (423, []), (424, [0.0] * 16), (425, [None] + [1.0] * 15), (426, [float("nan")] * 16), (427, [float("inf")] + [1.0] * 15), (428, [1.0] * 8), (429, [2.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    shipped(spark)
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in vectors.near_duplicates(df).collect()}
    links = brute_links(rows, 0.9)
    root = rooted(len(rows), links)
    count = [sum(i in x for x in links) for i in range(len(rows))]
    found = sum(g[0] for g in got.values())
    assert found >= 0.95 * sum(count) and all(got[i][0] <= count[i] for i in range(len(rows)))
    assert sum(got[i] == (count[i], root[i], root[i] == i) for i in range(len(rows))) >= 0.95 * len(rows)
    assert vectors.near_duplicates(empty(spark, "vec_id long, embedding array<float>, links long")).count() == 0


def test_vector_recall_at_the_threshold(spark):
    """Pairs with a cosine just above the threshold, the hardest ones: recall of at least 0.9."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(400):
        x = r.standard_normal(64)
        x /= np.linalg.norm(x)
        y = r.standard_normal(64)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        c = 0.901
        rows += [(2 * i, x.tolist()), (2 * i + 1, (c * x + np.sqrt(1 - c * c) * y).tolist())]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.where("n_links > 0").count() >= 0.9 * len(rows)


def test_tiles_count_each_pair_once(spark, monkeypatch):
    """One large group over many tiles."""
    monkeypatch.setattr(vectors, "TILE", 16)
    r = np.random.default_rng(6)
    base = r.standard_normal(32)
    rows = [(i, (base + 0.01 * r.standard_normal(32)).tolist()) for i in range(150)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all(x["n_links"] == 149 and x["component_id"] == 0 for x in got)


def test_membership_filter_reaches_the_driver_as_columns(spark):
    keys = spark.range(100000).select(F.xxhash64("id").alias("key"))
    own = keys.toArrow()["key"].to_numpy().view(np.uint64)
    tracemalloc.start()
    packed = membership_filter(keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert may_hold(packed, own).all() and not may_hold(packed, own + np.uint64(1)).all()
    assert peak < 8 * packed.nbytes
