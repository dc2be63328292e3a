"""Language ID, toxicity, decontamination, mixing, suffix dedup."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from genocohort.llm import decontamination, language, mixing, suffixes, toxicity
from genocohort.llm.shared import in_blocks, shipped
from tests.llm.helpers import awkward_texts, documents, empty, prose

ROOT = "/root/testdata"


# language ID


def test_language_held_out_accuracy(spark):
    shipped(spark)
    docs = spark.read.parquet(f"{ROOT}/sf0.01/documents.parquet")
    filters = language.learn(docs.where("doc_id % 3 <> 1").select("doc_id", "text", "lang"))
    assert filters.languages == sorted(filters.languages) and (filters.false < 0.2).all()
    found = language.identified(docs.where("doc_id % 3 = 1"), filters)
    right = found.selectExpr("avg(CASE WHEN _lang = lang THEN 1.0 ELSE 0.0 END) AS a").first()["a"]
    assert right > 0.98


def test_language_edges(spark):
    shipped(spark)
    filters = language.learn(documents(spark, [prose(i, 60) for i in range(6)]))
    df = documents(spark, extra="_lang score")
    rows = {r["doc_id"]: r for r in language.identified(df, filters).collect()}
    assert all((rows[i]["_lang"], rows[i]["_lang_score"]) == ("und", 0.0) for i in (0, 1, 2, None))
    assert all(0 < r["_lang_score"] <= 1 and r["_lang"] in ("en", "de") and r["score"] == f"own{i}" for i, r in rows.items() if i is not None and i > 3)
    kept = language.accepted(df, filters)
    assert kept.columns == df.columns and kept.where("text IS NULL OR text = ''").count() == 0
    assert language.identified(empty(spark), filters).count() == 0
    none = language.learn(empty(spark))
    assert {r["_lang"] for r in language.identified(df, none).collect()} == {"und"}
    assert language.accepted(df, none).count() == sum(any(c.isalpha() for c in t or "") for t in awkward_texts())


def test_bloom_finds_every_inserted_gram():
    codes = np.arange(0, 4_000_000, 997, dtype=np.uint32)
    slots = np.zeros(1 << 12, bool)
    for place in language._places(codes, 1 << 12):
        slots[place] = True
    assert all(slots[p].all() for p in language._places(codes, 1 << 12))


# toxicity


def test_toxicity_held_out(spark):
    shipped(spark)
    docs = spark.read.parquet(f"{ROOT}/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{ROOT}/sf0.1/labels.parquet").where("toxic IS NOT NULL")
    machine = toxicity.learn(docs.join(toxicity.sampled(labels.where("doc_id % 5 <> 0").select("doc_id", "toxic")), "doc_id"))
    held = toxicity.toxicity(docs, machine).join(labels.where("doc_id % 5 = 0"), "doc_id").selectExpr("toxic", "_toxicity >= 0.5 AS p").groupBy("toxic", "p").count().collect()
    n = {(r["toxic"], r["p"]): r["count"] for r in held}
    assert n[1, True] >= 0.9 * (n[1, True] + n.get((1, False), 0)) and n[1, True] >= 0.9 * (n[1, True] + n.get((0, True), 0))
    # gaps, marks between letters, doubled letters
    plain, marked, spaced, doubled, mild = machine.scores(pa.array(["you idiot", "you i-d.i-o-t", "you i d i o t there", "you idiiot", "you are kind"]))
    assert plain > 0.5 and marked == pytest.approx(plain) and spaced > 0.5 and doubled > 0.5 and mild < 0.5


def test_kernel_table_as_features():
    """Table sums are the kernel's own features, word by word."""
    table = np.random.default_rng(0).random(1 << 20).astype(np.float32)
    machine = toxicity.Machine(table, 0.0)
    for word in ("idiot", "a", "ab", "scum", "étrange", "abcdefghijklmnop"):
        expected = sum(v * table[c] for c, v in toxicity.features(word).items())
        assert machine.decisions(pa.array([word]))[0, 0] == pytest.approx(expected, rel=1e-5, abs=1e-6)


def test_toxicity_edges(spark):
    shipped(spark)
    df = documents(spark, extra="_toxicity toxic")
    nothing = toxicity.learn(df.selectExpr("doc_id", "0 AS toxic", "text"))
    rows = toxicity.toxicity(df, nothing).collect()
    assert len(rows) == len(awkward_texts()) and all(0 <= r["_toxicity"] < 0.5 for r in rows)
    assert toxicity.toxicity(empty(spark), nothing).count() == 0


# decontamination


def brute_hits(text, items, window):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = words(text)
    hit, names, longest = set(), set(), 0
    for name, item in items:
        v = words(item)
        k = min(window, len(v))
        for i in range(len(v) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == v[i : i + k]:
                    hit |= set(range(j, j + k))
                    names.add(name)
                    n = k
                    while i + n < len(v) and j + n < len(w) and v[i + n] == w[j + n]:
                        n += 1
                    longest = max(longest, n)
    return len(w), len(hit), sorted(x for x in names if x is not None), longest


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_matches_as_brute_force(spark, block_bytes):
    shipped(spark)
    items = [(1, prose(50, 40)), (2, prose(51, 12)), (3, "river stone of"), (4, None), (5, "..."), (1, prose(52, 15)), (None, prose(53, 20)), (7, "Éa über")]
    split = prose(50, 40).split()
    texts = [t for t in awkward_texts() if len(t or "") < 50_000] + [
        prose(60, 30) + " " + prose(50, 40) + ", " + prose(61, 9), " ".join(split[5:14]), " ".join(split[5:16]), prose(51, 12).upper(), "the RIVER--stone of", prose(53, 20), "xéa  éa über",
        " ".join(split[:6]), " ".join(split[6:20]),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "doc_id AS _items", "doc_id AS start")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.with_matches(df, bench, 10, block_bytes)
    got = {r["doc_id"]: (r["_n_words"], r["n_hit"], r["_items"], r["_longest"]) for r in found.withColumn("n_hit", decontamination.hit_words()).collect()}
    expected = {i: brute_hits(t, items, 10) for i, t in enumerate(texts)}
    assert got == expected and sum(e[1] > 0 for e in expected.values()) >= 5
    clean = decontamination.decontaminated(df, bench, 10, block_bytes)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {i for i, e in expected.items() if not e[1]}


def test_matches_of_empty_tables(spark):
    shipped(spark)
    nothing = empty(spark, "item_id long, text string")
    assert decontamination.decontaminated(documents(spark), nothing).count() == len(awkward_texts())
    assert decontamination.with_matches(empty(spark), nothing).count() == 0
    assert [len(b) for b in in_blocks(documents(spark).select("doc_id", "text"), F.lit(4), 8)] == [2] * 7 + [1]


# mixing


def test_mix_reaches_targets(spark):
    shipped(spark)
    df = documents(spark, [prose(i, 20 + 3 * i) for i in range(200)] + awkward_texts())
    rows = mixing.mixed_documents(df).collect()
    assert len(rows) == 200 + len(awkward_texts())
    taken, target, size = {}, {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and 0 <= r["position"] <= 1
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in taken)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values())) and all(target[s] <= 2 * size[s] + 1e-6 for s in size)
    again = mixing.mixed_documents(df).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mixed_documents(empty(spark)).count() == 0


def test_positions_follow_the_schedule(spark):
    """The share of a source taken up to a time is the integral of its weight up to then."""
    shares = [i / 50 for i in range(51)]
    df = spark.createDataFrame([(k, x) for k in range(3) for x in shares], "kind int, share double")
    for r in df.withColumn("t", mixing.position(F.col("share"), F.col("kind"))).collect():
        knots = mixing.SCHEDULES[r["kind"]]
        grid = np.linspace(0, 1, 20_001)
        weight = np.interp(grid, np.linspace(0, 1, len(knots)), knots)
        area = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        assert np.interp(r["t"], grid, area / area[-1]) == pytest.approx(r["share"], abs=1e-4)


def test_mix_rows(spark):
    shipped(spark)
    df = documents(spark, [prose(i, 30 + i) for i in range(60)], extra="_copies at doc")
    out = mixing.mix_rows(df)
    assert out.columns == df.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    plan = {r["doc_id"]: r for r in mixing.mixed_documents(df).collect()}
    assert counts == {i: int(r["taken"] / r["size"] + 0.5) for i, r in plan.items() if int(r["taken"] / r["size"] + 0.5)}
    assert mixing.mix_rows(empty(spark)).count() == 0


# suffix dedup


def brute_removed(texts, length):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [40, 60])
def test_suffixes_as_brute_force(spark, length):
    shipped(spark)
    r = random.Random(2)
    passage = prose(70, 30)
    texts = [t for t in awkward_texts() if len(t or "") < 20_000]
    texts += [prose(200 + i, 20) + passage[r.randrange(30) : 100 + r.randrange(60)] + prose(300 + i, 20) for i in range(40)]
    texts += ["ab" * 60, "abc" * 50, "x" * 39, "x" * 40, "ü" * 50 + passage, passage + passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "doc_id AS key", "text AS runs")
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffixes.digests(df, length).collect()}
    assert got == dict(enumerate(brute_removed(texts, length)))


def test_suffixes_edges(spark):
    shipped(spark)
    assert suffixes.digests(empty(spark)).count() == 0
    df = documents(spark)
    got = suffixes.digests(df.unionAll(df)).collect()
    assert all(x["n_removed"] == (x["n_bytes"] if x["n_bytes"] >= suffixes.LENGTH else 0) for x in got) and len(got) == 2 * len(awkward_texts())


def test_multikey_sort():
    r = np.random.default_rng(1)
    for _ in range(100):
        n = r.integers(0, 60)
        a, b = r.integers(0, 5, n), r.integers(0, 3, n)
        order, new = suffixes.multikey_sorted([a, b])
        rows = list(zip(a[order], b[order]))
        assert rows == sorted(zip(a, b))
        assert new.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(n)]
