"""Runs of homozygosity, linkage pruning, panel components and haplogroup picks against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from genocohort.operators import ancestry as A
from genocohort.operators import ld as LD
from genocohort.operators import pca as PC
from genocohort.plans import ancestry as PA
from genocohort.operators import roh as R


def roh_by_hand(rows, window, max_het, max_missing, rate, min_snps, min_kb, density, gap):
    """rows: sorted (pos, dosage)."""
    n = len(rows)
    hom = [
        sum(d == 1 for _, d in rows[i:i + window]) <= max_het and sum(d is None for _, d in rows[i:i + window]) <= max_missing
        for i in range(n - window + 1)
    ]
    inside = []
    for j in range(n):
        span = hom[max(0, j - window + 1): min(j, n - window) + 1]
        inside.append(bool(span) and sum(span) / len(span) >= rate)
    out, current = [], []
    for j, (p, _) in enumerate(rows):
        if not inside[j]:
            continue
        if current and (current[-1] != j - 1 or p - rows[current[-1]][0] > gap * 1000):
            out.append(current)
            current = []
        current.append(j)
    if current:
        out.append(current)
    segs = set()
    for s in out:
        a, b = rows[s[0]][0], rows[s[-1]][0]
        kb = (b - a + 1) / 1000
        if len(s) >= min_snps and kb >= min_kb and kb / len(s) <= density:
            segs.add((a, b, len(s)))
    return segs


@pytest.mark.parametrize("block", [64, 101, 4096])
def test_roh_does_not_depend_on_the_block_size(spark, block):
    rng = random.Random(7)
    data = {}
    for sample in (1, 2):
        pos, rows = 1, []
        for i in range(900):
            pos += rng.choice([5_000, 20_000, 20_000, 30_000]) if i % 300 else 1_500_000
            calm = (i // 120) % 2 == sample % 2
            rows.append((pos, rng.choice([0, 2]) if calm and rng.random() < 0.99 else rng.choice([0, 1, 1, 2, None])))
        data[sample] = rows
    df = spark.createDataFrame([(s, "1", p, d) for s, rows in data.items() for p, d in rows], "sample_id int, chrom string, pos long, dosage int")
    got = {s: set() for s in data}
    for r in R.homozygous_segments(df, block=block).collect():
        got[r.sample_id].add((r.start_pos, r.end_pos, r.n_snps))
    for s, rows in data.items():
        assert got[s] == roh_by_hand(rows, 50, 1, 5, 0.05, 50, 500, 50, 1000)
        assert got[s]


def panel(seed, n_samples, n_sites):
    rng = np.random.default_rng(seed)
    group = rng.integers(0, 3, n_samples)
    freq = rng.uniform(0.1, 0.9, (3, n_sites))
    d = rng.binomial(2, freq[group])
    d[:, 1::4] = d[:, 0::4][:, : d[:, 1::4].shape[1]]
    return d


def frame(spark, d):
    rows = [(int(s), "1", int(v) * 1000 + 1, "A", "G", int(d[s, v])) for s in range(d.shape[0]) for v in range(d.shape[1])]
    return spark.createDataFrame(rows, "sample_id int, chrom string, pos long, ref string, alt string, dosage int")


def test_ld_prune_is_greedy_by_frequency(spark):
    d = panel(3, 40, 60)
    calls = frame(spark, d)
    freq = A.allele_frequencies(calls)
    pairs = LD.ld_pairs(calls, window=12, step=4, min_r2=0.2)
    linked = {(r.pos_i, r.pos_j) for r in pairs.collect()}
    want = set()
    for i in range(60):
        for j in range(i + 1, 60):
            if j - (i // 4) * 4 < 12 and d[:, i].std() and d[:, j].std():
                if np.corrcoef(d[:, i], d[:, j])[0, 1] ** 2 > 0.2:
                    want.add((i * 1000 + 1, j * 1000 + 1))
    assert linked == want
    maf = {r.pos: r.maf for r in freq.collect()}
    kept = []
    for p in sorted(maf, key=lambda p: (-maf[p], hashlib.md5(f"1:{p}".encode()).hexdigest())):
        if not any((min(p, q), max(p, q)) in want for q in kept):
            kept.append(p)
    assert {r.pos for r in LD.ld_prune(pairs, freq).collect()} == set(kept)


@pytest.mark.parametrize("words", [1, 256])
def test_linkage_over_bit_planes(spark, monkeypatch, words):
    """Missing calls, more samples than a word and (words = 1) than a chunk, against sums over the samples; rows joined per pair: one a chunk."""
    monkeypatch.setattr(LD, "CHUNK_WORDS", words)
    d = panel(8, 150, 30)
    seen = np.random.default_rng(9).random(d.shape) > 0.2
    calls = frame(spark, d)
    known = [(int(s), int(v) * 1000 + 1) for s, v in zip(*np.nonzero(seen))]
    calls = calls.join(spark.createDataFrame(known, "sample_id int, pos long").withColumn("k", F.lit(1)), ["sample_id", "pos"], "left").withColumn("dosage", F.when(F.col("k") == 1, F.col("dosage"))).drop("k")
    got = {(r.pos_i, r.pos_j): (r.n, r.r2) for r in LD.ld_pairs(calls, window=10, step=3).collect()}
    want = {}
    for i in range(30):
        for j in range(i + 1, 30):
            both = seen[:, i] & seen[:, j]
            x, y = d[both, i], d[both, j]
            if j - (i // 3) * 3 < 10 and x.std() and y.std():
                want[(i * 1000 + 1, j * 1000 + 1)] = (int(both.sum()), pytest.approx(np.corrcoef(x, y)[0, 1] ** 2, abs=1e-9))
    assert got == want and len(want) > 100
    planes, chunks = LD.bit_planes(calls)
    assert chunks == (3 if words == 1 else 1) and planes.count() == 30 * chunks


def test_components_match_a_dense_decomposition(spark):
    d = panel(5, 24, 80)
    calls = frame(spark, d)
    z = PC.standardised_table(calls, A.allele_frequencies(calls))
    scores, _ = PC.panel_components(z, k=3)
    got = np.array([[r.q0, r.q1] for r in sorted(scores.collect(), key=lambda r: r.sample_id)])
    p = d.mean(0) / 2
    ok = (p > 0) & (p < 1)
    m = (d[:, ok] - 2 * p[ok]) / np.sqrt(2 * p[ok] * (1 - p[ok]))
    u = np.linalg.svd(m, full_matrices=False)[0]
    for i in range(2):
        assert abs(got[:, i] @ u[:, i]) == pytest.approx(1.0, abs=1e-4)


def test_components_are_the_largest_ones(spark, monkeypatch):
    """All k of them against a dense decomposition, samples in several parts; too many samples are refused."""
    monkeypatch.setattr(PC, "PART", 7)
    d = panel(6, 40, 150)
    calls = frame(spark, d)
    z = PC.standardised_table(calls, A.allele_frequencies(calls))
    scores, loadings = PC.panel_components(z, k=6)
    errors = {r.component: r for r in PC.component_errors(z, scores, loadings, 6).collect()}
    p = d.mean(0) / 2
    ok = (p > 0) & (p < 1)
    m = (d[:, ok] - 2 * p[ok]) / np.sqrt(2 * p[ok] * (1 - p[ok]))
    largest = np.linalg.svd(m, compute_uv=False)[:6] ** 2
    assert [errors[j].variance for j in range(6)] == pytest.approx(largest.tolist(), rel=1e-9)
    assert all(e.residual < 1e-4 and e.norm_error < 1e-9 for e in errors.values())
    monkeypatch.setattr(PC, "MOST_CELLS", 100)
    with pytest.raises(ValueError, match="cells"):
        PC.panel_components(z, k=6)


def test_haplogroup_pick(spark):
    rows = [("s", "E", 300, 340), ("s", "E1b1b1", 20, 30), ("s", "E1b", 40, 90), ("t", "R", 4, 100), ("t", "J2", 3, 4)]
    df = spark.createDataFrame(rows, "sample_id string, haplogroup string, derived long, label_total long").selectExpr("*", "derived / label_total AS rate")
    got = {r.sample_id: r.haplogroup for r in A.pick_haplogroup(df).collect()}
    assert got == {"s": "E1b1b1", "t": "R"}


def test_a_panel_is_worked_out_once(spark):
    """Pruning and components read the calls many times: what they come from runs once for all of them."""
    d = panel(5, 24, 60)
    worked = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            worked.add(batch.num_rows)
            yield batch

    plain = frame(spark, d)
    calls = plain.mapInArrow(counted, plain.schema)
    kept = PA.prune_panel(calls, window=12, step=4)[2]
    assert kept.count() > 0 and worked.value == d.size
    assert LD.ld_pairs(calls, window=12, step=4).count() > 0 and worked.value == 2 * d.size
    samples = spark.createDataFrame([(s, "EUR") for s in range(24)], "sample_id int, superpop string")
    built = PA.build_reference(calls, samples, components=2, window=12, step=4)
    assert built["centroids"].count() == 1 and built["errors"].count() == 2 and worked.value == 3 * d.size
