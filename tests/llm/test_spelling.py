"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

from genocohort.llm import queries, spelling
from tests.llm.helpers import empty, prose


def edits(word, others):
    """Words of others, one letter away."""
    found = set()
    for i in range(len(word) + 1):
        pattern = [re.compile(re.escape(word[:i]) + "." + re.escape(word[i:]))]
        if i < len(word):
            pattern.append(re.compile(re.escape(word[:i]) + ".?" + re.escape(word[i + 1 :])))
        found |= {w for w in others if w != word and any(p.fullmatch(w) for p in pattern)}
    return found


def brute(words, ratio=5):
    forms, near = {}, {}
    for w, n in words.items():
        near[w] = edits(w, [x for x in words if abs(len(x) - len(w)) < 2])
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, n, len(near[w]), words[forms[w]] if forms[w] else None)
    return out


def found(spark, words, ratio=5):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return {r["word"]: tuple(r)[1:] for r in spelling.grouped(df, ratio).collect()}


def test_as_brute_force(spark):
    r = random.Random(2)
    words = {}
    for base in ("banana", "aaaaaa", "kitten", "übermut", "aaabbb"):
        words[base] = 100_000
        for _ in range(60):
            w = list(base)
            for _ in range(r.randrange(1, 3)):
                k = r.randrange(len(w) + 1)
                kind = r.randrange(3)
                if kind == 0:
                    w.insert(k, r.choice("abntÿ"))
                elif kind == 1 and k < len(w):
                    del w[k]
                elif k < len(w):
                    w[k] = r.choice("abntÿ")
            words.setdefault("".join(w), r.choice([1, 5, 5, 30, 200, 2000]))
    assert found(spark, words) == brute(words)
    assert found(spark, words, 2) == brute(words, 2)


def test_runs_of_a_letter_ties_and_chains(spark):
    # a letter within a run counts once; ties go to the smaller word; forms are followed to the last
    words = {"aaaaaa": 10, "aaaaaaa": 10, "abcdef": 1, "abcdeg": 5, "abcdeh": 5, "zzzzzz": 1, "zzzzzy": 5, "zzzzyy": 25, "zzzyyy": 125, "zzyyyy": 625, "zyyyyy": 3125, "wwwwww": 7}
    got = found(spark, words)
    assert got == brute(words)
    assert got["aaaaaa"][3] == 1 and got["abcdef"][0] == "abcdeg" and got["zzzzzz"][1] == "zyyyyy" and got["wwwwww"] == (None, "wwwwww", 7, 0, None)


def test_a_key_with_every_letter(spark):
    words = {f"abc{chr(c)}def": c for c in [*range(97, 123), *range(0xC0, 0x100)]} | {"abcdef": 1000}
    got = found(spark, words)
    assert got == brute(words) and got["abcadef"][3] == len(words) - 1


def counts(rows):
    words = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def test_query_on_odd_texts(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["Übermut", "STRASSE", "straße", "bananas", "x", "ÀÉÎÿ÷×a"]) for _ in range(200))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "!!! 123 \n"), (None, "Bananas " * 9), (63, prose(1, 20_000)), (64, "a" * 300), (5, rows[5][1])]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS word", "doc_id AS n", "1 AS run").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["word"]: tuple(x)[1:] for x in queries.op11_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == brute(counts(rows)) and len(got) > 20
    assert queries.op11_spelling_variants(spark, str(tmp_path)).schema.simpleString() == "struct<word:string,form:string,root:string,n:bigint,n_near:bigint,form_n:bigint>"


def test_empty(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_spelling_variants(spark, str(tmp_path)).count() == 0
