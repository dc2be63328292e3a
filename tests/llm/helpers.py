"""Small tables and brute-force versions for the tests of the operators for training text."""

from __future__ import annotations

import random

WORDS = "the of and to in is it for on with as at by this that from or be are was red green blue stone river house light cloud seven eleven".split()
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "er", "ing", "ed", "s"]) for _ in range(words))


def awkward_texts() -> list[str | None]:
    """Null, empty, blank, wordless, short, repeated, accented and long texts."""
    long = prose(9, 30_000)
    return [None, "", "  \n\t ", "!!! ???", "one", "One two", "one two", prose(1, 120), prose(1, 120), prose(2, 80), "É\u00a0à ß " + prose(3, 40), long, long + " end", "a" * 5000, "\\<s>[INST]</s>"]


def documents(spark, texts=None, extra: str = ""):
    texts = awkward_texts() if texts is None else texts
    rows = [(None if i == 3 else i, t, ("en", "de", None)[i % 3], ("a", "b", None, "c")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    for name in extra.split():
        df = df.selectExpr("*", f"concat('own', cast(doc_id AS string)) AS {name}")
    return df


def empty(spark, schema: str = DOC_SCHEMA):
    return spark.createDataFrame([], schema)


def rooted(n: int, links) -> list[int]:
    """Smallest index reachable from each of n by links."""
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root
