"""BPE by forced boundaries, against the tokenizers library."""

import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from genocohort.llm import bpe, queries
from genocohort.llm.shared import shipped
from tests.llm.helpers import awkward_texts, documents, empty

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a <|endoftext|> b", "x<|startoftext|><|endoftext|>y", "<|ENDOFTEXT|>", "don't DON'T we'll !'s 'sx 12 3\u0663", "\u03a3\u03a3 \u0130 \u00c9 e\u0301 \u0301x", "\u212b \u2126 \ufb01",
    "\u0085a\u2003b\u00a0c\u3000d", "\x1c\x1f\x00", "\u65e5\u672c\u8a9e\U0001f389\u200d", "ab" * 4000, "a" * 3000 + "!" * 3000, "\n\n x \r\n\t", "\U00010d50\u1c89 \ua7da",
]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def encode(texts):
    found = bpe.encoder(PATH).encode(pa.array(texts, pa.string()))
    return [x.tolist() for ids, counts in found for x in np.split(ids, np.cumsum(counts)[:-1])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="abCD's t'LLre.,!?12 \u00e9\u03a3\u0301\n<|endoftext|>", max_size=60)), min_size=1, max_size=8))
def test_ids_are_the_librarys(texts):
    tokenizer = library()
    assert encode(texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_texts():
    tokenizer = library()
    assert encode(ODD) == [tokenizer.encode(t, add_special_tokens=False).ids for t in ODD]


def test_forgetting_changes_nothing(monkeypatch):
    texts = [t or "" for t in awkward_texts()] + ODD
    before = encode(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    assert [encode([t])[0] for t in texts] == before


def test_no_token_crosses_a_cut():
    vocabulary = bpe.encoder(PATH).vocabulary
    assert vocabulary.joins[ord("t") << 8 | ord("h")] and not vocabulary.joins[ord("a") << 8 | ord("1")] and 1000 < vocabulary.joins.sum() < 5000
    data = np.frombuffer(b"the9th", np.uint8)
    cuts = vocabulary.cuts(data, np.array([6])).tolist()
    assert cuts[-1] == 6 and 3 in cuts
    # the queue of long fragments and the rounds of short ones give the same ids
    for text in (b"therefore", b"aaaaaaaaaaa", b"\xc3\xa9\xc3\xa9", b"x"):
        for closes in (True, False):
            ids, counts = vocabulary.merged_all([(text, closes), (b"of", True)])
            assert ids[: counts[0]].tolist() == vocabulary.merged(text, closes)


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError, match="white space"):
        bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), bpe.library_letters())
    with open(PATH, encoding="utf-8") as file:
        given_ = json.load(file)
    given_["normalizer"]["normalizers"].pop()
    (tmp_path / "other.json").write_text(json.dumps(given_))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(tmp_path / "other.json"), bpe.library_letters())


def test_columns_and_decoding(spark):
    shipped(spark)
    tokenizer = library()
    texts = awkward_texts() + ODD
    df = documents(spark, texts, extra="_ids _decoded start")
    df = df.unionAll(df.where("doc_id = 7"))
    found = bpe.decoded(bpe.encoded(df, PATH), PATH)
    assert found.columns == [*[c for c in df.columns if c not in ("_ids", "_decoded")], "_ids", "_decoded"]
    rows = found.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["_ids"] == ids and r["_decoded"] == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.decoded(bpe.encoded(empty(spark), PATH), PATH).count() == 0
    nothing = bpe.decoded(spark.createDataFrame([(1, None), (2, []), (3, [49407])], "k int, _ids array<int>"), PATH).orderBy("k").collect()
    assert [r["_decoded"] for r in nothing] == ["", "", "<|endoftext|>"]


def test_query_against_the_library(spark):
    tokenizer = library()
    sf_dir = "/root/testdata/sf0.01"
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_bpe_round_trip(spark, sf_dir).collect()}
    expected = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        expected[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert got == expected
