"""Token files, chat trees, page text, the pipeline, the registered queries."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from genocohort.llm import chat, pages, queries, tokens
from genocohort.llm.shared import shipped
from tests.llm.helpers import awkward_texts, documents, empty, prose

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2**32 - 1)), min_size=1, max_size=1500))
def test_codes_round_trip(ids):
    block = tokens.encoded(np.array(ids, np.uint32))
    assert tokens.decoded(block).tolist() == ids
    for i in {0, len(ids) - 1, len(ids) // 2}:
        assert tokens.token_at(block, i) == ids[i]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
def test_encoding_by_chunks_is_the_tokenizers(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = [x.tolist() for ids, counts in tokens.text_encoder(VOCABULARY)(pa.array(texts)) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokenizers_that_keep_spaces_are_refused():
    with pytest.raises(ValueError, match="white space"):
        tokens.text_encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    shipped(spark)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    texts = awkward_texts() + ["a <|endoftext|> b", "ǆ ﬁ e\u0301 \u0301x  y\u2003z"]
    df = documents(spark, texts, extra="start shard")
    df = df.unionAll(df.where("doc_id IN (7, 14)"))
    files = tokens.write_tokens(df, VOCABULARY)
    got = tokens.read_documents(files).orderBy("start").collect()
    ids = {None if i == 3 else i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    order = [None, *[i for i in range(len(texts)) if i != 3 for _ in range(2 if i in (7, 14) else 1)]]
    assert [r["doc_id"] for r in got] == order
    at = 0
    for r in got:
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    block = files.orderBy("shard", "block").first()
    assert [tokens.token_at(block, i) for i in range(block["n_ids"])] == tokens.decoded(block).tolist()
    assert tokens.read_documents(tokens.write_tokens(empty(spark), VOCABULARY)).count() == 0


# chat trees


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="us<>[]/\\INSTa\n", max_size=12), st.text(alphabet="<s>/[INST]\\ab\n", max_size=40)), max_size=5))
def test_template_is_reversible(turns):
    formatted = "".join(chat.format_turn(*t)[0] for t in turns)
    assert [t[:2] for t in chat.parse_turns(formatted)] == turns
    for _, text, a, b in chat.parse_turns(formatted):
        assert chat.unescape(formatted[a:b]) == text


@pytest.mark.parametrize("segment", [2, 256])
def test_chat_trees(spark, monkeypatch, segment):
    """Conversations in segments of two turns, and of as many as they have."""
    monkeypatch.setattr(chat, "SEGMENT", segment)
    shipped(spark)
    r = random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(r.randrange(1, 6)):
            # few different turns, so that many conversations share their first ones
            rows.append((conv, turn, ("user", "assistant", "system")[turn % 3], f"turn {turn} {r.randrange(2)} </s>[INST]\\"))
    rows += [(100, 0, None, None), (100, 1, "assistant", ""), (101, None, "assistant", "x"), (101, 0, "assistant", "y"), (101, 0, "assistant", "y"), (None, 0, "user", "z"), (102, 0, "user", prose(1, 20_000))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "conv_id AS key", "role AS turns")
    trees = chat.write_trees(df)
    got = {x["conv_id"]: tuple(x)[1:] for x in chat.read_trees(trees).collect()}
    expected = {}
    for conv in {x[0] for x in rows}:
        turns = [(b or "", c or "") for _, b, c in sorted(((t, b, c) for i, t, b, c in rows if i == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "", x[2] or ""))]
        said = "".join(f"{a}\n{b}\n" for a, b in turns)
        loss = "".join(b for a, b in turns if a == "assistant")
        expected[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(chat.format_turn(*t)[0]) for t in turns))
    assert got == expected
    # what is emitted is one walk of the tree: shared turns once a shard; places, positions and intervals fit
    at, last = {}, {}
    for x in trees.orderBy("shard", "seq").collect():
        assert x["start"] == at.get(x["shard"], 0)
        at[x["shard"]] = x["start"] + len(x["text"])
        first = x["segment"] == 0
        assert sum(p["end"] - p["start"] for p in x["path"]) == x["position_start"] + len(x["text"]) or not first and x["position_start"] > 0
        last.setdefault(x["shard"], []).append(x)
    assert sum(at.values()) < 0.7 * sum(e[4] for c, e in expected.items() if c != 102) + 2 * expected[102][4]
    assert chat.read_trees(chat.write_trees(empty(spark, "conv_id long, turn long, role string, text string"))).count() == 0


def test_a_long_conversation_is_many_rows(spark):
    """One conversation, and the rows without conv_id, hold a third of all turns each; positions run on from segment to segment."""
    shipped(spark)
    turns = F.when(F.col("id") < 2000, 7).when(F.col("id") < 4000, None).otherwise(F.col("id") % 400 + 100)
    df = spark.range(6000).select(turns.cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t<"), F.col("id") % 1000).alias("text"))
    trees = chat.write_trees(df).cache()
    assert trees.agg(F.max("n_turns")).first()[0] == chat.SEGMENT and trees.where("conv_id = 7").count() == -(-2000 // chat.SEGMENT)
    expected = {}
    for r in df.orderBy("turn").collect():
        n, said, loss, chars = expected.get(r["conv_id"], (0, "", "", 0))
        expected[r["conv_id"]] = (n + 1, said + f"{r['role']}\n{r['text']}\n", loss + (r["text"] if r["role"] == "assistant" else ""), chars + len(chat.format_turn(r["role"], r["text"])[0]))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = {x["conv_id"]: tuple(x)[1:] for x in chat.read_trees(trees).collect()}
    assert got == {k: (n, sha(said), len(loss), sha(loss), chars) for k, (n, said, loss, chars) in expected.items()}
    last = trees.where("conv_id = 7").orderBy(F.desc("segment")).first()
    assert last["position_start"] + len(last["text"]) == expected[7][3] and last["prefix"] != 0


# page text

PAGE = (
    "<!doctype html><html><head><title>No</title><style>p{}</style><script>if (a<b) '</p>'</script></head><body><header><a href=/>Home</a></header><nav class='menu'><ul><li><a href=/a>A"
    "</a><li><a href=/b>B</a></ul></nav><main><h1>Title &amp; more</h1><p>First <b>bold</b>\n\n text &eacute;t&#233;.<p>Second paragraph, with enough words to read like prose.<br>New line."
    "<ul><li>item one of the text<li>item two of the text</ul></main><aside>Side notes</aside><form><label>Name</label><input><button>Go</button></form>"
    "<div class='comments'><p>Great read!</p></div><!-- <p>hidden</p> --><footer>&copy; someone</footer></body></html>"
)


def test_parse_and_blocks():
    nodes = pages.parse(PAGE)
    text = pages.blocks(nodes, [n.tag not in pages.NEVER for n in nodes])
    assert "Title & more\n\nFirst bold text été.\n\nSecond paragraph, with enough words to read like prose. New line.\n\nitem one of the text\n\nitem two of the text" in text
    assert "hidden" not in text and "No" not in text.split("\n\n")
    assert pages.parse("") and pages.blocks(pages.parse("a < b <unclosed"), [True]) == "a < b"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    nested = pages.parse(deep)
    assert pages.blocks(nested, [True] * len(nested)) == "x" and len(pages.node_features(nested)) == 5001
    assert [n.tag for n in pages.parse("<p title=\"never closed>x</p><b>y")] == ["#page", "p", "b"]


def test_optional_head_end_and_self_closed_elements():
    def text(page: str) -> str:
        nodes = pages.parse(page)
        return pages.blocks(nodes, pages.decode(nodes, np.full(len(nodes), 1.0)))

    # no </head>: body, any other element or text ends it, and its metadata still go
    for rest in ("<body><p>Kept text</p></body>", "<p>Kept text", "<main>Kept text</main>", "Kept text", "<noscript><link rel=x></noscript><p>Kept text", "<noscript><link rel=x><body><p>Kept text"):
        assert text(f"<html><head><title>No</title><meta charset=utf-8><style>p{{}}</style>{rest}</html>") == "Kept text", rest
    assert text("<head><template><p>No</p></template><title>No</title></head><body><p>Kept text") == "Kept text"
    # a self-closed svg or math, or an element in one, holds nothing; elsewhere the slash means nothing
    for image in ("<svg/>", '<svg class="i" />', "<math/>", "<svg><path d='M0'/><title/><style/></svg>", "<svg width=3/></svg>", "<svg><foreignObject><div/>No</div></foreignObject></svg>"):
        assert text(f"<body><div>{image}<p>Kept text</p></div></body>") == "Kept text", image
    assert [(n.tag, n.parent) for n in pages.parse("<div/><p/>x")] == [("#page", -1), ("div", 0), ("p", 1)]


def test_page_text(spark):
    shipped(spark)
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = pages.learn(given)
    assert model.trees
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, None, "plain words"), (5, "u", "<p>" + "word " * 50_000), (1, "u", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url AS _text")
    got = [(r["page_id"], r["_text"]) for r in pages.extracted(df, model).orderBy("page_id").collect()]
    text = dict(got)
    assert len(got) == 6 and text[2] == "" and text[3] == ""
    assert "Second paragraph" in text[1] and not any(x in text[1] for x in ("Home", "Side notes", "Name", "Great read", "someone"))
    # articles of the given pages, by their own mark-up
    import html
    import re

    for r in pages.extracted(given, model).limit(60).collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r["_text"] == "\n\n".join(x for x in parts if x)
    nothing = pages.learn(empty(spark, "page_id long, html string"))
    assert pages.extracted(empty(spark, "page_id long, html string"), nothing).count() == 0


def test_decoding_is_hierarchical():
    nodes = pages.parse(PAGE)
    margins = np.array([random.Random(i).uniform(-1, 1) for i in range(len(nodes))])
    kept = pages.decode(nodes, margins)
    assert all(kept[n.parent] for n, k in zip(nodes, kept) if k and n.parent >= 0)


# the pipeline and the registered queries


def test_pipeline(spark, tmp_path):
    shipped(spark)
    docs = documents(spark, [prose(i, 90) for i in range(40)] + awkward_texts() + [prose(5, 90), prose(6, 88), prose(500, 40)], extra="own").withColumn("lang", F.lit("en"))
    docs = docs.where("doc_id IS NOT NULL")
    spark.createDataFrame([(1, prose(500, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = [r["doc_id"] for r in kept.collect()]
        assert name.startswith("token") or kept.columns == docs.columns
    first, second, third, fourth, fifth = seen.values()
    n = 40
    assert set(first) == {i for i in range(n + 18) if i != 3 and i not in (n, n + 1, n + 2, n + 3)}
    # 9 is the beginning of document 2
    assert set(first) - set(second) == {n + 6, n + 8, n + 9, n + 12, n + 15, n + 16} and len(second) == len(set(second))
    assert set(second) - set(third) == {n + 17}
    assert sorted(fourth) == sorted(fifth) and set(fourth) <= set(third)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(fifth)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    empty(spark, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
