"""Benchmark decontamination by suffix arrays over the documents.

Every task holds a shard of documents. Only a word that stands in the benchmark can lie inside a match, so the shard's suffix
array holds the suffixes that start at least a window's length of such words; it is sorted by words. Every suffix of every
benchmark item is binary-searched in it: the neighbours of its place give the longest verbatim match and its locations, and
all suffixes that share a window with it are hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_blocks, lean
from .words import ALPHANUMERIC, lower, pieces, prefix_codes, span_codes, word_spans

#: Consecutive words of an item that make a match; a shorter item is matched whole.
WINDOW = 10
#: Bytes of benchmark text that are broadcast at once; a larger benchmark goes over the documents in so many rounds.
BLOCK_BYTES = 32 << 20

SPAN = "struct<start:int,end:int>"


class Items:
    """The words of a block of items, numbered, with the suffixes that start a window."""

    def __init__(self, rows: list[tuple[int | None, str]], window: int):
        texts = pa.array([(t or "").encode() for _, t in rows], pa.large_binary())
        words: list[np.ndarray] = []
        for _, data, offsets in pieces(texts):
            data = lower(data)
            starts, ends, firsts = word_spans(data, offsets, ALPHANUMERIC)
            codes = span_codes(prefix_codes(data), starts, ends)
            words += [codes[a:b] for a, b in zip(firsts[:-1], firsts[1:])]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        #: table over the vocabulary's low bits, to turn away most words before the binary search
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.vocabulary & np.uint64((1 << 20) - 1)] = True
        self.window = window
        self.ids = [i for i, _ in rows]
        self.words = [np.searchsorted(self.vocabulary, w) + 1 for w in words]
        #: (item, place) of every window, its words (0 beyond) and its length
        self.suffixes = [(i, at) for i, w in enumerate(self.words) if len(w) for at in range(max(1, len(w) - window + 1))]
        self.lengths = np.array([min(window, len(self.words[i])) for i, _ in self.suffixes], np.int64)
        self.wanted = np.zeros((len(self.suffixes), window), np.int64)
        for k, (i, at) in enumerate(self.suffixes):
            some = self.words[i][at : at + window]
            self.wanted[k, : len(some)] = some
        self.least = int(self.lengths.min()) if len(self.lengths) else window

    def number(self, codes: np.ndarray) -> np.ndarray:
        """1 and up for words of the items, 0 for others."""
        out = np.zeros(len(codes), np.int64)
        if len(self.vocabulary):
            some = np.flatnonzero(self.bits[codes & np.uint64((1 << 20) - 1)])
            place = np.minimum(np.searchsorted(self.vocabulary, codes[some]), len(self.vocabulary) - 1)
            found = self.vocabulary[place] == codes[some]
            out[some[found]] = place[found] + 1
        return out


def suffix_array(words: np.ndarray, ends: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The given suffixes in the order of their first `depth` words, and those words (0 beyond the end of the text)."""
    places = starts[:, None] + np.arange(depth)
    keys = np.where(places < ends[starts][:, None], words[np.minimum(places, len(words) - 1)], 0)
    order = np.lexsort(keys.T[::-1])
    return starts[order], keys[order]


def bounds(keys: np.ndarray, wanted: np.ndarray, lengths: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all wanted suffixes at once: for each the first sorted key that is not below (upper: that is above) it,
    compared over its length."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys))
    beyond = np.arange(keys.shape[1]) >= lengths[:, None]
    while (open_ := low < high).any():
        middle = (low + high) // 2
        there = keys[np.minimum(middle, len(keys) - 1)]
        differs = (there != wanted) & ~beyond
        first = differs.argmax(1)
        rows = np.arange(len(wanted))
        same = ~differs[rows, first]
        below = np.where(same, upper, there[rows, first] < wanted[rows, first])
        low = np.where(open_ & below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)
    return low


def _match_length(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differs = np.flatnonzero((a[:n] != b[:n]) | (a[:n] == 0))
    return int(differs[0]) if len(differs) else n


def _matches(items: Items, words: np.ndarray, ends: np.ndarray):
    """(place, length in words, item, longest match) of every occurrence of a window of an item in the shard's words.

    ends: for each word the end of its text, beyond which nothing matches.
    """
    # known words in a row from each place on, within its text
    places = np.arange(len(words))
    stops = np.minimum.accumulate(np.where(words > 0, len(words), places)[::-1])[::-1]
    run = np.minimum(stops, ends) - places
    starts = np.flatnonzero(run >= items.least)
    if not len(starts):
        return
    order, keys = suffix_array(words, ends, starts, items.window)
    first = bounds(keys, items.wanted, items.lengths, upper=False)
    last = bounds(keys, items.wanted, items.lengths, upper=True)
    for k in np.flatnonzero(last > first):
        number, at = items.suffixes[k]
        for place in order[first[k] : last[k]]:
            yield int(place), int(items.lengths[k]), number, _match_length(words[place : ends[place]], items.words[number][at:])


def item_blocks(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """Broadcasts of the benchmark's items, at most block_bytes each (a larger item stands alone); one of nothing for no items."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    blocks = in_blocks(rows, F.coalesce(F.octet_length("text"), F.lit(0)) + 64, block_bytes) or [[]]
    context = docs.sparkSession.sparkContext
    return [context.broadcast(Items([(r["item_id"], r["text"]) for r in block], window)) for block in blocks]


def _found(items: Items, column: pa.Array) -> Iterator[tuple[int, list[list[tuple[int, int, int, int]]]]]:
    """For each text its number of words and its matches (first word, words, item, longest match there)."""
    for _, data, offsets in pieces(column):
        data = lower(data)
        starts, ends, firsts = word_spans(data, offsets, ALPHANUMERIC)
        numbers = items.number(span_codes(prefix_codes(data), starts, ends))
        counts = np.diff(firsts)
        owner = np.repeat(np.arange(len(counts)), counts)
        found: dict[int, list] = {}
        for place, length, item, most in _matches(items, numbers, firsts[1:][owner]):
            found.setdefault(int(owner[place]), []).append((place - int(firsts[owner[place]]), length, item, most))
        for i, n in enumerate(counts.tolist()):
            yield n, found.get(i, [])


def _searched(broadcast, at: int, schema: pa.Schema, fresh: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = broadcast.value
        names = schema.names[-4:]
        for batch in batches:
            counts, spans, hits, longest = [], [], [], []
            for n, own in _found(items, batch.column(at)):
                counts.append(n)
                spans.append([{"start": a, "end": a + k} for a, k, _, _ in own])
                hits.append(sorted({items.ids[item] for _, _, item, _ in own if items.ids[item] is not None}))
                longest.append(max((m for *_, m in own), default=0))
            given = batch.columns
            if not fresh:  # what earlier blocks of items found stays
                given = given[:-4]
                spans = [a + b for a, b in zip(batch.column(names[1]).to_pylist(), spans)]
                hits = [sorted({*a, *b}) for a, b in zip(batch.column(names[2]).to_pylist(), hits)]
                longest = [max(a, b) for a, b in zip(batch.column(names[3]).to_pylist(), longest)]
            more = [pa.array(x, schema.field(k).type) for k, x in zip(names, (counts, spans, hits, longest))]
            yield pa.RecordBatch.from_arrays([*(c.cast(schema.field(i).type) for i, c in enumerate(given)), *more], schema=schema)

    return lean(search)


def with_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with _n_words, _spans (word ranges of every occurrence of a window of an item), _items (ids of items with one) and
    _longest (words of the longest verbatim match); columns of these names are replaced, all others pass through.

    A null text has no words and an item without words no window. Items that repeat count by id; an item without an id hits
    words but is not listed. An empty benchmark hits nothing, rows that repeat are hit alike.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
    more = [StructField("_n_words", LongType()), StructField("_spans", ArrayType(span)), StructField("_items", ArrayType(LongType())), StructField("_longest", LongType())]
    found = docs.drop(*(f.name for f in more))
    out = StructType([*found.schema.fields, *more])
    at = found.columns.index("text")
    for i, items in enumerate(item_blocks(docs, benchmark, window, block_bytes)):
        found = found.mapInArrow(_searched(items, at, to_arrow_schema(out), fresh=i == 0), out)
    return found


def hit_words() -> F.Column:
    """Words under the union of _spans: sorted ranges, each counted from where those before it end."""
    state = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["upto"], x["end"]).alias("upto"), (s["n"] + F.greatest(x["end"] - F.greatest(s["upto"], x["start"]), F.lit(0))).alias("n"))
    return F.aggregate(F.array_sort("_spans"), state, step, lambda s: s["n"])


def _clean(broadcast, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not own for _, own in _found(broadcast.value, batch.column(at))], pa.bool_()))

    return lean(run)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with their columns, in which no window of any item occurs; null texts stay."""
    for items in item_blocks(docs, benchmark, window, block_bytes):
        docs = docs.mapInArrow(_clean(items, docs.columns.index("text")), docs.schema)
    return docs
