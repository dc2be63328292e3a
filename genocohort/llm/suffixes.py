"""Exact-substring dedup: removes every byte inside a string of LENGTH bytes that also starts anywhere else.

A suffix matters by its first LENGTH bytes, and stands in a row as its leading tokens, 64-bit codes of half of them each. Few
suffixes need sorting. Every window of LENGTH bytes has an anchor, the string of CORE bytes in it with the smallest code: equal
windows have equal anchors at equal places. Successive windows with one anchor form a stretch. Stretches that are equal as a
whole are counted first (pre-aggregation: copies of texts end here), and an anchor that stands in one stretch only cannot match.
Stretches that share an anchor with a different one are cut into pieces of PIECE windows, at places fixed by the anchor, and
pieces are counted alike, by what all their windows share. The windows of what is still open are sorted: sampled splitters
range-partition the suffixes by leading tokens, buckets sort locally by multikey quicksort, neighbours are compared, and buckets
across their boundaries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .shared import may_hold, membership_filter, stored
from .words import mixed, pieces, prefix_codes, span_codes

LENGTH, CORE = 400, 200
PIECE = 16
#: Low bits of an anchor's code that give way to its place, so that a minimum finds both: more than any text has bytes.
PLACE_BITS = 31


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, core: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor) of every stretch in a row of texts, and the prefix codes of the bytes.

    Of equal codes in a window the leftmost is the anchor, so what a window holds alone decides.
    """
    n = len(data)
    m = n - core + 1
    if n < length:
        return (*[np.zeros(0, np.int64)] * 4, np.zeros(n + 1, np.uint64))
    codes = prefix_codes(data)
    places = np.arange(m)
    keys = span_codes(codes, places, places + core)
    bits = np.uint64(PLACE_BITS)
    keys = (keys >> bits << bits) | places.astype(np.uint64)
    # sliding minimum: from each place to the end of its block, and from the block's begin to each place
    width = length - core + 1
    padded = np.concatenate([keys, np.full(-m % width, 2**64 - 1, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(padded, 1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(right[:windows], left[width - 1 : width - 1 + windows])
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    valid = np.arange(windows) + length <= offsets[1:][owner]
    changes = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(valid & np.concatenate([[True], changes | ~valid[:-1]]))
    last = np.flatnonzero(valid & np.concatenate([changes | ~valid[1:], [True]]))
    return owner[first], first, last, anchor[first], codes


def _stretch_rows(length: int, core: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in pieces(batch.column(1)):
                owner, first, last, anchor, codes = stretches(data, offsets, length, core)
                if len(owner):
                    middle, whole = span_codes(codes, anchor, anchor + core), span_codes(codes, first, last + length)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(owner + row)), pa.array(middle.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(first - offsets[owner]), pa.array((last - first + 1).astype(np.int32))],
                        names=["key", "core", "whole", "first", "n"],
                    )

    return run


def _identity(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    return mixed(keys.view(np.uint64) + mixed(first.astype(np.uint64)))


def _identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = _identity(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64))], names=["id"])


def _chosen_pieces(batch: pa.RecordBatch, length: int, core: int, texts, chosen):
    """For a batch of (key, text): keys, row, offsets, prefix codes, and the pieces (text, first, last, anchor) of chosen stretches."""
    batch = batch.filter(pa.array(may_hold(texts, mixed(batch.column(0).to_numpy().view(np.uint64)))))
    keys = batch.column(0).to_numpy()
    for row, data, offsets in pieces(batch.column(1)):
        owner, first, last, anchor, codes = stretches(data, offsets, length, core)
        kept = np.flatnonzero(may_hold(chosen, _identity(keys[row + owner], first - offsets[owner])))
        if not len(kept):
            continue
        owner, first, last, anchor = owner[kept], first[kept], last[kept], anchor[kept]
        # pieces by the distance from window to anchor, so that equal windows fall into equal pieces
        low, high = (anchor - last) // PIECE, (anchor - first) // PIECE
        n = high - low + 1
        upto = np.cumsum(n)
        step = np.repeat(low, n) + np.arange(upto[-1]) - np.repeat(upto - n, n)
        owner, anchor = np.repeat(owner, n), np.repeat(anchor, n)
        top = anchor - step * PIECE  # last window of the whole piece
        yield keys[row + owner], offsets[owner], codes, np.maximum(np.repeat(first, n), top - PIECE + 1), np.minimum(np.repeat(last, n), top), top, step


def _piece_rows(length: int, core: int, texts, chosen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, begin, codes, first, last, top, step in _chosen_pieces(batch, length, core, texts.value, chosen.value):
                middle = span_codes(codes, top, top - PIECE + 1 + length) + step.astype(np.uint64)  # what all windows of the piece share
                whole = span_codes(codes, first, last + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(middle.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(first - begin), pa.array((last - first + 1).astype(np.int32))],
                    names=["key", "core", "whole", "first", "n"],
                )

    return run


def _suffix_rows(length: int, core: int, texts, chosen, cut):
    """(lead, next, key, place): the leading tokens of every suffix that starts a window of a piece in cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, begin, codes, first, last, _, _ in _chosen_pieces(batch, length, core, texts.value, chosen.value):
                kept = np.flatnonzero(may_hold(cut.value, _identity(keys, first - begin)))
                if len(kept):
                    n = (last - first + 1)[kept]
                    upto = np.cumsum(n)
                    at = np.repeat(first[kept] - (upto - n), n) + np.arange(upto[-1])
                    own = np.repeat(kept, n)
                    half = length // 2
                    tokens = [span_codes(codes, at, at + half), span_codes(codes, at + half, at + length)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(t.view(np.int64)) for t in tokens), pa.array(keys[own]), pa.array(at - begin[own])], names=["lead", "next", "key", "place"])

    return run


def multikey_sorted(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by several tokens, and where a run of equal rows begins in it.

    Quicksort by the first token; rows that tie form runs, and only those are sorted on, by the next token.
    """
    order = np.argsort(tokens[0], kind="quicksort")
    new = np.concatenate([[True], np.diff(tokens[0][order]) != 0]) if len(order) else np.zeros(0, bool)
    for token in tokens[1:]:
        run = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(run)[run] > 1) if len(run) else np.zeros(0, np.int64)
        if not len(tied):
            break
        values = token[order[tied]]
        inner = np.argsort(values, kind="quicksort")
        inner = inner[np.argsort(run[tied][inner], kind="stable")]
        order[tied] = order[tied[inner]]
        values, runs = values[inner], run[tied]
        new[tied[1:]] |= (np.diff(values) != 0) & (np.diff(runs) == 0)
    return order, new


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes with an equal neighbour in the bucket (count 0), and the runs at the bucket's ends with their counts."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    lead, following = rows.column("lead").to_numpy(), rows.column("next").to_numpy()
    order, new = multikey_sorted([lead, following])
    run = np.cumsum(new) - 1
    sizes = np.bincount(run)
    found = order[sizes[run] > 1]
    begins = np.flatnonzero(new)
    ends = sorted({0, len(begins) - 1})
    edge = order[begins[ends]]
    take = rows.take(pa.array(np.concatenate([found, edge])))
    counts = np.concatenate([np.zeros(len(found), np.int64), sizes[ends]])
    yield pa.RecordBatch.from_arrays([*(take.column(c).combine_chunks() for c in ("lead", "next", "key", "place")), pa.array(counts)], names=["lead", "next", "key", "place", "count"])


ROWS = "key long, core long, whole long, first long, n int"


def _settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From stretches or pieces: runs of windows that repeat with their whole stretch, (key, first, n), and one (key, first) of
    each kind of stretch that shares its core with another kind, at least one of them single."""
    kinds = stored(rows.groupBy("core", "whole").agg(F.count("*").alias("rows"), F.min(F.struct("key", "first")).alias("one")), "kinds")
    mixed_cores = kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.min("rows").alias("least")).where("kinds > 1 AND least = 1").select("core")
    open_ = stored(kinds.join(mixed_cores, "core", "left_semi").select("one.key", "one.first"), "open")
    runs = rows.join(kinds.where("rows > 1").select("core", "whole"), ["core", "whole"], "left_semi").select("key", "first", "n")
    return runs, open_


def repeated_windows(texts: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """(key, runs, masks) per text key with a repeated window: runs of window starts (first, n), and single ones as bit masks
    (word, mask) of 64 starts. texts: (key, text), key a hash of the text, a row for every document."""
    context = texts.sparkSession.sparkContext
    rows = stored(texts.mapInArrow(_stretch_rows(length, core), ROWS), "stretches")
    runs, open_ = _settled(rows)
    ids = context.broadcast(membership_filter(open_.mapInArrow(_identities, "id long")))
    keys = context.broadcast(membership_filter(open_.select("key").distinct().mapInArrow(_mixed_keys, "id long")))
    parts = stored(texts.mapInArrow(_piece_rows(length, core, keys, ids), ROWS), "pieces")
    more, open_ = _settled(parts)
    cut = context.broadcast(membership_filter(open_.mapInArrow(_identities, "id long")))
    suffixes = stored(texts.mapInArrow(_suffix_rows(length, core, keys, ids, cut), "lead long, next long, key long, place long"), "suffixes")
    # the last two columns part equal suffixes, of which there may be any number, over several buckets
    buckets = suffixes.repartitionByRange("lead", "next", "key", "place")
    compared = stored(buckets.mapInArrow(_compared, "lead long, next long, key long, place long, count long"), "compared")
    edges = compared.where("count > 0")
    across = edges.groupBy("lead", "next").agg(F.sum("count").alias("all")).where("all > 1")
    beyond = edges.where("count = 1").join(across, ["lead", "next"], "left_semi")
    single = compared.where("count = 0").unionByName(beyond).groupBy("key", F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("mask"))
    masks = single.groupBy("key").agg(F.collect_list(F.struct("word", "mask")).alias("masks"))
    # sets, as the rows of equal texts repeat one another's runs
    whole = runs.unionAll(more).groupBy("key").agg(F.collect_set(F.struct("first", "n")).alias("runs"))
    return whole.join(masks, "key", "full_outer")


def _mixed_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mixed(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], names=["id"])


def _covered(size: int, runs, masks, length: int) -> np.ndarray:
    """Which of a text's bytes a repeated window covers."""
    change = np.zeros(size + 1, np.int64)
    for r in runs or ():
        if r["first"] + r["n"] - 1 + length <= size:
            change[r["first"]] += 1
            change[r["first"] + r["n"] - 1 + length] -= 1
    for m in masks or ():
        bits = np.unpackbits(np.array([m["mask"]], "<i8").view(np.uint8), bitorder="little")
        starts = m["word"] * 64 + np.flatnonzero(bits)
        starts = starts[starts + length <= size]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + length, -1)
    return np.cumsum(change)[:size] > 0


def _cut(length: int, columns: list[str]):
    text_at, runs_at, masks_at = (columns.index(c) for c in ("text", "runs", "masks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            for row, data, offsets in pieces(batch.column(text_at)):
                n = len(offsets) - 1
                runs, masks = (batch.column(c).slice(row, n).to_pylist() for c in (runs_at, masks_at))
                for i in range(n):
                    own = data[offsets[i] : offsets[i + 1]]
                    removed = _covered(len(own), runs[i], masks[i], length) if runs[i] or masks[i] else np.zeros(len(own), bool)
                    kept = own[~removed].tobytes()
                    out["n_bytes"].append(len(own))
                    out["n_removed"].append(int(removed.sum()))
                    out["n_spans"].append(int((removed & ~np.concatenate([[False], removed[:-1]])).sum()) if len(own) else 0)
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def digests(docs: DataFrame, length: int = LENGTH, core: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of (doc_id, text): what is left of its bytes.

    Bytes are those of UTF-8; null is the empty text; a text shorter than `length` stays whole. Rows that repeat remove each
    other's strings, rows that share an id too: every row is a document. Texts go by a 64-bit hash.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    found = repeated_windows(keyed.where(F.octet_length("text") >= length).select("key", "text"), length, core or length // 2)
    joined = keyed.join(found, "key", "left").select("doc_id", "text", "runs", "masks")
    kept = StructType([docs.schema["doc_id"], *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept_sha256", StringType())])
    return joined.mapInArrow(_cut(length, joined.columns), kept)
