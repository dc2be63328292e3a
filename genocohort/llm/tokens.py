"""Token ids in directly addressable codes, and back.

An id is cut into chunks of 8 bits. Level 0 holds the low chunk of every id; a continuation bitmap marks the ids that go on,
whose next chunks make up level 1, and so on up to four levels (ids below 2^32). A rank directory counts the marks before every
512th position, so token i is found by one look into each level: no block is decoded to reach a token.

Files: one row per block of consecutive documents, written by Spark in ascending doc_id order, so that a lost executor's file is
written again whole. `shard` is the range partition, `at` the ids before the block in its shard; the ids before a shard follow
from the shards' totals, a table of one row per file.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, stored
from .words import POINTS, Sequences, chunked, pieces, sums_of

#: Ids of a block; a longer document makes a larger block of its own.
BLOCK_IDS = 1 << 20
#: Positions of one entry of the rank directory.
RANK_STEP = 512
#: Chunks of text whose ids a worker remembers; when full it starts anew.
REMEMBERED = 700_000
#: Bytes of text cut into chunks at once.
AT_ONCE = 1 << 21
END_ID = 1

LEVELS = 4
FILE_SCHEMA = "shard int, block int, at long, n_ids long, doc_ids array<long>, nulls array<int>, ends array<long>, " + ", ".join(
    f"level{i} binary, bits{i} binary, ranks{i} binary" for i in range(LEVELS)
)
FILE_ARROW = pa.schema(
    [("shard", pa.int32()), ("block", pa.int32()), ("at", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("nulls", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64()))]
    + [(f"{part}{i}", pa.binary()) for i in range(LEVELS) for part in ("level", "bits", "ranks")]
)


def encoded(ids: np.ndarray) -> dict[str, bytes]:
    """Levels, continuation bitmaps and rank directories of the ids (unsigned 32-bit)."""
    out: dict[str, bytes] = {}
    rest = ids.astype(np.uint32)
    for i in range(LEVELS):
        out[f"level{i}"] = (rest & np.uint32(255)).astype(np.uint8).tobytes()
        goes_on = rest > 255
        counts = np.concatenate([[0], np.cumsum(np.add.reduceat(goes_on.astype(np.int64), np.arange(0, len(rest), RANK_STEP)))[:-1]]) if len(rest) else np.zeros(0)
        out[f"bits{i}"] = np.packbits(goes_on, bitorder="little").tobytes()
        out[f"ranks{i}"] = counts.astype("<u4").tobytes()
        rest = rest[goes_on] >> np.uint32(8)
    return out


def decoded(block) -> np.ndarray:
    """All ids of a block, level by level from the top."""
    higher = np.zeros(0, np.uint32)
    for i in reversed(range(LEVELS)):
        low = np.frombuffer(block[f"level{i}"], np.uint8).astype(np.uint32)
        goes_on = np.unpackbits(np.frombuffer(block[f"bits{i}"], np.uint8), count=len(low), bitorder="little").astype(bool)
        low[goes_on] |= higher << np.uint32(8)
        higher = low
    return higher


def token_at(block, position: int) -> int:
    """The id at a position of a block, from one chunk, bit and rank of each level."""
    value = 0
    for i in range(LEVELS):
        value |= block[f"level{i}"][position] << (8 * i)
        bits = block[f"bits{i}"]
        if not bits[position >> 3] >> (position & 7) & 1:
            break
        step = position // RANK_STEP
        rank = int.from_bytes(block[f"ranks{i}"][4 * step : 4 * step + 4], "little")
        rank += int.from_bytes(bits[step * RANK_STEP // 8 : position >> 3], "little").bit_count()
        position = rank + (bits[position >> 3] & ((1 << (position & 7)) - 1)).bit_count()
    return value


#: Texts by which a tokenizer shows that white space parts its tokens, and points behind letters do.
_PROBES = ["one", "two,", "3", "'s", "été", "!", "<|endoftext|>", "Four"]


class _Memory:
    """Chunks met so far, numbered, and their ids in one array."""

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        apart = [i for p in _PROBES for i in ids(p)]
        parted = all(ids(space + "".join(p + space for p in _PROBES)) == apart for space in (" ", "\n", "  \t", "\r\n", "\v\f"))
        for point in POINTS.decode():
            parted &= all(ids(word + point + rest) == ids(word) + ids(point + rest) for word in ("word", "A", "it's") for rest in ("", "x", ".!", "'s", "3"))
        if not parted:
            raise ValueError(f"{tokenizer_path} does not part its tokens at white space and points")
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or ""
        self.bytes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.bytes[number] = len(token.removesuffix(suffix))
        self.clear()

    def clear(self) -> None:
        self.known, self.ids = {b"": 0}, Sequences()

    def _together(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of chunks of ASCII encoded as one text, and ids of each: the bytes of tokens add up to those of the chunks, or else None."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(chunks).decode()], add_special_tokens=False)[0].ids, np.uint32)
        upto = np.concatenate([[0], np.cumsum(self.bytes[ids])])
        ends = np.cumsum([len(c) for c in chunks])
        at = np.searchsorted(upto, ends)
        if at[-1] != len(ids) or (upto[at] != ends).any():
            return None
        return ids, np.diff(np.concatenate([[0], at]))

    def _apart(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum())), lengths

    def add(self, chunks: list[bytes]) -> None:
        plain = [c for c in chunks if c.isascii() and b"<" not in c]
        other = [c for c in chunks if not c.isascii() or b"<" in c]
        for held, first in ((plain, self._together), (other, self._apart)):
            for i in range(0, len(held), 5_000):
                some = held[i : i + 5_000]
                ids, lengths = first(some) or self._apart(some)
                self.known.update(zip(some, range(self.ids.count, self.ids.count + len(some))))
                self.ids.add(ids, lengths)


_memories: dict[str, _Memory] = {}


def text_encoder(tokenizer_path: str) -> Callable[[pa.Array], Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Encodes a column to (all ids, ids of each text) of some consecutive texts, by their chunks, each encoded once.

    Only for tokenizers whose splitting never joins what white space or a point behind a letter parts (another raises ValueError): a text's ids are then
    those of its chunks in order. Chunks stay remembered while the worker lives.
    """
    if tokenizer_path not in _memories:
        _memories[tokenizer_path] = _Memory(tokenizer_path)
    memory = _memories[tokenizer_path]

    def encode(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, data, offsets in pieces(column, AT_ONCE):
            if len(memory.known) > REMEMBERED:
                memory.clear()
            numbers, distinct, counts = chunked(data, offsets)
            if new := [c for c in dict.fromkeys(distinct) if c not in memory.known]:
                memory.add(new)
            known = np.fromiter(map(memory.known.__getitem__, distinct), np.int64, len(distinct))
            ids, lengths = memory.ids.of(known[numbers] if len(numbers) else numbers)
            yield ids, sums_of(lengths, counts)

    return encode


def _blocks(tokenizer_path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = text_encoder(tokenizer_path)
        shard, number, at = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        n = 0

        def block() -> pa.RecordBatch:
            nonlocal number, at, n
            ends = np.cumsum([len(x) for x in held])
            row = {"shard": shard, "block": number, "at": at, "n_ids": n, "doc_ids": [0 if x is None else x for x in names], "nulls": [i for i, x in enumerate(names) if x is None], "ends": ends}
            row |= encoded(np.concatenate(held))
            number, at, n = number + 1, at + n, 0
            held.clear()
            names.clear()
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in FILE_ARROW], schema=FILE_ARROW)

        for batch in batches:
            first = 0
            for ids, counts in encode(batch.column(1)):
                for name, own in zip(batch.column(0).slice(first, len(counts)).to_pylist(), np.split(ids, np.cumsum(counts)[:-1])):
                    if held and n + len(own) + 1 > BLOCK_IDS:
                        yield block()
                    held.append(np.append(own, np.uint32(end_id)))
                    names.append(name)
                    n += len(own) + 1
                first += len(counts)
        if held:
            yield block()

    return lean(write)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Encodes (doc_id, text) with a tokenizers file in ascending doc_id order (null ids first, ties by text), writes the
    blocks, and gives the written table.

    A null or empty text has the end id alone; rows that repeat are each written; an empty table writes no block.
    """
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(ordered.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks(tokenizer_path, end_id), FILE_SCHEMA), "tokens")


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for block in batch.to_dict("records"):
            data = decoded(block).astype("<u4").tobytes()
            ends = np.asarray(block["ends"], np.int64)
            begins = np.concatenate([[0], ends[:-1]])
            names = pd.array(block["doc_ids"], "Int64")
            names[np.asarray(block["nulls"], np.int64)] = pd.NA
            yield pd.DataFrame({
                "doc_id": names, "shard": block["shard"], "_start": begins + block["at"], "n_tokens": ends - begins,
                "ids_crc32": [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins, ends)],
            })


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    # one row per file
    before = shards.select("shard", F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    read = files.mapInPandas(_documents, "doc_id long, shard int, _start long, n_tokens long, ids_crc32 long")
    return read.join(before, "shard").select("doc_id", (F.col("_before") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")
