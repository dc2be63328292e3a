"""BPE encoding and decoding by forced boundaries.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be merged over: between the two every
encoding has a cut. A table of all 65,536 pairs says which those are. White space parts tokens wherever it stands, so texts are first
cut there, into chunks; each distinct chunk is normalised and split as the tokenizer's file says, and the bytes of all its parts are
cut at the part's ends and at every forbidden pair. The fragments between cuts do not influence one another: each distinct one is
merged once, by rank and from the left, and a text's ids are those of its fragments in order.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .words import POINTS, Sequences, chunked, pieces, sums_of

#: Chunks and fragments a worker remembers, and their bytes; when either is exceeded it starts anew.
REMEMBERED, REMEMBERED_BYTES = 400_000, 1 << 24
#: Bytes of text cut into chunks at once.
AT_ONCE = 1 << 21
#: Fragments up to this length are merged side by side, longer ones each on its own queue.
SHORT = 48
#: White space of the expression language of tokenizer files.
SPACE = r"\u0009-\u000D \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


@dataclass(frozen=True)
class Letters:
    """Letters as the tokenizers library knows them, whose Unicode version may be newer than Python's."""

    classes: dict[str, str]  # ranges of letters and of numbers, as sets of an expression
    lower: dict[int, str]  # small letters that Python does not know


@lru_cache(maxsize=1)
def library_letters() -> Letters:
    """Found by the library's own expressions and lower-casing among all code points; worked out once by the driver and handed to the
    workers. Compositions (NFC) are those of Python's Unicode version."""
    from tokenizers import Regex
    from tokenizers.normalizers import Lowercase
    from tokenizers.pre_tokenizers import Split

    every = "".join(chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000)
    runs = {k: Split(Regex(k + "+"), "removed", invert=True).pre_tokenize_str(every) for k in (r"\p{L}", r"\p{N}")}
    fresh = [c for c in every if unicodedata.category(c) == "Cn"]
    lowered = Lowercase().normalize_str("\n".join(fresh)).split("\n")
    classes = {k: "".join(f"\\U{ord(x[0]):08X}-\\U{ord(x[-1]):08X}" for x, _ in found) for k, found in runs.items()}
    return Letters(classes, {ord(c): small for c, small in zip(fresh, lowered) if c != small})


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """What a tokenizer file says. Only files whose tokens never hold white space, with a byte-level alphabet and no decoder, are
    read; another raises ValueError, as its texts could not be cut at white space."""

    def __init__(self, path: str, letters: Letters):
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model, steps = given["model"], (given.get("pre_tokenizer") or {}).get("pretokenizers", [])
        normal = [(x["type"], (x.get("pattern") or {}).get("Regex"), x.get("content")) for x in (given.get("normalizer") or {}).get("normalizers", [])]
        known = (
            normal == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]
            and [x["type"] for x in steps] == ["Split", "ByteLevel"]
            and (steps[0]["behavior"], steps[0]["invert"], steps[1]["add_prefix_space"], steps[1]["use_regex"]) == ("Removed", True, False, False)
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and given.get("post_processor") is None
            and given.get("decoder") is None
            and not any(x[k] for x in given["added_tokens"] for k in ("normalized", "lstrip", "rstrip", "single_word"))
        )
        if not known:
            raise ValueError(f"{path} is not a byte-level vocabulary whose tokens white space parts")
        self.suffix = model["end_of_word_suffix"] or ""
        pattern = steps[0]["pattern"]["Regex"].replace(r"\s", SPACE)
        for name, ranges in letters.classes.items():
            pattern = pattern.replace(name, ranges)
        #: a part, or the line end that stands between chunks
        self.part = re.compile(f"{pattern}|\n")
        #: sigma first: letters are lowered one by one, so a final one is no other letter
        self.small = letters.lower | {0x3A3: "\u03c3"}
        vocabulary: dict[str, int] = model["vocab"]
        alphabet = byte_letters()
        self.inner = np.array([vocabulary[c] for c in alphabet], np.uint32)
        self.last = np.array([vocabulary[c + self.suffix] for c in alphabet], np.uint32)
        #: (left, right) -> (rank, merged)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((vocabulary[a], vocabulary[b]), (rank, vocabulary[a + b]))
        #: the same as sorted pairs; the last rank is that of no merge
        pairs = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(pairs)
        self.pairs = pairs[order]
        self.ranks = np.append(np.array([x[0] for x in self.merges.values()], np.int64)[order], len(model["merges"]))
        self.results = np.zeros(len(model["merges"]) + 1, np.int64)
        self.results[self.ranks[:-1]] = np.array([x[1] for x in self.merges.values()], np.int64)[order]
        self.added: dict[str, int] = {x["content"]: x["id"] for x in given["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        #: texts are cut at points behind letters too: no token may hold such a pair, and the rules have to part them
        probes = [(f"{a}{p}{z}", [a, *self.part.findall(p + z)]) for a in ("ab", "z") for p in POINTS.decode() for z in ("", "x", "'s", "3", ".!")]
        value = {c: b for b, c in enumerate(alphabet)}
        self.joins = np.zeros(1 << 16, bool)
        for token in vocabulary:
            inside = [value[c] for c in token.removesuffix(self.suffix)]
            for pair in zip(inside, inside[1:]):
                self.joins[pair[0] << 8 | pair[1]] = True
        letters_and_points = [a << 8 | p for a in range(97, 123) for p in POINTS]
        if self.joins[letters_and_points].any() or any(self.part.findall(text) != parts for text, parts in probes):
            raise ValueError(f"{path} does not part points from letters")

    def parts(self, chunks: list[bytes]) -> list[str | int]:
        """Parts of the chunks as the file's rules split them, normalised, an added token as its id, and a line end behind each chunk."""
        out: list[str | int] = []
        for k, piece in enumerate(self.special.split(text) if (text := (b"\n".join(chunks) + b"\n").decode()) and self.special else [text]):
            if k % 2:
                out.append(self.added[piece])
            else:
                out += self.part.findall((piece if piece.isascii() else unicodedata.normalize("NFC", piece).translate(self.small)).lower())
        return out

    def cuts(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where fragments end in the bytes of parts that end at `ends`: there, and at every pair that no token holds."""
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ~self.joins[data[:-1].astype(np.int64) << 8 | data[1:]]
        cut[ends] = True
        return np.flatnonzero(cut[1:]) + 1

    def symbols(self, fragment: bytes, closes: bool) -> np.ndarray:
        ids = self.inner[np.frombuffer(fragment, np.uint8)].astype(np.int64)
        if closes:
            ids[-1] = self.last[fragment[-1]]
        return ids

    def merged(self, fragment: bytes, closes: bool) -> list[int]:
        """Ids of one fragment: merges by rank, the leftmost first; closes: it ends a part."""
        ids = self.symbols(fragment, closes).tolist()
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        queue = [(*m, i) for i, pair in enumerate(zip(ids, ids[1:])) if (m := self.merges.get(pair))]
        queue = [(rank, i, new) for rank, new, i in queue]
        heapq.heapify(queue)
        while queue:
            rank, i, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j < 0 or self.merges.get((ids[i], ids[j])) != (rank, new):
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if m := self.merges.get((new, ids[after[i]])):
                    heapq.heappush(queue, (m[0], i, m[1]))
            if before[i] >= 0 and (m := self.merges.get((ids[before[i]], new))):
                heapq.heappush(queue, (m[0], before[i], m[1]))
        return [x for x in ids if x >= 0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.searchsorted(self.pairs, wanted)
        found = np.minimum(at, len(self.pairs) - 1)
        return np.where(self.pairs[found] == wanted, self.ranks[found], self.ranks[-1])

    def merged_all(self, fragments: list[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all fragments one after the other, ids of each): one merge of every unfinished short fragment a round."""
        lengths = np.fromiter((len(f) for f, _ in fragments), np.int64, len(fragments))
        short = np.flatnonzero(lengths <= SHORT)
        data = np.frombuffer(b"".join(fragments[i][0] for i in short), np.uint8)
        own = lengths[short]
        ends = np.cumsum(own)
        width = int(own.max()) if len(own) else 0
        # one row a fragment, filled from the left, -1 behind its end
        ids = np.full((len(short), width + 1), -1, np.int64)
        row = np.repeat(np.arange(len(short)), own)
        ids[row, np.arange(len(data)) - (ends - own)[row]] = self.inner[data]
        closing = np.fromiter((fragments[i][1] for i in short), bool, len(short))
        ids[np.flatnonzero(closing), own[closing] - 1] = self.last[data[ends[closing] - 1]]
        none = int(self.ranks[-1])
        rank = np.where(ids[:, 1:] >= 0, self._rank(ids[:, :-1], ids[:, 1:]), none) if width else np.zeros((len(short), 0), np.int64)
        open_ = np.arange(len(short)) if width else np.zeros(0, np.int64)
        places = np.arange(width)
        while len(open_):
            ranks = rank[open_]
            at = ranks.argmin(1)  # the first of the least ones: the leftmost
            best = ranks[np.arange(len(open_)), at]
            going = best < none
            open_, at, best, ranks = open_[going], at[going], best[going], ranks[going]
            if not len(open_):
                break
            symbols = ids[open_]
            # what stands right of the merged pair moves one place to the left
            moved = places[None, :] > at[:, None]
            symbols[:, :-1] = np.where(moved, symbols[:, 1:], symbols[:, :-1])
            symbols[np.arange(len(open_)), at] = self.results[best]
            symbols[:, -1] = -1
            ranks[:, :-1] = np.where(moved[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = none
            for k in (at - 1, at):
                some = np.flatnonzero(k >= 0)
                left, right = symbols[some, k[some]], symbols[some, k[some] + 1]
                ranks[some, k[some]] = np.where(right >= 0, self._rank(left, right), none)
            ids[open_], rank[open_] = symbols, ranks
        counts = np.zeros(len(fragments), np.int64)
        counts[short] = (ids >= 0).sum(1)
        if len(short) == len(fragments):
            return ids[ids >= 0].astype(np.uint32), counts
        flat = dict(zip(short.tolist(), (x[x >= 0] for x in ids)))
        flat |= {int(i): np.array(self.merged(*fragments[i]), np.int64) for i in np.flatnonzero(lengths > SHORT)}
        counts = np.fromiter((len(flat[i]) for i in range(len(fragments))), np.int64, len(fragments))
        return np.concatenate([flat[i] for i in range(len(fragments))]).astype(np.uint32), counts


class Encoder:
    """Encodes columns of texts, remembering chunks and fragments."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.chunks: dict[bytes, int] = {b"": 0}
        self.fragments: dict[tuple[bytes, bool], int] = {}
        self.chunk_ids, self.fragment_ids, self.bytes = Sequences(), Sequences(), 0

    def _fragments(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the fragments of all parts in order, fragments of each part)."""
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        data = np.frombuffer(b"".join(parts), np.uint8)
        cuts = np.concatenate([[0], self.vocabulary.cuts(data, ends)])
        closes = np.zeros(len(data) + 1, bool)
        closes[ends] = True
        numbered = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        twice = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + closes[cuts[1:]]
        distinct, places = np.unique(twice, return_inverse=True)
        texts = numbered.dictionary.to_pylist()
        keys = [(texts[k >> 1], bool(k & 1)) for k in distinct.tolist()]
        if new := [k for k in keys if k not in self.fragments]:
            self.fragments.update(zip(new, range(self.fragment_ids.count, self.fragment_ids.count + len(new))))
            self.fragment_ids.add(*self.vocabulary.merged_all(new))
            self.bytes += sum(len(k[0]) for k in new)
        known = np.fromiter(map(self.fragments.__getitem__, keys), np.int64, len(keys))
        return known[places], np.diff(np.searchsorted(cuts[1:], np.concatenate([[0], ends]), "right"))

    def _learn(self, new: list[bytes]) -> None:
        """Ids of chunks not met before."""
        flat = self.vocabulary.parts(new)
        plain = [p.encode() for p in flat if p.__class__ is str and p != "\n"]
        kind = np.fromiter((2 if p.__class__ is int else p == "\n" for p in flat), np.int8, len(flat))
        every = np.where(kind == 2, 1, 0)
        ids = np.zeros(0, np.uint32)
        if plain:
            numbers, held = self._fragments(plain)
            ids, own = self.fragment_ids.of(numbers)
            every[kind == 0] = sums_of(own, held)
        if (kind == 2).any():
            upto = np.cumsum(every)
            added = upto[kind == 2] - 1
            mask = np.ones(int(upto[-1]), bool)
            mask[added] = False
            rest, ids = ids, np.zeros(len(mask), np.uint32)
            ids[mask], ids[added] = rest, [p for p in flat if p.__class__ is int]
        ends = np.flatnonzero(kind == 1) + 1
        self.chunks.update(zip(new, range(self.chunk_ids.count, self.chunk_ids.count + len(new))))
        self.chunk_ids.add(ids, sums_of(every, np.diff(np.concatenate([[0], ends]))))
        self.bytes += sum(map(len, new))

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some consecutive texts one after the other, ids of each); null is the empty text."""
        for _, data, offsets in pieces(column, AT_ONCE):
            if len(self.chunks) + len(self.fragments) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
                self.clear()
            numbers, distinct, counts = chunked(data, offsets)
            if new := [c for c in dict.fromkeys(distinct) if c not in self.chunks]:
                self._learn(new)
            known = np.fromiter(map(self.chunks.__getitem__, distinct), np.int64, len(distinct))
            ids, lengths = self.chunk_ids.of(known[numbers] if len(numbers) else numbers)
            yield ids, sums_of(lengths, counts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str, letters: Letters | None = None) -> Encoder:
    """A worker's encoder of a vocabulary file; what it remembers lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(Vocabulary(path, letters or library_letters()))
    return _encoders[path]


def _encoded(path: str, letters: Letters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for ids, counts in encoder(path, letters).encode(batch.column(0)):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.view(np.int32)))
                rest = batch.slice(first, len(counts))
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], lists], names=[*batch.schema.names[1:], "_ids"])
                first += len(counts)

    return run


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with _ids (array<int>), the ids of the column `text` under the vocabulary file at `path` (a place every executor has).

    Null and empty texts have no id, rows that repeat are encoded each, an empty table gives no row; a column _ids of docs is
    replaced, all others pass through. Special tokens in a text are their ids, none is added.
    """
    given = docs.drop("_ids").select(F.col(text).alias("_text_"), "*")
    kept = given.drop("_text_").schema
    return given.mapInArrow(_encoded(path, library_letters()), kept.add("_ids", ArrayType(IntegerType())))


@lru_cache(maxsize=2)
def token_texts(path: str) -> list[str]:
    """The text of each token by id; the ids of a file start at 0."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    known = {i: token for token, i in given["model"]["vocab"].items()} | {x["id"]: x["content"] for x in given["added_tokens"]}
    return [known.get(i, "") for i in range(1 + max(known))]


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = token_texts(path)
        for batch in batches:
            ids = batch.column(0)
            flat, offsets = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            for first in range(0, batch.num_rows, 500):
                rows = range(first, min(first + 500, batch.num_rows))
                texts = [" ".join(map(tokens.__getitem__, flat[offsets[i] : offsets[i + 1]].tolist())) for i in rows]
                rest = batch.slice(first, len(rows))
                yield pa.RecordBatch.from_arrays([*rest.columns[1:], pa.array(texts, pa.string())], names=[*batch.schema.names[1:], "_decoded"])

    return run


def decoded(docs: DataFrame, path: str, ids: str = "_ids") -> DataFrame:
    """docs with _decoded, the text of the column `ids`: the vocabulary's tokens parted by spaces, as a file without decoder says, special
    ones included. No ids (or null) give the empty text; a column _decoded of docs is replaced, all others pass through."""
    given = docs.drop("_decoded").select(F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("_ids_"), "*")
    kept = given.drop("_ids_").schema
    return given.mapInArrow(_decoded(path), kept.add("_decoded", StringType()))
