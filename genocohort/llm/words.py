"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text stands alone.
PIECE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODES = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes that are part of a word: all but the given ranges."""
    inside = np.ones(256, bool)
    for first, last in excluded:
        inside[first : last + 1] = False
    return inside


#: `[^\x20\x09-\x0D]+` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
SPACED = byte_class([(0x20, 0x20), (0x09, 0x0D)])
ALPHANUMERIC = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; null is the empty text."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, from 0 to n."""
    global _powers, _inverses
    if len(_powers) <= n:
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            steps = np.full(n + 1, base)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _powers, _inverses


def prefix_codes(data: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] standing for bytes i to j, up to the power of i."""
    power, _ = powers(len(data))
    codes = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * power[: len(data)], out=codes[1:])
    return codes


def span_codes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes: equal bytes give equal values."""
    _, inverse = powers(len(codes))
    return mixed((codes[ends] - codes[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (with the total at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], mask[:-1]])
    after = np.concatenate([mask[1:], [False]])
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[data]


#: Points that end a word, and letters before which one opens a chunk of its own.
POINTS = b".,;:!?"
_POINT, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_POINT[list(POINTS)] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The texts cut before each word, as (number of each chunk, distinct chunks by number, chunks of each text).

    A chunk is a run of other bytes than white space with the white space behind it, which is cut off from the distinct ones; white
    space that opens a text is a chunk of its own, of nothing. A point behind a letter of ASCII opens a chunk too, so that a word
    with and without one is the same chunk.
    """
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), [], np.zeros(n, np.int64)
    inside = SPACED[data]
    opens = np.zeros(len(data) + 1, bool)
    opens[1:-1] = (inside[1:] & ~inside[:-1]) | (_POINT[data[1:]] & _LETTER[data[:-1]])
    opens[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(opens[:-1])
    borders = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, borders, pa.py_buffer(data)])
    numbered = column.dictionary_encode()
    return numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64), [c.rstrip(b" \t\n\v\f\r") for c in numbered.dictionary.to_pylist()], np.diff(np.searchsorted(starts, offsets))


def gathered(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The given stretches of values, one after the other."""
    upto = np.cumsum(lengths)
    total = int(upto[-1]) if len(upto) else 0
    return values[np.repeat(begins - (upto - lengths), lengths) + np.arange(total)]


def room(held: np.ndarray, size: int) -> np.ndarray:
    """The array, made longer where it does not hold size entries."""
    return held if size <= len(held) else np.concatenate([held, np.zeros(max(size - len(held), len(held)), held.dtype)])


class Sequences:
    """Numbered sequences of unsigned 32-bit integers, one after the other in one array; number 0 is the empty one."""

    def __init__(self):
        self.values = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 12, np.int64)
        self.count = 1

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        """Sequences of the given lengths, one after the other in values, under the next numbers."""
        used = int(self.ends[self.count - 1])
        self.ends = room(self.ends, self.count + len(lengths))
        self.ends[self.count : self.count + len(lengths)] = used + np.cumsum(lengths)
        self.values = room(self.values, used + len(values))
        self.values[used : used + len(values)] = values
        self.count += len(lengths)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the numbered sequences one after the other, length of each)."""
        begins = np.where(numbers > 0, self.ends[np.maximum(numbers, 1) - 1], 0)
        lengths = np.where(numbers > 0, self.ends[numbers] - begins, 0)
        return gathered(self.values, begins, lengths), lengths


def sums_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of the next counts[0], counts[1], ... values."""
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return upto[ends] - upto[ends - counts]
