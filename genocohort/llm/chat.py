"""Chat formatting as prefix trees.

Conversations are sorted by their turns, so that those with the same first turns stand together. Walking down that order is a
depth-first walk of their prefix tree: a conversation emits only the turns that its predecessor does not begin with, and
points at the emitted text of its ancestors by intervals, which are also what its characters may attend to. Position ids run
along the path, not along the emitted text. A shard (range partition) is complete in itself, as a training file has to be: a
prefix that lies across a border of shards is emitted once in either.

A conversation may hold a large part of all rows, so what is sorted and emitted is a segment: at most SEGMENT turns in a row. Segments
after the first go by a hash of all that precedes them, so conversations that share it share them too; positions run on, and
the segment before it belongs to a segment's context. No conversation is ever one row; its digest is taken segment by segment.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genotype import whole
from ..operators.running import ordinal
from .shared import stored

OPEN, ROLE, TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
#: Every control string starts with one of these two; the third escapes them and itself.
_SPECIAL = re.compile(r"[<\[\\]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PLAIN = r"([^<\[\\]*(?:\\.[^<\[\\]*)*)"
_TURN = re.compile(re.escape(OPEN + ROLE) + _PLAIN + re.escape(TEXT) + _PLAIN + re.escape(CLOSE), re.DOTALL)

#: Turns of a segment.
SEGMENT = 256

TREE_SCHEMA = (
    "shard int, seq long, conv_id long, segment long, segments long, prefix long, start long, text string, position_start long, n_turns long, "
    "path array<struct<start:long,end:long>>, loss array<struct<start:long,end:long>>"
)


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The turn under the template, and where its text begins and ends. Null is empty."""
    head = f"{OPEN}{ROLE}{escape(role or '')}{TEXT}"
    body = escape(text or "")
    return f"{head}{body}{CLOSE}", len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin and end of the escaped text) of every turn."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2]), *m.span(2)))
        at = m.end()
    if at != len(formatted):
        raise ValueError("the text does not follow the template")
    return turns


def _merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for start, end in spans:
        if out and out[-1]["end"] == start:
            out[-1]["end"] = end
        elif start < end:
            out.append({"start": start, "end": end})
    return out


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shard, seq, at = TaskContext.get().partitionId(), 0, 0
    prefix = None
    last: list[tuple[str, str]] = []  # turns of the segment before
    placed: list[tuple[int, int]] = []  # where each of them was emitted
    for batch in batches:
        rows = []
        for conv_id, segment, segments, own, before, turns in zip(*(batch[c] for c in ("conv_id", "segment", "segments", "prefix", "before", "turns"))):
            turns = [(t["role"] or "", t["text"] or "") for t in turns]
            same = 0
            while own == prefix and same < min(len(turns), len(last)) and turns[same] == last[same]:
                same += 1
            placed = placed[:same]
            begin, parts, loss = at, [], []
            for role, text in turns[same:]:
                formatted, a, b = format_turn(role, text)
                if role == "assistant":
                    loss.append({"start": at + a, "end": at + b})
                placed.append((at, at + len(formatted)))
                parts.append(formatted)
                at += len(formatted)
            position = int(before) + sum(b - a for a, b in placed[:same])
            rows.append((shard, seq, None if conv_id is None else int(conv_id), segment, segments, own, begin, "".join(parts), position, len(turns), _merged(placed), loss))
            seq += 1
            prefix, last = own, turns
        yield pd.DataFrame(rows, columns=["shard", "seq", "conv_id", "segment", "segments", "prefix", "start", "text", "position_start", "n_turns", "path", "loss"]).astype({"conv_id": "Int64"})


def _segments(conversations: DataFrame) -> DataFrame:
    """(nameless, conv, segment, segments, prefix, before, turns): turns in order, at most SEGMENT a row, with the number of segments of the
    conversation, a hash of the turns before and the characters these take when formatted."""
    keys = ["nameless", "conv"]
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    special = lambda c: F.length(c) + F.size(F.regexp_extract_all(c, F.lit(r"[<\[\\]"), F.lit(0)))
    turns = conversations.select(
        F.col("conv_id").isNull().alias("nameless"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), "turn", "role", "text",
        (F.lit(len(OPEN + ROLE + TEXT + CLOSE)) + special(role) + special(text)).alias("chars"), F.xxhash64(role, text).alias("h"),
    )
    # numbers of a conversation's turns come from counts by stretch of turn numbers, nulls first
    stretch = F.coalesce(whole(F.col("turn"), SEGMENT), F.lit(-(1 << 62)))
    numbered = ordinal(turns, keys, stretch, ["turn", "role", "text"], "place").withColumn("segment", whole(F.col("place"), SEGMENT))
    cut = numbered.groupBy(*keys, "segment").agg(
        F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"), F.sum("chars").alias("chars"), F.bit_xor(F.xxhash64("place", "h")).alias("h")
    )
    cut = stored(cut, "segments")
    of = Window.partitionBy(*keys)
    earlier = of.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    chained = cut.select(
        *keys, "segment", F.count("*").over(of).alias("segments"), F.coalesce(F.bit_xor("h").over(earlier), F.lit(0)).alias("prefix"),
        F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("before"),
    )
    return cut.drop("chars", "h").join(chained, [*keys, "segment"])


def write_trees(conversations: DataFrame) -> DataFrame:
    """Formats (conv_id, turn, role, text) and writes the shards; one row per segment of a conversation in depth-first order: the text it
    adds, where that starts in its shard, the position id of its first character, the intervals of its path within its tree, and the
    intervals of assistant text in what it adds. A segment after the first also attends to the segments before it.

    A conversation's turns go by turn, ties by role and text, nulls first; repeated rows are turns of their own. Null roles and
    texts are empty; rows without conv_id form one conversation. Conversations that are equal add nothing after the first; their
    sort key ends in conv_id, so that any number of them spreads over the shards. An empty table gives no row.
    """
    key = F.transform("turns", lambda t: F.xxhash64(F.coalesce(t["role"], F.lit("")), F.coalesce(t["text"], F.lit(""))))
    order = ["prefix", "key", "conv_id", "segment"]
    named = _segments(conversations).withColumn("conv_id", F.when(~F.col("nameless"), F.col("conv"))).withColumn("key", key)
    ordered = named.repartitionByRange(*order).sortWithinPartitions(*order)
    # ids travel as text, so that a null does not turn them into floats
    return stored(ordered.select(F.col("conv_id").cast("string").alias("conv_id"), "segment", "segments", "prefix", "before", "turns").mapInPandas(_emit, TREE_SCHEMA), "trees")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_PART = "conv_id long, segment long, segments long, n_turns long, formatted_chars long, said string, loss string"


def _rebuilt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every segment's turns and assistant text, from the emitted texts on its path."""
    shard = None
    pieces: list[tuple[int, str]] = []  # emitted texts on the path of the last segment, by place
    masks: list[tuple[int, int]] = []
    for batch in batches:
        rows = []
        for row in batch.to_dict("records"):
            if row["shard"] != shard:
                shard, pieces, masks = row["shard"], [], []
            if row["text"]:
                pieces.append((row["start"], row["text"]))
            masks += [(x["start"], x["end"]) for x in row["loss"]]
            path = [(x["start"], x["end"]) for x in row["path"]]
            cut, kept = [], []
            for start, end in path:
                for begin, text in pieces:
                    a, b = max(start, begin), min(end, begin + len(text))
                    if a < b:
                        cut.append((a, text[a - begin : b - begin]))
                kept += [m for m in masks if start <= m[0] and m[1] <= end]
            pieces, masks = cut, kept
            formatted = "".join(text for _, text in pieces)
            if len(formatted) != sum(end - start for start, end in path):
                raise ValueError("the path of a conversation leads to text that was not emitted before it")
            learned = []
            for a, b in masks:
                for begin, text in pieces:
                    if begin <= a and b <= begin + len(text):
                        learned.append(unescape(text[a - begin : b - begin]))
                        break
            turns = parse_turns(formatted)
            said = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns)
            rows.append((None if row["conv_id"] is None else int(row["conv_id"]), row["segment"], row["segments"], len(turns), len(formatted), said, "".join(learned)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PART.split(", ")]).astype({"conv_id": "Int64"})


class _Digest:
    """Digest of one conversation, taken segment by segment."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, row: dict) -> None:
        self.turns, self.chars, self.loss_chars = self.turns + row["n_turns"], self.chars + row["formatted_chars"], self.loss_chars + len(row["loss"])
        self.said.update(row["said"].encode())
        self.loss.update(row["loss"].encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of conversations whose segments come in order."""
    frame = lambda rows: pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")]).astype({"conv_id": "Int64"})
    current: _Digest | None = None
    for batch in batches:
        rows = []
        for row in batch.to_dict("records"):
            if row["segment"] == 0:
                if current:
                    rows.append(current.row())
                current = _Digest(None if row["conv_id"] is None else int(row["conv_id"]))
            current.add(row)
        yield frame(rows)
    if current:
        yield frame([current.row()])


def read_trees(trees: DataFrame) -> DataFrame:
    """Digest of every conversation, rebuilt from the written shards along its path; holds one segment's path at a time.

    Conversations of one segment are digested where they are rebuilt; the segments of longer ones are sorted first, and each is added to its
    conversation's digest and forgotten.
    """
    text = F.col("conv_id").cast("string").alias("conv_id")
    ordered = trees.withColumn("conv_id", text).repartition("shard").sortWithinPartitions("shard", "seq")
    short = ordered.mapInPandas(_rebuilt, _PART).where("segments = 1").select(text, "segment", "n_turns", "formatted_chars", "said", "loss").mapInPandas(_digests, DIGEST)
    if trees.where("segments > 1").isEmpty():
        return short
    # a shard's segments before the long ones hold what is on their path
    parts = ordered.mapInPandas(_rebuilt, _PART).where("segments > 1").select(text, "segment", "n_turns", "formatted_chars", "said", "loss")
    return short.unionAll(parts.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInPandas(_digests, DIGEST))
