"""Language ID by language-bitmask n-gram filters.

A Bloom filter whose slots are bit masks, one bit per language: the masks at an n-gram's slots, and-ed, name all languages that
hold the n-gram, in one look-up whatever their number. A text's per-language popcounts over its n-grams, corrected for the false
positives that each language's fill lets expect, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import lean
from .words import pieces

#: Bytes of an n-gram of lower-cased text in which every run of other characters than letters is one space.
N = 4
#: Bytes of text worked on at once.
AT_ONCE = 1 << 17
#: Labelled documents learned from per language (about; chosen by a hash of doc_id).
SAMPLE_PER_LANGUAGE = 1500
#: A language gets an n-gram's bit if it has it this often and at least 1/RATIO as often as the language that has it most.
LEAST_COUNT, RATIO = 3, 4.0
#: Slots of a filter, at most; each n-gram has three. Above it only the fill, and with it the correction, grows.
MOST_SLOTS = 1 << 21
UNDETERMINED = "und"
#: A text is rejected where its language's share of the known n-grams is below this.
LEAST_SCORE = 0.3

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class Filters:
    """languages in code point order; slots: one mask each; false: each language's rate of false positives."""

    languages: list[str]
    slots: np.ndarray
    false: np.ndarray
    #: share of a language's own n-grams that its filter holds
    cover: np.ndarray


def _folded(column: pa.Array) -> pa.Array:
    text = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    blank, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    return pc.binary_join_element_wise(blank, text, blank, none).cast(pa.large_binary())


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the n-grams of all texts, and for each text the range of its own; codes across texts lie in no range."""
    letter = _LETTER[data]
    held = letter.copy()
    held[1:] |= letter[:-1]  # the first of a run of other characters stays, as a space
    held[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    kept = np.where(letter, data, 32)[held].astype(np.uint32)
    places = np.concatenate([[0], np.cumsum(held)])[offsets]
    codes = np.zeros(max(len(kept) - N + 1, 0), np.uint32)
    for i in range(N):
        codes = (codes << np.uint32(8)) | kept[i : i + len(codes)]
    starts = np.minimum(places[:-1], len(codes))
    return codes, starts, np.maximum(starts, np.minimum(places[1:] - N + 1, len(codes)))


def _places(codes: np.ndarray, n_slots: int) -> list[np.ndarray]:
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mask = np.uint64(n_slots - 1)
    return [(mixed & mask).astype(np.int64), (mixed >> np.uint64(21) & mask).astype(np.int64), (mixed >> np.uint64(42) & mask).astype(np.int64)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for first, data, offsets in pieces(_folded(batch.column(1))):
            codes, starts, ends = _grams(data, offsets)
            own = langs[first : first + len(starts)]
            for lang in sorted(set(own)):
                chosen = np.zeros(len(codes) + 1, np.int64)
                mine = np.flatnonzero(own == lang)
                np.add.at(chosen, starts[mine], 1)
                np.add.at(chosen, ends[mine], -1)
                values, counts = np.unique(codes[np.cumsum(chosen)[:-1] > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "code", "n"])


def learn(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Filters:
    """Filters from (doc_id, text, lang), lang not null: n-gram counts of about per_language whole documents of each language.

    The sample bounds what is gathered: its distinct n-grams, counted by Spark. Where nothing is labelled there are no languages.
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return Filters([], np.zeros((0, 1), np.uint64), np.zeros(0), np.zeros(0))
    languages = sorted(counts)
    share = F.element_at(F.create_map(*[F.lit(x) for lang in languages for x in (lang, per_language / counts[lang])]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    grams = labelled.where(draw < share).select("lang", "text").mapInArrow(lean(_counted), "lang string, code long, n long")
    summed = grams.groupBy("code", "lang").agg(F.sum("n").alias("n"))
    totals = {r["lang"]: r["n"] for r in summed.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    size = F.element_at(F.create_map(*[F.lit(x) for lang in languages for x in (lang, float(max(totals.get(lang, 1), 1)))]), F.col("lang"))
    rated = summed.withColumn("rate", F.col("n") / size)
    held = rated.groupBy("code").agg(F.max("rate").alias("most"), F.collect_list(F.struct("lang", "rate", "n")).alias("of")).select("code", F.explode("of").alias("x"), "most")
    kept = held.where((F.col("x.n") >= LEAST_COUNT) & (F.col("x.rate") * RATIO >= F.col("most"))).select("code", "x.lang", "x.n").toPandas()
    n_slots = 1 << 12
    while n_slots < min(MOST_SLOTS, 16 * len(kept)):
        n_slots *= 2
    planes = (len(languages) + 63) // 64
    slots = np.zeros((planes, n_slots), np.uint64)
    cover = np.zeros(len(languages))
    for number, lang in enumerate(languages):
        mine = kept[kept["lang"] == lang]
        cover[number] = mine["n"].sum() / max(totals.get(lang, 1), 1)
        for place in _places(mine["code"].to_numpy(np.uint32), n_slots):
            slots[number // 64, place] |= np.uint64(1) << np.uint64(number % 64)
    fill = np.array([((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    if len(languages) <= 8:
        slots = slots.astype(np.uint8)  # a small filter stays in cache
    return Filters(languages, slots, fill**3, np.maximum(cover, 1e-9))


def scored(filters: Filters, column: pa.Array) -> tuple[list[str], list[float], list[bool]]:
    """Predicted language, score and whether there is a letter, for each text."""
    names: list[str] = []
    scores: list[float] = []
    lettered: list[bool] = []
    n_slots = filters.slots.shape[1]
    for first, data, offsets in pieces(_folded(column), AT_ONCE):
        codes, starts, ends = _grams(data, offsets)
        places = _places(codes, n_slots)
        total = (ends - starts).astype(float)
        found = np.zeros((len(filters.languages), len(starts)))
        for plane, slots in enumerate(filters.slots):
            masks = slots[places[0]] & slots[places[1]] & slots[places[2]]
            for number in range(plane * 64, min(len(filters.languages), plane * 64 + 64)):
                upto = np.concatenate([[0], np.cumsum((masks >> slots.dtype.type(number % 64)) & slots.dtype.type(1), dtype=np.int64)])
                found[number] = upto[ends] - upto[starts]
        false = filters.false[:, None]
        true = np.maximum((found - total * false) / np.maximum(1 - false, 1e-9), 0) / filters.cover[:, None]
        whole = true.sum(0)
        best = true.argmax(0) if len(true) else np.zeros(len(starts), np.int64)
        ascii_letters = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
        some = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
        for i in np.flatnonzero(~some):
            some[i] = any(c.isalpha() for c in column[first + int(i)].as_py() or "")
        lettered += some.tolist()
        if not filters.languages:
            names += [UNDETERMINED] * len(some)
            scores += [0.0] * len(some)
            continue
        names += [filters.languages[b] if s else UNDETERMINED for b, s in zip(best, some)]
        share = np.where(whole > 0, true.max(0) / np.maximum(whole, 1e-12), 1 / len(filters.languages))
        scores += np.where(some, share, 0.0).tolist()
    return names, scores, lettered


def identified(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs with _lang and _lang_score. The text alone decides; a null text or one without a letter is `und` with score 0.

    Without any language, all are `und`. Where no n-gram is known the first language by code point gets 1 / languages. Ties go to the first by code point. Other
    columns, but for these two names, rows that repeat and tables without rows pass through.
    """
    docs = docs.drop("_lang", "_lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # at most MOST_SLOTS masks
    out = StructType([*docs.schema.fields, StructField("_lang", StringType()), StructField("_lang_score", DoubleType())])
    at = docs.columns.index("text")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, _ = scored(shared.value, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "_lang", "_lang_score"])

    return docs.mapInArrow(lean(label), out)


def accepted(docs: DataFrame, filters: Filters, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents, with their columns, that are in one of the languages: not `und`, and their language's share of the known
    n-grams at least least_score. Where no language is known, a letter is enough."""
    least_score = least_score if filters.languages else 0.0
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, scores, lettered = scored(shared.value, batch.column(at))
            yield batch.filter(pa.array([some and score >= least_score for score, some in zip(scores, lettered)], pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)
