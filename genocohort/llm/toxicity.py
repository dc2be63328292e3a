"""Toxicity by a subsequence string kernel with Nystroem landmarks.

The kernel compares two words by their common subsequences of ORDER letters, each counted with DECAY to the power of the span
it covers, spans up to ORDER + GAPS: a letter left out, put in or changed leaves most subsequences alone. Words are taken
without marks between their letters (`i-d-i-o-t`), and letters that stand alone are one word (`i d i o t`).

A support vector machine over the Nystroem map of the kernel (landmark words, inverse root of their Gram matrix) is linear in
the kernel's own features, so its weights fold into one table over subsequences: scoring a word is a sum of table entries,
whatever the number of landmarks. A text scores by its two worst words (labels are of whole texts, as in multiple-instance
learning: in a toxic text at least one word is toxic, in others none is).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .words import pieces, prefix_codes, span_codes

ORDER, GAPS, DECAY = 4, 2, 0.8
#: Labelled documents learned from, of each class (about; chosen by a hash of doc_id).
SAMPLE_PER_CLASS = 3000
#: Landmark words: the most telling ones of toxic texts, and the most frequent of others.
LANDMARKS_TOXIC, LANDMARKS_OTHER = 160, 32
#: Words of other texts learned from, at most, beside all that stand in toxic texts as witnesses.
OTHER_WORDS = 12_000
#: Log likelihood ratio from which a word tells toxic texts from others by itself.
LEAST_RATIO = 16.0
ROUNDS = 3
#: Spellings with an inserted letter that each telling word is shown in as well, together half as heavy as the word.
DISGUISES = 4
#: Weight of the worst word of a text that is not toxic, against 1 for any of its words.
HARD_WEIGHT = 4.0

_SYMBOLS = np.zeros(256, np.uint8)
_SYMBOLS[97:123] = np.arange(1, 27)
# letters beyond ASCII: their UTF-8 bytes share five symbols
_SYMBOLS[128:] = 27 + np.arange(128) % 5
#: Offsets of the letters of a subsequence from its first, by last offset.
_PATTERNS = [(0, *c) for c in combinations(range(1, ORDER + GAPS), ORDER - 1)]


def _folded(column: pa.Array) -> pa.Array:
    text = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    blank, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    return pc.binary_join_element_wise(blank, text, blank, none).cast(pa.large_binary())


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all words (each after a 0, a last 0 at the end), the places of those zeros, the words' bytes' places, and the
    text of each word. Single letters in a row make one word."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    letter = _SYMBOLS[data] > 0
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    kept = np.flatnonzero(letter)
    if not len(kept):
        return np.zeros(1, np.uint8), np.zeros(0, np.int64), kept, np.zeros(0, np.int64)
    blanks = np.cumsum(blank)
    owner = text_of[kept]
    new = np.concatenate([[True], (np.diff(blanks[kept]) > 0) | (np.diff(owner) > 0)])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(kept)))
    if len(starts) > 1:
        lone = (sizes[1:] == 1) & (sizes[:-1] == 1) & (owner[starts[1:]] == owner[starts[:-1]])
        starts = np.concatenate([starts[:1], starts[1:][~lone]])
        sizes = np.diff(np.append(starts, len(kept)))
    zeros = starts + np.arange(len(starts))
    symbols = np.zeros(len(kept) + len(starts) + 1, np.uint8)
    symbols[np.arange(len(kept)) + np.repeat(np.arange(1, len(starts) + 1), sizes)] = _SYMBOLS[data[kept]]
    return symbols, zeros, kept, owner[starts]


def _length_norms(most: int) -> np.ndarray:
    """Norm of the kernel's features of a word of each length whose subsequences all differ."""
    out = np.zeros(most + 1)
    for n in range(most + 1):
        size = n + 2  # with the marks of its ends
        out[n] = np.sqrt(sum(max(0, size - p[-1]) * DECAY ** (2 * (p[-1] + 1)) for p in _PATTERNS))
    return np.maximum(out, DECAY**ORDER)


_NORMS = _length_norms(256)


def features(word: str) -> dict[int, float]:
    """Subsequence codes of one word with their normalised weights."""
    data = np.frombuffer(word.encode(), np.uint8)
    s = [0, *(int(x) for x in _SYMBOLS[data] if x), 0]
    out: dict[int, float] = {}
    for p in _PATTERNS:
        for i in range(len(s) - p[-1]):
            code = 0
            for o in p:
                code = code << 5 | s[i + o]
            out[code] = out.get(code, 0.0) + DECAY ** (p[-1] + 1)
    norm = _NORMS[min(len(s) - 2, len(_NORMS) - 1)]
    return {k: v / norm for k, v in out.items()}


def table_sums(symbols: np.ndarray, zeros: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each word the sum of the table's entries over its subsequences, normalised by its length."""
    if not len(zeros):
        return np.zeros(0)
    n = len(symbols)
    ends = np.append(zeros[1:], n - 1)  # the mark that ends each word
    stop = np.repeat(ends, ends - zeros)  # a subsequence lies between the marks of one word
    begin = np.arange(n - 1)
    sums = np.zeros(n - 1)
    wide = symbols.astype(np.int32)
    for p in _PATTERNS:
        m = n - p[-1]
        if m <= 0:
            continue
        code = wide[:m] << 15
        code |= wide[p[1] : p[1] + m] << 10
        code |= wide[p[2] : p[2] + m] << 5
        code |= wide[p[3] : p[3] + m]
        value = weights[code[: n - 1]] * DECAY ** (p[-1] + 1)
        k = len(value)
        sums[:k] += np.where(begin[:k] + p[-1] <= stop[:k], value, 0)
    return np.add.reduceat(sums, zeros) / _NORMS[np.minimum(ends - zeros - 1, len(_NORMS) - 1)]


@dataclass
class Machine:
    """Weights over subsequences, the machine's offset, and the logistic curve from a text's two worst words to its score."""

    weights: np.ndarray
    offset: float
    slopes: tuple[float, ...] = (1.0, 0.0, 0.0)
    shift: float = 0.0

    def decisions(self, column: pa.Array) -> np.ndarray:
        """The two highest decision values of different words of each text; -1 where there are no such words, or lower ones."""
        out = np.full((len(column), 2), -1.0)
        for first, data, offsets in pieces(_folded(column)):
            symbols, zeros, kept, owner = letter_words(data, offsets)
            if not len(zeros):
                continue
            # each distinct word once
            letters = data[kept]
            codes = prefix_codes(letters)
            starts = zeros - np.arange(len(zeros))
            ends = np.append(starts[1:], len(letters))
            _, one, which = np.unique(span_codes(codes, starts, ends), return_index=True, return_inverse=True)
            sizes = (ends - starts)[one] + 1
            upto = np.cumsum(sizes)
            few = symbols[np.repeat(zeros[one] - (upto - sizes), sizes) + np.arange(upto[-1])]
            values = table_sums(np.append(few, np.uint8(0)), upto - sizes, self.weights) + self.offset
            some = np.flatnonzero(values[which] > -1)
            pairs = np.unique(owner[some] * len(one) + which[some])
            text, value = pairs // len(one), values[pairs % len(one)]
            order = np.lexsort((-value, text))
            text, value = text[order], value[order]
            begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.zeros(0, np.int64)
            out[first + text[begin], 0] = value[begin]
            more = begin[np.diff(np.append(begin, len(text))) > 1] + 1
            out[first + text[more], 1] = value[more]
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_traits(self.decisions(column)) @ np.array(self.slopes) + self.shift, -30, 30)))


def _traits(decisions: np.ndarray) -> np.ndarray:
    """What the logistic curve goes by: the two decisions, and how far the worst word lies beyond one and a half margins."""
    return np.concatenate([decisions, np.maximum(decisions[:, :1] - 1.5, 0) ** 2], 1)


NOTHING = Machine(np.zeros(1 << 20, np.float32), -1.0, (0.0, 0.0, 0.0), -30.0)


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        for first, data, offsets in pieces(_folded(batch.column(2))):
            symbols, zeros, kept, owner = letter_words(data, offsets)
            letters = data[kept].tobytes()
            starts = zeros - np.arange(len(zeros))
            ends = np.append(starts[1:], len(letters))
            held = [letters[a:b] for a, b in zip(starts, ends)]
            rows, texts, around, seen = [], [], [], set()
            for i, (text, word) in enumerate(zip(owner.tolist(), held)):
                if (text, word) not in seen:
                    seen.add((text, word))
                    near = (held[i - 1] if i and owner[i - 1] == text else b"", held[i + 1] if i + 1 < len(held) and owner[i + 1] == text else b"")
                    rows.append(text + first)
                    texts.append(word.decode("utf8", "replace"))
                    around.append(zlib.crc32(b" ".join(near)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(toxic[rows], pa.int32()), pa.array(texts, pa.string()), pa.array(around, pa.int64())], names=["doc_id", "toxic", "word", "around"])


def _kernel_features(landmarks: list[dict[int, float]], root: np.ndarray):
    index: dict[int, list[tuple[int, float]]] = {}
    for j, z in enumerate(landmarks):
        for code, v in z.items():
            index.setdefault(code, []).append((j, v))

    def row(word: str) -> np.ndarray:
        k = np.zeros(len(landmarks))
        for code, v in features(word).items():
            for j, z in index.get(code, ()):
                k[j] += v * z
        return k @ root

    return row


def sampled(labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """About per_class rows of (doc_id, toxic) of each class, by a hash of doc_id: a bounded table, marked for broadcast."""
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / max(counts.get(1, 0), 1))).otherwise(min(1.0, per_class / max(counts.get(0, 0), 1)))
    return F.broadcast(labels.where(draw < share).select("doc_id", F.col("toxic").cast("int").alias("toxic")))


def learn(sample: DataFrame) -> Machine:
    """A machine from a bounded sample of (doc_id, text, toxic), toxic 0 or 1, see sampled(). Where a class is missing, or no word
    tells them apart, nothing is toxic: every score is 0."""
    sample = sample.where("text IS NOT NULL").select("doc_id", "toxic", "text")
    # a quarter of the sample is kept from the machine, for the curve alone
    apart = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(4)) == 0
    held, sample = sample.where(apart), sample.where(~apart)
    counts = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return NOTHING
    schema = f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, toxic int, word string, around long"
    words = sample.mapInArrow(_words_of, schema).persist()
    try:
        # by the words around it, so that copies of one text count once
        spread = words.select("word", "toxic", "around").distinct().groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
        # log likelihood ratio of the word's share in toxic texts against no difference
        of = lambda n, k: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / ((F.col("t") + F.col("o")) * (counts[k] / (counts[0] + counts[1]))))).otherwise(0.0)
        rated = spread.withColumn("ratio", 2 * (of("t", 1) + of("o", 0)))
        more = F.col("t") * counts[0] > F.col("o") * counts[1]
        telling = rated.where(more & (F.col("ratio") >= LEAST_RATIO)).orderBy(F.desc("ratio"), "word").limit(LANDMARKS_TOXIC).toPandas()
        usual = rated.where(F.col("o") > 0).orderBy(F.desc("o"), "word").limit(LANDMARKS_OTHER).toPandas()
        names = list(dict.fromkeys([*telling["word"], *usual["word"]]))
        landmarks = [features(w) for w in names]
        gram = np.array([[sum(v * b.get(c, 0.0) for c, v in a.items()) for b in landmarks] for a in landmarks])
        values, vectors = np.linalg.eigh(gram)
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        spark = sample.sparkSession
        mapped = spark.sparkContext.broadcast((landmarks, root))

        @F.pandas_udf("array<float>")
        def nystroem(some: pd.Series) -> pd.Series:
            row = _kernel_features(*mapped.value)
            return some.map(lambda word: row(word).astype(np.float32))

        others = rated.where(F.col("o") > 0).orderBy(F.xxhash64("word"), "word").limit(OTHER_WORDS).select("word", F.lit(0.0).alias("label"), F.lit(1.0).alias("weight"))
        common = rated.where(F.col("o") > 0).orderBy(F.desc("o"), "word").limit(OTHER_WORDS // 10).select("word", F.lit(0.0).alias("label"), F.lit(1.0).alias("weight"))
        if not len(telling):
            return NOTHING
        witnesses = spark.createDataFrame([(w,) for w in telling["word"]], "word string").withColumn("label", F.lit(1.0))
        machine = Machine(np.zeros(1 << 20, np.float32), -1.0)
        hard: set[str] = set()
        for _ in range(ROUNDS):
            positive = witnesses.join(spread, "word").select("word", "label", F.sqrt(F.col("t").cast("double")).alias("weight"))
            positive = positive.unionByName(positive.select(F.explode(disguised("word")).alias("word"), "label", (F.col("weight") / DISGUISES / 2).alias("weight")))
            negative = others.unionByName(common).distinct()
            if hard:
                negative = negative.unionByName(spark.createDataFrame([(w, 0.0, HARD_WEIGHT) for w in sorted(hard)], "word string, label double, weight double"))
            chosen = negative.unionByName(positive).select(nystroem("word").alias("x"), "label", "weight").toArrow().combine_chunks()
            rows = pc.list_flatten(chosen.column("x")).to_numpy().reshape(chosen.num_rows, -1)
            plane, offset = _support_vectors(rows, chosen.column("label").to_numpy(), chosen.column("weight").to_numpy())
            del chosen, rows
            own = root @ plane
            table = np.zeros(1 << 20, np.float32)
            for a, z in zip(own, landmarks):
                for code, v in z.items():
                    table[code] += a * v
            machine = Machine(table, offset)
            # the worst word of each toxic text is its witness from now on
            judge = spark.sparkContext.broadcast(machine)

            @F.pandas_udf("double")
            def decided(some: pd.Series) -> pd.Series:
                return pd.Series(judge.value.decisions(pa.array(some, pa.string()))[:, 0])

            rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("d"), "word"))
            worst = words.withColumn("d", decided("word")).withColumn("r", rank).where("r = 1 AND d > -0.5").groupBy("toxic", "word").agg(F.max("d").alias("d")).collect()  # one a sampled text at most
            found = {r["word"] for r in worst if r["toxic"] == 1 and r["d"] > 0}
            # the worst words of other texts are what the next machine has to tell apart
            hard |= {r["word"] for r in worst if r["toxic"] == 0}
            found -= hard
            witnesses = spark.createDataFrame([(w,) for w in sorted(found | set(telling["word"]))], "word string").withColumn("label", F.lit(1.0))
        text = _with_decisions(held, machine).select("toxic", "_decision").toPandas()
        if text["toxic"].nunique() == 2:
            machine.slopes, machine.shift = _curve(_traits(np.array(text["_decision"].tolist())), text["toxic"].to_numpy(float))
        return machine
    finally:
        words.unpersist()


def disguised(word: str) -> F.Column:
    """DISGUISES spellings of a word with one more letter inside, places and letters drawn by hash: virtual examples."""
    spots = F.greatest(F.length(word) - 1, F.lit(1))
    draw = lambda k: F.xxhash64(F.col(word), k)
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")

    def one(k: F.Column) -> F.Column:
        at = F.pmod(draw(k), spots).cast("int") + 1
        letter = F.substring(letters, F.pmod(F.shiftright(draw(k), 20), F.lit(26)).cast("int") + 1, F.lit(1))
        return F.concat(F.substring(F.col(word), F.lit(1), at), letter, F.substring(F.col(word), at + 1, F.length(word)))

    return F.transform(F.sequence(F.lit(1), F.lit(DISGUISES)), one)


def _support_vectors(rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Plane and offset of a linear support vector machine with squared hinge loss, by Newton steps; both classes weigh the same."""
    sign = np.where(labels > 0, 1.0, -1.0)
    weights = weights / np.where(labels > 0, weights[labels > 0].sum(), weights[labels <= 0].sum())
    x = np.concatenate([rows, np.ones((len(rows), 1), rows.dtype)], 1).astype(float)
    held = penalty * np.eye(x.shape[1])
    held[-1, -1] = 1e-9
    loss = lambda w: (weights * np.maximum(1 - sign * (x @ w), 0) ** 2).sum() + w @ held @ w
    w = np.zeros(x.shape[1])
    for _ in range(60):
        slack = np.maximum(1 - sign * (x @ w), 0)
        some = slack > 0
        gradient = -2 * x[some].T @ (weights[some] * sign[some] * slack[some]) + 2 * held @ w
        step = np.linalg.solve(2 * (x[some] * weights[some, None]).T @ x[some] + 2 * held, gradient)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now - 1e-4 * size * (gradient @ step) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Logistic curve by Newton steps, every text weighing the same, slightly held."""
    w = np.full(len(y), 1 / max(len(y), 1))
    rows = np.concatenate([x, np.ones((len(x), 1))], 1)
    a = np.zeros(rows.shape[1])
    a[0] = 2.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ a, -30, 30)))
        gradient = rows.T @ (w * (p - y)) + 1e-4 * a
        hessian = (rows * (w * p * (1 - p))[:, None]).T @ rows + 1e-4 * np.eye(len(a))
        step = np.linalg.solve(hessian, gradient)
        a = a - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return tuple(max(float(v), 0.0) for v in a[:-1]), float(a[-1])


def _with_decisions(docs: DataFrame, machine: Machine, scores: bool = False) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # one table of 4 MB
    name = "_toxicity" if scores else "_decision"
    out = StructType([*docs.schema.fields, StructField(name, DoubleType() if scores else ArrayType(DoubleType()))])
    at = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.scores(batch.column(at)) if scores else shared.value.decisions(batch.column(at))
            made = pa.array(got, pa.float64()) if scores else pa.array(got.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return docs.mapInArrow(judge, out)


def toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs with _toxicity in 0 to 1, from the text alone; null, empty and wordless texts score as a text without any toxic
    word. Every word of a text counts, however long it is. Repeated rows and columns of other names pass through."""
    return _with_decisions(docs.drop("_toxicity"), machine, scores=True)
