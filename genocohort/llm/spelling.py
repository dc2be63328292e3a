"""Spelling variants by permuterm rotations.

A word with an end mark behind it has as many rotations as letters, plus one. Turned so that the letter in question stands last, a
word is its other letters, from there on round to it, and the letter: words that differ in this letter alone share all but the
last letter of such a rotation, and a word that lacks the letter is exactly the rest. So every rotation is filed whole and
without its last letter, all are sorted (range-partitioned) by that key, and words with the same key are neighbours. A key fixes all
other letters and their places, so it holds no more words than there are letters, and one, whole, without.

A letter put into a run of the same letter gives one word at several places; only the first place counts, so each pair is met once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: The letters of a word, and those that are lowered.
LETTERS = r"A-Za-zÀ-ÿ"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shortest word, fewest occurrences, and how many times as frequent a word's form is.
LENGTH, OCCURRENCES, RATIO = 6, 5, 5
END = "$"


def runs(text: Column, length: int = LENGTH) -> Column:
    """The maximal runs of letters of a text that have at least `length` of them, A-Z lowered; none for null."""
    found = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))
    return F.transform(found, lambda run: F.when(run.rlike("[A-Z]"), F.translate(run, CAPITALS, SMALL)).otherwise(run))


def without(word: Column, place: Column) -> Column:
    """A word without its code point at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def counted(words: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the words, one row an occurrence, that are long and frequent enough; null is no word."""
    return words.where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= occurrences)


def rotations(words: DataFrame) -> DataFrame:
    """(key, word, n, whole, again): all rotations of the words, whole and without their last letter, in the order of their keys.

    again: the letter left out is the one before it, so that the key's whole word holds it at an earlier place already.
    """
    placed = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    tail = F.concat(F.substring("word", F.col("i") + 1, F.length("word")), F.lit(END))
    letter = lambda k: F.substring("word", k, F.lit(1))
    whole = F.struct(F.concat(tail, F.substring("word", F.lit(1), F.col("i"))).alias("key"), F.lit(True).alias("whole"), F.lit(False).alias("again"))
    cut = F.struct(
        F.concat(tail, F.substring("word", F.lit(1), F.col("i") - 1)).alias("key"), F.lit(False).alias("whole"),
        ((F.col("i") > 1) & (letter(F.col("i")) == letter(F.col("i") - 1))).alias("again"),
    )
    filed = placed.select("word", "n", F.explode(F.when(F.col("i") > 0, F.array(whole, cut)).otherwise(F.array(whole))).alias("r"))
    return filed.select("r.key", "word", "n", "r.whole", "r.again").repartitionByRange("key").sortWithinPartitions("key")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n): how many of the other words (word, n) differ from a word by one letter put in, left out or
    replaced, and the most frequent of these (ties: the smallest). Words without any have no row.

    Each key gives a row to each of its words: how many it meets there, and the first of them. A key's first three words are
    enough: a word does not meet itself, nor, where the letter stands twice, the one at the other end.
    """
    group = Window.partitionBy("key")
    order = group.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct("word", "n", "whole", "again")
    shared = rotations(words).select(
        "*", F.count("*").over(group).alias("all"), F.max("whole").over(group).alias("has_whole"), F.max("again").over(group).alias("has_again")
    ).where("all > 1")
    met = shared.select("word", "whole", "again", "all", "has_whole", "has_again", *(F.nth_value(entry, k).over(order).alias(f"e{k}") for k in (1, 2, 3)))
    barred = (F.col("whole") & F.col("has_again")) | (F.col("again") & F.col("has_whole"))
    others = F.filter(
        F.array("e1", "e2", "e3"),
        lambda e: e.isNotNull() & (e["word"] != F.col("word")) & ~(e["whole"] & F.col("again")) & ~(e["again"] & F.col("whole")),
    )
    found = met.select("word", (F.col("all") - 1 - barred.cast("long")).alias("n_near"), F.get(others, F.lit(0)).alias("e"))
    first = F.min(F.when(F.col("e").isNotNull(), F.struct((-F.col("e.n")).alias("less"), F.col("e.word").alias("near"))))
    near = found.where("n_near > 0").groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    return near.select("word", "n_near", "first.near", (-F.col("first.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last, by pointers that double their reach each round. Each form has
    to be more frequent than its word, so there is no circle; rounds are as many as the logarithm of the longest chain."""
    reach = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if reach.join(on, "root", "left_semi").isEmpty():
            return reach
        reach = stored(reach.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")


def grouped(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of (word, n), words distinct.

    form: the most frequent neighbour of a word (ties: the smallest by code points) if it occurs at least `ratio` times as often, else
    null; root: the last form on the way from form to form, the word itself if it has none. No words give no row; a null word
    has no neighbour.
    """
    words = stored(words.select("word", "n"), "words")
    near = neighbours(words.where("word IS NOT NULL"))
    joined = words.join(near, "word", "left")
    chosen = F.col("near_n") >= ratio * F.col("n")
    found = stored(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("near")).alias("form"), F.when(chosen, F.col("near_n")).alias("form_n")), "forms"
    )
    ends = roots(found.where("form IS NOT NULL"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
