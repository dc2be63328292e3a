"""Weighted allele scores of genotypes: match, sum, average, match rate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..functions import scores as S
from ..session import written
from .degrees import PARTS_FOR_OUTPUT, degree_join, degree_lists, degrees, packed, unpacked
from .picks import first_rows

POSITION = ["chrom", "pos"]


def distinct_weights(score_rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """One weight per (score, position, effect allele): the first in file order."""
    return first_rows(score_rows, ["pgs_id", "chrom", "pos", "effect_allele"], list(order))


def first_call_per_position(calls: DataFrame, order: Sequence[str]) -> DataFrame:
    """One record per (sample, position): the first in file order."""
    return first_rows(calls, ["sample_id", "chrom", "pos"], list(order))


#: Products a task of sums takes, and how many of one score it may have to.
PRODUCTS_OF_A_TASK, PRODUCTS_OF_A_SCORE = 1 << 21, 1 << 24
#: Lists that the requests of one score are dealt into.
LISTS_OF_REQUESTS = 16


def settled(genotypes: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and weights as files, with the columns that matching reads. Planning by degrees reads both sides more than once, and the
    first pass asks for fewer columns, so Spark would work each of them out anew, with every shuffle below it."""
    read = ("alts", "gt") if {"alts", "gt"} <= set(genotypes.columns) else ("alt", "dosage")
    calls = [c for c in ("sample_id", *POSITION, "ref", *read, "_tag") if c in genotypes.columns]
    listed = [c for c in ("pgs_id", *POSITION, "effect_allele", "other_allele", "weight", "total") if c in weights.columns]
    return written(genotypes.select(*calls), "score-calls"), written(weights.select(*listed), "score-weights")


def parts_by_score(genotypes: DataFrame, weights: DataFrame) -> int | None:
    """Parts to deal products by score into before they are summed; None where sums taken at the positions are the smaller thing to send.

    A product of a call and a weight, sent in a list, takes about a third of a sum's row. Sums win where samples and scores share many
    positions: each part of the positions then sends one row a pair. Lists are not dealt either if one score holds too many of them.
    """
    products = degrees(genotypes, weights, POSITION).agg(F.sum(F.col("_n_listed") * F.col("_n_many")).alias("n")).first().n or 0
    scores = weights.groupBy("pgs_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("scores"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
    samples = genotypes.agg(F.approx_count_distinct("sample_id").alias("n")).first().n
    parts = PARTS_FOR_OUTPUT * int(genotypes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if products > 3 * parts * samples * scores.scores or products * (scores.most or 0) > PRODUCTS_OF_A_SCORE * (scores.n or 0):
        return None
    return max(parts, -(-products // PRODUCTS_OF_A_TASK))


def _at_positions(genotypes: DataFrame, weights: DataFrame, planned: bool) -> DataFrame:
    """Genotypes with the weights of their position."""
    if not planned:
        return genotypes.join(weights, POSITION)
    return degree_join(genotypes, weights, POSITION, ["sample_id"], ["pgs_id", "effect_allele"])


def _dealt_by_score(genotypes: DataFrame, weights: DataFrame, form: Form, parts: int, asked: DataFrame | None) -> DataFrame:
    """What matches, dealt by score: a weight travels with the list of its calls and is multiplied out where its score is summed.

    (sample_id, pgs_id, weight, effect_dosage), ``total`` of the weights and ``_tag`` of the calls if they have them.
    """
    flags = [] if asked is None else ["_asked"]
    types = dict(genotypes.dtypes)
    numbers = {c: low for c, low in (("sample_id", 3), ("_tag", 1)) if types.get(c) in ("int", "bigint")}
    per_call = [c for c in (form.call, "_tag", "sample_id") if c in types]

    def fold(found: Column) -> dict[str, Column]:
        # equal calls stand together, which the shuffle's compression makes use of
        entries = F.array_sort(F.transform(found, lambda c: F.struct(*[c[x].alias(x) for x in per_call])))
        parts_of = lambda c: packed(entries[c], numbers[c], c) if c in numbers else {c: entries[c]}
        return {k: x for c in per_call for k, x in parts_of(c).items()}

    calls = genotypes.select(*POSITION, *form.allele, *per_call)
    lists = degree_lists(weights, calls, POSITION, ["pgs_id", "effect_allele"], ["sample_id"], apart=form.allele, fold=fold, settled=True)
    folded = [c for c in lists.columns if c not in (*weights.columns, *form.allele)]
    more = [c for c in ("total",) if c in weights.columns]
    sent = lists.where(form.kept).select("pgs_id", "weight", *more, *[x.alias(c) for c, x in form.carried.items()], *folded)
    if asked is not None:
        # requests of a score are lists without a weight, dealt as its calls are
        empty = [F.lit(None).cast(types[c]).alias(c) for c in per_call if c != "sample_id"]
        wish = F.struct(*empty, F.col("sample_id").cast(types["sample_id"]).alias("sample_id"))
        wishes = asked.groupBy("pgs_id", F.pmod(F.xxhash64("sample_id"), F.lit(LISTS_OF_REQUESTS))).agg(F.collect_list(wish).alias("_wishes"))
        marked = wishes.select("pgs_id", *[x.alias(c) for c, x in fold(F.col("_wishes")).items()])
        sent = sent.withColumn("_asked", F.lit(False)).unionByName(marked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    sent = sent.repartition(parts, "pgs_id")
    each = sent.withColumn("_entries", F.arrays_zip(*folded)).withColumn("_entry", F.explode("_entries"))
    of = lambda c: F.col(f"_entry.{c}")
    value = {c: unpacked(of, numbers[c], c).cast(types[c]) if c in numbers else of(c) for c in per_call}
    whole = each.withColumns(value).withColumn("effect_dosage", form.copies)
    return whole.select("sample_id", "pgs_id", "weight", "effect_dosage", *more, *[c for c in ("_tag",) if c in types], *flags)


@dataclass(frozen=True)
class Form:
    """How calls meet weights: the columns of a call's alleles and of what was called, which pairs are kept, and the copies of the effect
    allele, from ``carried``, columns of the alleles, and the call."""

    allele: list[str]
    call: str
    kept: Column
    carried: dict[str, Column]
    copies: Column


def _biallelic(kept: Column) -> Form:
    straight = F.coalesce(F.col("effect_allele") == F.col("alt"), F.lit(False))
    return Form(["ref", "alt"], "dosage", kept, {"_straight": straight}, F.when(F.col("_straight"), F.col("dosage")).otherwise(2 - F.col("dosage")))


def _matched(genotypes: DataFrame, weights: DataFrame, form: Form, planned: bool, parts: int | None, asked: DataFrame | None = None) -> DataFrame:
    if parts is not None:
        return _dealt_by_score(genotypes, weights, form, parts, asked)
    found = _at_positions(genotypes, weights, planned).where(form.kept)
    added = {c: x for c, x in form.carried.items() if c not in found.columns}
    products = found.withColumns(added).withColumn("effect_dosage", form.copies).drop(*added)
    if asked is None:
        return products
    wishes = asked.select("sample_id", "pgs_id").withColumn("_asked", F.lit(True))
    return products.withColumn("_asked", F.lit(False)).unionByName(wishes, allowMissingColumns=True)


def match_effect_allele(
    genotypes: DataFrame, weights: DataFrame, planned: bool = True, parts: int | None = None, asked: DataFrame | None = None
) -> DataFrame:
    """Genotypes joined to weights on position; the effect allele has to be REF or one of the ALTs.

    With the record's ``alts`` and ``gt`` the copies of the effect allele are counted among all alleles; a table of
    biallelic rows (alt, dosage) needs no more than these. ``planned``: deal positions by their degrees; a plain join does for
    tables that are bucketed by position and known to have no hot one. ``parts``: of ``parts_by_score``, for rows to sum by sample and
    score; they come dealt by score then, with no more columns than sums read. ``asked``: pairs to add, as rows without a call, for ``sum_asked``.
    """
    effect, ref, alts = F.col("effect_allele"), F.col("ref"), F.col("alts")
    if {"alts", "gt"} <= set(genotypes.columns):
        copies = G.allele_dosage(ref, alts, F.col("gt"), effect)
        form = Form(["ref", "alts"], "gt", (effect == ref) | F.array_contains(alts, effect), {"ref": ref, "alts": alts, "effect_allele": effect}, copies)
    else:
        form = _biallelic((effect == ref) | (effect == F.col("alt")))
    return _matched(genotypes, weights, form, planned, parts, asked)


def match_allele_pair(genotypes: DataFrame, weights: DataFrame, planned: bool = True, parts: int | None = None) -> DataFrame:
    """Panel form: both alleles have to agree, in either orientation. ``parts`` as in ``match_effect_allele``."""
    straight = (F.col("effect_allele") == F.col("alt")) & (F.col("other_allele") == F.col("ref"))
    turned = (F.col("effect_allele") == F.col("ref")) & (F.col("other_allele") == F.col("alt"))
    return _matched(genotypes, weights, _biallelic(straight | turned), planned, parts)


def pair_columns(calls: DataFrame) -> list[str]:
    """What to sum products by: the pair, and the tag of its sample if the calls have one."""
    return ["sample_id", "pgs_id", *[c for c in ("_tag",) if c in calls.columns]]


def sum_scores(matched: DataFrame, by: Sequence[str] = ("sample_id", "pgs_id"), more: Sequence[Column] = ()) -> DataFrame:
    """SUM, ALLELE_CT and AVG; a missing call adds nothing and is not counted. ``more``: further aggregates."""
    counted = F.count("effect_dosage")
    return matched.groupBy(*by).agg(
        F.coalesce(F.sum(F.col("effect_dosage") * F.col("weight")), F.lit(0.0)).alias("score_sum"),
        (2 * counted).alias("allele_ct"),
        counted.alias("matched"),
        *more,
    ).withColumn("raw_score", F.when(F.col("allele_ct") > 0, F.col("score_sum") / F.col("allele_ct")))


def sum_asked(matched: DataFrame) -> DataFrame:
    """Sums of the pairs that were asked for and have a product, of what ``match_effect_allele`` gives for ``asked``: a request is a row
    of the sum, so that products are not joined with the requests."""
    both = [F.max("_asked").alias("_asked"), F.min("_asked").alias("_alone")]
    return sum_scores(matched, more=both).where(F.col("_asked") & ~F.col("_alone")).drop("_asked", "_alone")


def score_totals(weights: DataFrame) -> DataFrame:
    """Distinct (position, effect allele) entries per score; ``weights`` is already distinct."""
    return weights.groupBy("pgs_id").agg(F.count(F.lit(1)).alias("total"))


def with_totals(weights: DataFrame) -> DataFrame:
    """The weights, each with the total of its score: a pair then brings the total along, and the sums of all samples are not joined with it."""
    return weights.join(score_totals(weights).hint("shuffle_hash"), "pgs_id", "left")


def with_match_rate(scored: DataFrame, weights: DataFrame) -> DataFrame:
    return match_rates(scored.join(score_totals(weights), "pgs_id", "left"))


def match_rates(scored: DataFrame) -> DataFrame:
    """Rate, band and report mark of sums with the ``total`` of their score."""
    rate = F.when(F.col("total") > 0, F.col("matched") * 100.0 / F.col("total")).otherwise(0.0)
    return (
        scored.withColumn("total", F.coalesce("total", F.lit(0)))
        .withColumn("match_rate", rate)
        .withColumn("status", S.status_band(F.col("matched"), F.col("match_rate")))
        .withColumn("no_report", F.col("status") == "failed")
        .withColumn("match_rate_value", F.round("match_rate", 1))
    )


def score_samples(genotypes: DataFrame, weights: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Every score of every sample in one job; with ``requests`` (sample_id, pgs_id) those asked for, each with a row.

    Without requests a pair appears when at least one of its positions was seen. A requested pair of which none was seen, or whose
    score has no weights, is a failed result.
    """
    if requests is None:
        calls, listed = settled(genotypes, weights)
        sides = calls, written(with_totals(listed), "score-weights")
        matched = match_effect_allele(*sides, parts=parts_by_score(*sides))
        return match_rates(sum_scores(matched, pair_columns(calls), [F.max("total").alias("total")]))
    asked = written(requests.select("sample_id", "pgs_id").distinct(), "asked-scores")
    calls, wanted = settled(
        genotypes.join(asked.select("sample_id").distinct(), "sample_id", "left_semi"), weights.join(asked.select("pgs_id").distinct(), "pgs_id", "left_semi")
    )
    summed = asked.join(sum_scores(match_effect_allele(calls, wanted, parts=parts_by_score(calls, wanted))), ["sample_id", "pgs_id"], "left")
    nothing = {"score_sum": 0.0, "allele_ct": 0, "matched": 0}
    return with_match_rate(summed.fillna(nothing), wanted).withColumn("failure", failure_text())


def failure_text() -> Column:
    """Why a score failed; null where it did not."""
    total = F.format_number(F.col("total"), 0)
    none = F.concat(F.lit("PGS failed (0/"), total, F.lit(" variants matched: chromosome/build mismatch?)"))
    low = F.concat(F.lit("PGS failed (match rate "), F.format_number("match_rate", 0), F.lit("%: too low)"))
    return F.when(F.col("matched") == 0, none).when(F.col("status") == "failed", low)
