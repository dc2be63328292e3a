"""Pileup calls, diplotype, repeat and HLA rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import MIN_DEPTH


def snv_dosage(alt_count: Column, depth: Column) -> Column:
    share = alt_count / depth
    return F.when(depth >= MIN_DEPTH, F.when(share < 0.15, 0).when(share > 0.85, 2).otherwise(1))


def indel_dosage(alt_count: Column, informative: Column) -> Column:
    share = alt_count / informative
    return F.when(informative >= MIN_DEPTH, F.when(share >= 0.85, 2).when(share >= 0.20, 1).otherwise(0))


def dosage_text(dosage: Column) -> Column:
    return F.when(dosage == 0, "0/0").when(dosage == 1, "0/1").when(dosage == 2, "1/1").otherwise("./.")


def strand_biased(dosage: Column, depth: Column, forward: Column, reverse: Column) -> Column:
    total = forward + reverse
    share = forward / F.when(total > 0, total)
    return F.coalesce(
        (dosage > 0) & (depth >= 10) & (total >= 3) & ((share > 0.90) | (share < 0.10)), F.lit(False)
    )


def activity_class(score: Column) -> Column:
    return (
        F.when(score == 0, "Poor metabolizer")
        .when(score <= 0.75, "Intermediate metabolizer")
        .when(score <= 2.25, "Normal metabolizer")
        .otherwise("Ultrarapid metabolizer")
    )


def star_allele(text: Column) -> Column:
    """``*1x2`` -> ``*1``."""
    return F.regexp_replace(F.trim(text), "x[0-9]+$", "")


def star_copies(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, "x([0-9]+)$", 1).try_cast("int"), F.lit(1))


def repeat_class(count: Column, cuts: list[Column], names: list[Column]) -> Column:
    return (
        F.when(count <= cuts[0], names[0])
        .when(count <= cuts[1], names[1])
        .when(count <= cuts[2], names[2])
        .otherwise(names[3])
    )


def short_hla(allele: Column) -> Column:
    """``HLA-A*33:03:01`` -> ``33:03:01``."""
    star = F.instr(allele, "*")
    return F.when(star > 0, allele.substr(star + 1, F.length(allele))).otherwise(allele)


def primary_hla_call(calls: Column) -> Column:
    return F.when(~F.coalesce(calls, F.lit("")).isin("", "."), F.substring_index(calls, ",", 1))
