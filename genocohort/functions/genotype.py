"""Chromosome names, variant keys, alleles and genotypes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SYMBOLIC_ALTS


def whole(col: Column, size: int) -> Column:
    """Integer division: exact for every 64-bit value, and one machine operation."""
    return F.call_function("div", col, F.lit(size))


def bare_chrom(chrom: Column) -> Column:
    """``chr7`` -> ``7``; ``M``, ``chrM`` and ``MT`` all become ``MT``."""
    bare = F.regexp_replace(F.trim(chrom), "^(?i)chr", "")
    return F.when(F.upper(bare).isin("M", "MT"), F.lit("MT")).otherwise(bare)


def chr_chrom(chrom: Column) -> Column:
    """The ``chr`` spelling of a bare name (``MT`` -> ``chrM``)."""
    return F.concat(F.lit("chr"), F.when(chrom == "MT", F.lit("M")).otherwise(chrom))


def position_key(chrom: Column, pos: Column) -> Column:
    return F.concat_ws(":", F.concat(F.lit("chr"), chrom), pos.cast("string"))


def allele_key(chrom: Column, pos: Column, first: Column, second: Column) -> Column:
    return F.concat_ws(":", chrom, pos.cast("string"), first, second)


def chrom_rank(chrom: Column) -> Column:
    """Natural order: numbers first by value, then letters."""
    return F.coalesce(chrom.try_cast("int"), F.lit(1000))


def clean_text(col: Column) -> Column:
    """Empty and ``NA`` count as missing."""
    trimmed = F.trim(col)
    return F.when(~F.upper(trimmed).isin("", "NA"), trimmed)


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[clean_text(c) for c in cols])


def is_symbolic(alts: Column) -> Column:
    return F.forall(alts, lambda a: a.startswith("<") & a.endswith(">"))


def strip_symbolic(alts: Column) -> Column:
    return F.filter(alts, lambda a: ~a.isin(*SYMBOLIC_ALTS))


def gt_parts(gt: Column) -> Column:
    return F.split(gt, "[/|]")


def gt_indices(gt: Column) -> Column:
    """Allele indices of a genotype; a missing allele is null."""
    return F.transform(gt_parts(gt), lambda a: a.try_cast("int"))


def is_hom_ref_or_missing(gt: Column) -> Column:
    return gt.rlike(r"^[0.]([/|][0.])*$")


def is_ref_block(alts: Column, gt: Column) -> Column:
    return is_symbolic(alts) & is_hom_ref_or_missing(gt)


def block_end(info_end: Column, pos: Column) -> Column:
    return F.coalesce(info_end.try_cast("bigint"), pos)


def alt_dosage(gt: Column) -> Column:
    """Count of non-reference alleles; any missing allele makes the call missing (half-calls too)."""
    alleles = gt_indices(gt)
    # the common spellings are compared as text; only the others are taken apart
    return (
        F.when(gt.isin("0/0", "0|0"), 0)
        .when(gt.isin("0/1", "0|1", "1/0", "1|0"), 1)
        .when(gt.isin("1/1", "1|1"), 2)
        .when(gt.contains("."), None)
        .when(
            F.forall(alleles, lambda a: a.isNotNull()),
            F.aggregate(alleles, F.lit(0), lambda acc, a: acc + F.when(a > 0, 1).otherwise(0)),
        )
    )


def carries_alt(gt: Column) -> Column:
    return F.coalesce(gt.rlike("[1-9]"), F.lit(False))


def genotype_class(gt: Column) -> Column:
    """ref / hom / het / unknown by the spelled genotype, tested in that order."""
    plain = F.replace(F.coalesce(gt, F.lit("")), F.lit("|"), F.lit("/"))
    return (
        F.when(plain.contains("0/0"), "ref")
        .when(plain.contains("1/1"), "hom")
        .when(plain.contains("0/1") | plain.contains("1/0"), "het")
        .otherwise("unknown")
    )


def called_class(gt: Column) -> Column:
    """ref / hom / het by allele indices, as variant statistics count them: 1/2 is het, 2/2 is hom; haploid calls are
    hap_ref or hap_alt, calls with a missing allele unknown."""
    called = gt_indices(gt)
    known = F.size(called) > 0
    known &= F.forall(called, lambda i: i.isNotNull())
    first = F.get(called, F.lit(0))
    same = F.forall(called, lambda i: i == F.get(called, F.lit(0)))
    return (
        F.when(~F.coalesce(known, F.lit(False)), "unknown")
        .when(F.size(called) == 1, F.when(first == 0, "hap_ref").otherwise("hap_alt"))
        .when(~same, "het")
        .when(first == 0, "ref")
        .otherwise("hom")
    )


def allele_dosage(ref: Column, alts: Column, gt: Column, allele: Column) -> Column:
    """Copies of ``allele`` in a multi-ALT genotype; null for haploid, missing or out-of-range calls."""
    alleles = F.concat(F.array(ref), alts)
    called = gt_indices(gt)
    usable = (F.size(called) >= 2) & F.forall(
        called, lambda i: F.coalesce((i >= 0) & (i < F.size(alleles)), F.lit(False))
    )
    copies = F.aggregate(
        called, F.lit(0), lambda acc, i: acc + F.when(F.get(alleles, i) == allele, 1).otherwise(0)
    )
    return F.when(usable, copies)


def variant_class(ref: Column, alt: Column) -> Column:
    return F.when(F.length(ref) == F.length(alt), "snv").otherwise("indel")


def indel_kind(ref: Column, alt: Column) -> Column:
    return (
        F.when(F.length(ref) > F.length(alt), "deletion")
        .when(F.length(ref) < F.length(alt), "insertion")
    )


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(ref, alt).isin("AG", "GA", "CT", "TC")


def complement(bases: Column) -> Column:
    return F.translate(bases, "ACGT", "TGCA")


def single_base(col: Column) -> Column:
    return F.upper(col).isin("A", "C", "G", "T")


def gene_names(geneinfo: Column) -> Column:
    """``A:1|B:2`` -> distinct gene names."""
    return F.array_distinct(
        F.filter(
            F.transform(F.split(geneinfo, r"\|"), lambda g: F.substring_index(g, ":", 1)), lambda g: g != ""
        )
    )


def is_pathogenic(clnsig: Column) -> Column:
    return clnsig.rlike("Pathogenic|Likely_pathogenic")


def parse_cigar(cigar: Column) -> Column:
    """CIGAR text -> array of (n, op)."""
    parts = F.regexp_extract_all(cigar, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    return F.transform(parts, lambda x: F.struct(x.substr(F.lit(1), F.length(x) - 1).cast("int").alias("n"), x.substr(F.length(x), F.lit(1)).alias("op")))


def reference_span(cigar_ops: Column) -> Column:
    """Reference bases a read covers."""
    return F.aggregate(
        cigar_ops,
        F.lit(0),
        lambda acc, o: acc + F.when(o["op"].isin("M", "D", "N", "=", "X"), o["n"]).otherwise(0),
    )
