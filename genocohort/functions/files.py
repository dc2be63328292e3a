"""File names, builds and header facts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_class(path: Column) -> Column:
    """gvcf / vcf / bam / cram, or an empty string."""
    p = F.lower(path)
    return (
        F.when(p.rlike(r"(\.g\.vcf\.gz|\.gvcf\.gz|\.gvcf)$"), "gvcf")
        .when(p.rlike(r"(\.vcf\.gz|\.vcf|\.bcf)$"), "vcf")
        .when(p.endswith(".bam"), "bam")
        .when(p.endswith(".cram"), "cram")
        .otherwise("")
    )


def input_label(path: Column) -> Column:
    p = F.lower(path)
    return (
        F.when(p.rlike(r"\.g\.vcf(\.gz)?$"), "gVCF")
        .when(p.rlike(r"\.vcf(\.gz)?$"), "VCF")
        .when(p.endswith(".bam"), "BAM")
        .when(p.endswith(".cram"), "CRAM")
        .otherwise("unknown")
    )


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def sample_from_file(name: Column) -> Column:
    """Drop one known extension: ``P1.g.vcf.gz`` -> ``P1``."""
    return F.trim(F.regexp_replace(name, r"(?i)\.(g\.vcf\.gz|gvcf\.gz|vcf\.gz|g\.vcf|gvcf|vcf|bcf|bam|cram|gz)$", ""))


def normal_build(name: Column) -> Column:
    n = F.lower(F.trim(name))
    return (
        F.when(n.isin("grch38", "hg38", "hs38dh"), "GRCh38")
        .when(n.isin("grch37", "hg19", "hs37d5"), "GRCh37")
    )


def header_build(line: Column) -> Column:
    """Build named by a ``##reference`` or ``##contig`` header line, else null."""
    named = F.regexp_extract(line, r"(?i)(GRCh38|GRCh37|hg38|hg19|hs37d5|hs38DH)", 1)
    return F.when(line.rlike("^##(reference|contig)") & (named != ""), named)


def scoring_file_build(path: Column, columns: Column) -> Column:
    """Build of the positions that will be read: harmonised positions are always GRCh38."""
    labelled = path.contains("_GRCh38") | path.contains("_GRCh37")
    return (
        F.when(labelled & F.array_contains(columns, "hm_pos"), "GRCh38")
        .when(labelled, "GRCh37")
        .otherwise("unknown")
    )


def scoring_file_source(path: Column) -> Column:
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "unknown")
        .when(path.contains("_hmPOS_GRCh38"), "harmonized_GRCh38")
        .when(path.contains("_hmPOS_GRCh37"), "harmonized_GRCh37")
        .otherwise("original")
    )


def header_pairs(line: Column) -> Column:
    """``#key=value`` -> struct(key, value); null for any other line."""
    pattern = r"^#+([^=#]+)=(.*)$"
    return F.when(
        line.rlike(pattern),
        F.struct(
            F.trim(F.regexp_extract(line, pattern, 1)).alias("key"),
            F.trim(F.regexp_extract(line, pattern, 2)).alias("value"),
        ),
    )


def is_score_id(text: Column) -> Column:
    return F.upper(F.trim(text)).rlike(r"^PGS\d{6,}$")
