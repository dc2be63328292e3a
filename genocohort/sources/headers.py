"""Facts from header lines: builds, contigs, samples, caller, platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..constants import CHR1_LENGTHS
from ..functions import files as N


def build_of_length(length: Column) -> Column:
    out = F.lit("unknown")
    for known, build in CHR1_LENGTHS:
        out = F.when(length == known, build).otherwise(out)
    return out


def build_from_contigs(contigs: DataFrame, by: list[str]) -> DataFrame:
    """Build by the length of chromosome 1, and whether names carry ``chr``."""
    first = F.max(F.when(F.col("contig").isin("1", "chr1"), F.col("length")))
    return contigs.groupBy(*by).agg(
        build_of_length(first).alias("build"), F.bool_or(F.col("contig").startswith("chr")).alias("has_chr")
    )


def header_facts(lines: DataFrame, by: str = "file") -> DataFrame:
    """One row per file from its ``#`` lines: declared build, contig count, chr1 length, samples, caller, platform.

    The caller is the one a DeepVariant line names, with its version; else the first of a source line that names a known caller and a
    GATK command line (without ``line_no`` the source line goes first).
    """
    v = F.col("value")
    heads = lines.where(v.startswith("#") | v.startswith("@"))
    contig = F.when(v.startswith("##contig"), F.regexp_extract(v, r"ID=([^,>]+)", 1)).when(
        v.startswith("@SQ"), F.regexp_extract(v, r"SN:(\S+)", 1)
    )
    length = F.when(v.startswith("##contig"), F.regexp_extract(v, r"length=(\d+)", 1)).when(
        v.startswith("@SQ"), F.regexp_extract(v, r"LN:(\d+)", 1)
    ).try_cast("bigint")
    columns = F.split(v, "\t")
    in_columns = F.when(F.size(columns) > 9, F.slice(columns, 10, F.greatest(F.size(columns) - 9, F.lit(0))))
    samples = F.when(v.startswith("#CHROM"), in_columns).when(v.startswith("@RG"), F.array(F.regexp_extract(v, r"SM:(\S+)", 1)))
    order = F.col("line_no") if "line_no" in lines.columns else F.lit(0)
    source = F.trim(F.regexp_extract(v, "^##source[^=]*=(.*)$", 1))
    deep = F.rtrim(F.concat(F.lit("DeepVariant "), F.trim(F.regexp_extract(v, "^##DeepVariant[^=]*=(.*)$", 1))))
    named = lambda rank, kind, name: F.struct(F.lit(rank).alias("rank"), order.alias("order"), F.lit(kind).alias("kind"), name.alias("name"))
    caller = (
        F.when(v.startswith("##DeepVariant"), named(0, 0, deep))
        .when(v.startswith("##source") & F.lower(source).rlike("|".join(K.VARIANT_CALLERS)), named(1, 0, source))
        .when(v.startswith("##GATKCommandLine"), named(1, 1, F.lit(K.GATK_NAME)))
    )
    platform = F.when(v.startswith("@RG"), F.upper(F.regexp_extract(v, r"PL:(\S+)", 1)))
    facts = heads.select(
        by, contig.alias("contig"), length.alias("length"), samples.alias("samples"), caller.alias("caller"),
        platform.alias("platform"), N.header_build(v).alias("declared"),
    )
    chr1 = F.max(F.when(F.col("contig").isin("1", "chr1"), F.col("length")))
    return facts.groupBy(by).agg(
        F.coalesce(N.normal_build(F.max("declared")), build_of_length(chr1)).alias("build"),
        F.count("contig").alias("n_contigs"),
        F.sum("length").alias("genome_length"),
        F.coalesce(F.bool_or(F.col("contig").startswith("chr")), F.lit(False)).alias("has_chr"),
        # one header's sample names, in code point order
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("samples")))).alias("_samples"),
        F.min("caller")["name"].alias("caller"),
        F.max("platform").alias("platform"),
    ).withColumns({"samples": F.array_join("_samples", ","), "n_samples": F.size("_samples")}).drop("_samples")


def coverage_estimate(mapped: Column, genome_length: Column, platform: Column) -> Column:
    """Mean depth: mapped reads times read length (5000 for long-read platforms, else 150) over genome length."""
    read_length = F.when(F.upper(platform).isin("ONT", "PACBIO"), 5000).otherwise(150)
    return F.round(mapped * read_length / F.when(genome_length > 0, genome_length), 1)
