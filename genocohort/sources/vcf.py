"""VCF / gVCF records, ClinVar annotations and gVCF detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as N
from ..functions import genotype as G
from .lines import numbered_lines, read_lines


def parse_vcf(lines: DataFrame, keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """Record rows from VCF text lines: one row per body line and sample column.

    ``sample_no`` counts the sample columns from 0; it is null where a line has none.
    """
    body = lines.where((F.length("value") > 0) & ~F.col("value").startswith("#"))
    f = F.split("value", "\t")
    info = F.str_to_map(F.get(f, F.lit(7)), F.lit(";"), F.lit("="))
    format_keys = F.split(F.coalesce(F.get(f, F.lit(8)), F.lit("")), ":")
    columns = F.when(F.size(f) > 9, F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(0))))
    sample = F.split(F.coalesce(F.col("sample_text"), F.lit("")), ":")

    def field(key: str):
        place = F.array_position(format_keys, key).cast("int")
        return F.when(place > 0, F.get(sample, place - 1))

    end = F.element_at(info, "END")
    carried = [*keep, *[c for c in ("line_order", "line_no") if c in lines.columns]]
    out = body.select(*carried, "value", F.posexplode_outer(columns).alias("sample_no", "sample_text")).select(
        *carried, "sample_no",
        G.bare_chrom(f[0]).alias("chrom"),
        F.get(f, F.lit(1)).try_cast("bigint").alias("pos"),
        F.get(f, F.lit(2)).alias("id"),
        F.upper(F.get(f, F.lit(3))).alias("ref"),
        F.get(f, F.lit(4)).alias("alt_csv"),
        F.get(f, F.lit(6)).alias("filter"),
        info.alias("info"),
        end.alias("info_end"),
        F.coalesce(field("GT"), F.lit("./.")).alias("gt"),
        field("MIN_DP").try_cast("int").alias("min_dp"),
    ).where(F.col("pos").isNotNull())
    alts = F.split("alt_csv", ",")
    return out.withColumn("alts", alts).withColumn(
        "end_pos", G.block_end(F.col("info_end"), F.col("pos"))
    ).withColumn("is_ref_block", G.is_ref_block(F.col("alts"), F.col("gt")))


def sample_names(lines: DataFrame, by: str = "file") -> DataFrame:
    """(file, sample_no, sample_id) from the column header of each file, once if it is repeated; a file with one sample is named by its
    file."""
    names = F.split("value", "\t")
    heads = lines.where(F.col("value").startswith("#CHROM") & (F.size(names) > 9))
    named = heads.select(by, F.size(names).alias("_n"), F.posexplode(F.slice(names, F.lit(10), F.greatest(F.size(names) - 9, F.lit(0)))).alias("sample_no", "_name")).select(
        by, "sample_no", F.when(F.col("_n") > 10, F.col("_name")).otherwise(N.sample_from_file(N.base_name(F.col(by)))).alias("sample_id")
    )
    return named.groupBy(by, "sample_no").agg(F.min("sample_id").alias("sample_id"))


def with_samples(records: DataFrame, names: DataFrame, by: str = "file") -> DataFrame:
    """Records named by file and sample column (``names``: by, sample_no, sample_id). Without a header the first column has the name of its
    file, and each further one that name and its number, so that samples never mix."""
    of_file = N.sample_from_file(N.base_name(F.col(by)))
    unnamed = F.when(F.coalesce("sample_no", F.lit(0)) > 0, F.concat(of_file, F.lit("#"), (F.col("sample_no") + 1).cast("string"))).otherwise(of_file)
    return records.join(names, [by, "sample_no"], "left").withColumn("sample_id", F.coalesce("sample_id", unnamed)).drop("sample_no")


def read_vcf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All records of all samples of all files, with their line in the file (``line_no``); joined by file and sample column, so a large
    file is many keys or one that can be split."""
    return with_samples(parse_vcf(numbered_lines(spark, paths)), sample_names(read_lines(spark, paths)))


def detect_gvcf(records: DataFrame, by: list[str]) -> DataFrame:
    """gVCF by file name, else by symbolic ALTs or END in its records."""
    marked = F.exists("alts", lambda a: a.isin("<*>", "<NON_REF>")) | F.col("info_end").isNotNull()
    named = F.lower(F.col("file")).rlike(r"\.(g\.vcf|gvcf)(\.gz)?$")
    return records.groupBy(*by).agg((F.bool_or(named) | F.bool_or(marked)).alias("is_gvcf"))


def clinvar_table(records: DataFrame) -> DataFrame:
    """One row per (position, ALT) with significance and gene text."""
    return records.select(
        "chrom", "pos", "ref", F.explode("alts").alias("alt"),
        F.element_at("info", "CLNSIG").alias("clnsig"), F.element_at("info", "GENEINFO").alias("geneinfo"),
    )
