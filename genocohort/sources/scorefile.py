"""Score weight files: ``#key=value`` metadata, a header row, tab-separated weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as N
from ..functions import genotype as G
from .lines import read_lines, split_columns, worked_out


def score_id_of(path: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(path, r"(?i)(PGS\d{6,})", 1)), F.lit(""))


def parse_metadata(lines: DataFrame, by: str = "file") -> DataFrame:
    """Metadata map per file; a handful of lines each."""
    pairs = lines.select(by, N.header_pairs(F.col("value")).alias("p")).where(F.col("p").isNotNull())
    unique = pairs.groupBy(by, F.col("p.key").alias("key")).agg(F.max("p.value").alias("value"))
    return unique.groupBy(by).agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata")
    )


def _names_weight() -> Column:
    """A line with a cell ``effect_weight``; only the few that hold the word at all are split."""
    return F.col("value").contains("effect_weight") & F.array_contains(F.split("value", "\t"), "effect_weight")


def column_names(lines: DataFrame, by: str = "file") -> DataFrame:
    """The header row of each file, recognised by its mandatory columns."""
    names = F.split("value", "\t")
    return lines.where(
        ~F.col("value").startswith("#") & F.col("value").contains("effect_allele") & _names_weight() & F.array_contains(names, "effect_allele")
    ).groupBy(by).agg(F.min_by(names, F.col("value")).alias("names"))


def usable_rows(rows: DataFrame) -> DataFrame:
    """Position, effect allele and a castable weight are required."""
    return rows.withColumn("weight", F.trim("weight_text").try_cast("double")).where(
        F.col("chrom").isNotNull() & F.col("pos").isNotNull()
        & G.clean_text(F.col("effect_allele")).isNotNull() & F.col("weight").isNotNull() & ~F.isnan("weight")
    )


def parse_weights(lines: DataFrame, by: str = "file") -> DataFrame:
    """Typed weight rows. Harmonised columns are used when the file has them, judged per file by its header."""
    headers = column_names(lines, by)
    cells = split_columns(lines.where(~F.col("value").startswith("#") & (F.length("value") > 0) & ~_names_weight()), headers, by)

    def has(name: str) -> Column:
        return F.map_contains_key("cells", name)

    def cell(name: str) -> Column:
        return F.try_element_at("cells", F.lit(name))

    # the cells of a row are looked up once, not again for every filter on them
    texts = worked_out(
        cells,
        _chrom=F.when(has("hm_chr"), cell("hm_chr")).otherwise(cell("chr_name")),
        _pos=F.when(has("hm_pos"), cell("hm_pos")).otherwise(cell("chr_position")),
        _effect=cell("effect_allele"), _other=cell("other_allele"), _inferred=cell("hm_inferOtherAllele"), _weight=cell("effect_weight"),
    )
    rows = texts.select(
        by, *[c for c in ("line_order",) if c in lines.columns],
        G.bare_chrom(G.clean_text(F.col("_chrom"))).alias("chrom"),
        G.clean_text(F.col("_pos")).try_cast("bigint").alias("pos"),
        F.upper(F.trim("_effect")).alias("effect_allele"),
        F.upper(G.first_present(F.col("_other"), F.col("_inferred"))).alias("other_allele"),
        F.col("_weight").alias("weight_text"),
    )
    return usable_rows(rows)


def read_weights(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The whole corpus by glob in one scan, keyed by the score id in the file name."""
    return parse_weights(read_lines(spark, paths)).withColumn("pgs_id", score_id_of(F.col("file")))
