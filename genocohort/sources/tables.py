"""Tab-separated dimension tables: panel samples, curated positions, PCA weights, haplogroup markers, caller output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clinical as C
from ..functions import genotype as G


def parse_panel_samples(rows: DataFrame) -> DataFrame:
    """(iid, superpop) from two text columns; header-like rows drop out."""
    return rows.where(~F.col("iid").startswith("#") & (F.upper("iid") != "IID") & (F.trim("iid") != "")).select(
        F.trim("iid").alias("iid"), F.trim("superpop").alias("superpop")
    )


def read_panel_samples(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, sep="\t", schema="iid string, superpop string")
    return parse_panel_samples(raw)


def resolve_positions(wanted: DataFrame, *tiers: DataFrame) -> DataFrame:
    """rsID -> (chrom, pos, ref, alt) from the first tier that knows it; ``tier`` is 1-based, null when none does."""
    out = wanted
    for i, tier in enumerate(tiers):
        t = tier.select("rsid", F.struct("chrom", "pos", "ref", "alt", F.lit(i + 1).alias("tier")).alias(f"_t{i}"))
        out = out.join(t, "rsid", "left")
    pick = F.coalesce(*[F.col(f"_t{i}") for i in range(len(tiers))])
    return out.withColumn("_p", pick).select(*wanted.columns, "_p.*")


def parse_y_markers(rows: DataFrame) -> DataFrame:
    """Single-base ``ref->alt`` markers with a numeric position and a plain label."""
    bases = F.split(F.upper(F.trim("mutation")), "->")
    label = F.regexp_replace(F.trim("haplogroup"), r"[~\s].*$", "")
    return rows.select(
        F.trim("name").alias("name"), label.alias("haplogroup"), F.trim("pos").try_cast("bigint").alias("pos"),
        F.get(bases, F.lit(0)).alias("ref"), F.get(bases, F.lit(1)).alias("alt"),
    ).where(
        F.col("pos").isNotNull() & G.single_base(F.col("ref")) & G.single_base(F.col("alt"))
        & (F.size(F.split(F.col("haplogroup"), "")) > 0) & (F.col("haplogroup") != "")
    )


def pca_weight_table(rows: DataFrame, n: int = 10) -> DataFrame:
    """``#CHROM ID REF ALT A1 PC1..PCn`` -> (chrom, pos, ref, alt, a1, loadings array)."""
    id_parts = F.split("ID", ":")
    return rows.select(
        G.bare_chrom(F.col("#CHROM").cast("string")).alias("chrom"), F.get(id_parts, F.lit(1)).try_cast("bigint").alias("pos"),
        F.col("REF").alias("ref"), F.col("ALT").alias("alt"), F.col("A1").alias("a1"),
        F.array(*[F.col(f"PC{i}").cast("double") for i in range(1, n + 1)]).alias("loadings"),
    )


def read_pca_weights(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    return pca_weight_table(spark.read.csv(path, sep="\t", header=True), n)


def parse_hla_calls(rows: DataFrame) -> DataFrame:
    """``gene n allele1 abundance1 qual1 allele2 ...`` text rows -> gene and its one or two primary calls."""
    f = F.split("value", "\t")
    n = F.get(f, F.lit(1)).try_cast("int")
    first = F.when(n >= 1, C.primary_hla_call(F.get(f, F.lit(2))))
    second = F.when(n >= 2, C.primary_hla_call(F.get(f, F.lit(5))))
    return rows.where((F.size(f) >= 5) & n.isNotNull()).select(
        *[c for c in rows.columns if c != "value"], f[0].alias("gene"),
        F.filter(F.array(first, second), lambda a: a.isNotNull()).alias("alleles"),
    ).where(F.size("alleles") > 0)


def parse_repeat_counts(records: DataFrame) -> DataFrame:
    """FORMAT / sample text with ``REPCN a/b`` -> both repeat counts."""
    keys, values = F.split("format", ":"), F.split("sample", ":")
    place = F.array_position(keys, "REPCN").cast("int")
    counts = F.transform(F.split(F.when(place > 0, F.get(values, place - 1)), "/"), lambda c: c.try_cast("int"))
    return records.withColumn("counts", F.filter(counts, lambda c: c.isNotNull())).where(F.size("counts") > 0).drop(
        "format", "sample"
    )


def parse_diplotype(rows: DataFrame) -> DataFrame:
    """Caller output ``sample<TAB>diplotype<TAB>filter`` -> diplotype or null when there is no call."""
    f = F.split("value", "\t")
    call = F.trim(F.get(f, F.lit(1)))
    return rows.select(
        *[c for c in rows.columns if c != "value"],
        F.when(~F.coalesce(call, F.lit("None")).isin("None", "", "."), call).alias("diplotype"),
    )
