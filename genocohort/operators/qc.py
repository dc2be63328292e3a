"""Sample quality, sex checks and genome-build validation: conditional counts, one pass per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import files as N
from ..functions import genotype as G
from .alleles import variants_only
from .regions import in_regions
from .running import nth_value


def in_range(value: Column, bounds: tuple) -> Column:
    return F.when(value.between(*bounds), "passed").otherwise("warning")


def sample_metrics(records: DataFrame) -> DataFrame:
    """Ti/Tv, het/hom, SNP and indel counts of every sample in one aggregation."""
    v = variants_only(records).withColumn("alt", F.get("alts", F.lit(0)))
    snv = (F.length("ref") == 1) & (F.length("alt") == 1)
    transition = snv & G.is_transition(F.col("ref"), F.col("alt"))
    cls = G.called_class(F.col("gt"))
    chr22 = F.col("chrom") == "22"
    counts = v.groupBy("sample_id").agg(
        F.count_if(transition).alias("transitions"),
        F.count_if(snv & ~transition).alias("transversions"),
        F.count_if(cls == "het").alias("n_het"),
        F.count_if(cls == "hom").alias("n_hom"),
        F.count_if(snv).alias("n_snps"),
        F.count_if(F.length("ref") != F.length("alt")).alias("n_indels"),
        F.count_if(snv & chr22).alias("n_snps_chr22"),
    )
    ti, tv = F.col("transitions"), F.col("transversions")
    scale = K.GENOME_LENGTH / K.CHR22_LENGTH
    return (
        counts.withColumn("titv", ti / F.when(tv > 0, tv))
        .withColumn("het_hom", F.col("n_het") / F.when(F.col("n_hom") > 0, F.col("n_hom")))
        .withColumn("titv_status", F.when(F.col("titv").isNull(), "failed").otherwise(in_range(F.col("titv"), K.TITV_RANGE)))
        .withColumn("het_hom_status", F.when(F.col("het_hom").isNull(), "failed").otherwise(in_range(F.col("het_hom"), K.HETHOM_RANGE)))
        .withColumn("snp_status", in_range(F.col("n_snps"), K.SNP_RANGE))
        .withColumn("indel_status", in_range(F.col("n_indels"), K.INDEL_RANGE))
        .withColumn("snps_scaled", F.round(F.col("n_snps_chr22") * scale).cast("bigint"))
    )


def is_site(alts: Column) -> Column:
    """A record with at least one real ALT."""
    return F.size(G.strip_symbolic(alts)) > 0


def sex_counts(records: DataFrame, male_homref: int = K.CHRY_HOMREF_MALE, female_het: float = K.CHRX_HET_FEMALE) -> DataFrame:
    """chrY count, chrX het rate (het calls of all variant records) and X:Y ratio checks, all from one pass."""
    x, y = F.col("chrom") == "X", F.col("chrom") == "Y"
    site = is_site(F.col("alts"))
    cls = G.called_class(F.col("gt"))
    hom_ref = site & cls.isin("ref", "hap_ref")
    alt = site & cls.isin("het", "hom", "hap_alt")
    c = records.groupBy("sample_id").agg(
        F.count_if(y).alias("y_records"), F.count_if(y & hom_ref).alias("y_hom_ref"),
        F.count_if(x).alias("x_records"),
        F.count_if(x & alt).alias("x_variants"), F.count_if(y & alt).alias("y_variants"),
        F.count_if(x & site & (cls == "het")).alias("x_het"), F.count_if(x & site).alias("x_sites"),
    )
    het_rate = F.col("x_het") / F.when(F.col("x_sites") > 0, F.col("x_sites"))
    ratio = F.col("x_variants") / F.when(F.col("y_variants") > 0, F.col("y_variants"))
    male = F.col("y_hom_ref") > male_homref
    return c.select(
        "*",
        F.when((F.col("x_records") == 0) & (F.col("y_records") == 0), "unknown").when(male, "Male").otherwise("Female").alias("chry_sex"),
        het_rate.alias("x_het_rate"),
        F.when(het_rate.isNull(), "unknown").when(het_rate > female_het, "Female").otherwise("Male").alias("chrx_sex"),
        ratio.alias("xy_ratio"),
        F.when(F.col("x_variants") == 0, "unknown").when(F.col("y_variants") == 0, "unknown (likely female)")
        .when(male, "Male").otherwise("Female").alias("xy_sex"),
    )


def upper_median(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Element n div 2 of the sorted values (not the mean of the middle two)."""
    return nth_value(df, by, value, lambda n: G.whole(n, 2), out)


def sry_check(records: DataFrame, region: tuple = K.SRY_REGION, min_depth: int = K.SRY_DEPTH_MALE) -> DataFrame:
    """Male when the region has a variant call, else by the upper median depth of its records."""
    chrom, first, last = region
    end = G.block_end(F.col("info_end"), F.col("pos"))
    here = records.where((F.col("chrom") == chrom) & (F.col("pos") <= last) & (end >= first))
    counts = here.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("region_records"), F.count_if(is_site(F.col("alts"))).alias("region_variants")
    )
    # only samples with records in the region reach the join; the rest are told by has_y
    presence = records.groupBy("sample_id").agg(F.bool_or(F.col("chrom") == chrom).alias("has_y"))
    median = upper_median(here, ["sample_id"], "min_dp", "median_depth")
    out = presence.join(counts, "sample_id", "left").join(median, "sample_id", "left")
    sex = (
        F.when(F.col("region_variants") > 0, "Male")
        .when(F.col("region_records").isNull(), "unknown")
        .when(F.coalesce("median_depth", F.lit(0)) >= min_depth, "Male")
        .otherwise("Female")
    )
    return out.select(
        "sample_id", "has_y", F.coalesce("region_records", F.lit(0)).alias("region_records"),
        F.coalesce("region_variants", F.lit(0)).alias("region_variants"), "median_depth", sex.alias("sry_sex"),
        F.when(F.col("region_records").isNull(), "warning").otherwise("passed").alias("status"),
    )


def countable_reads(reads: DataFrame) -> DataFrame:
    """Mapped primary reads of sufficient mapping quality."""
    return reads.where(
        (F.col("mapq") >= K.MIN_MAPQ) & (F.col("flag").bitwiseAND(K.FLAG_UNMAPPED | K.FLAG_SECONDARY) == 0)
    )


def sex_from_reads(
    reads: DataFrame, sry: tuple = K.SRY_REGION, male_y: int = K.CHRY_READS_MALE, male_sry: int = K.SRY_READS_MALE,
    ratio_bounds: tuple = K.XY_READ_RATIO_MALE,
) -> DataFrame:
    """chrY, SRY and X:Y read counts of every sample from one pass."""
    c = countable_reads(reads).groupBy("sample_id").agg(
        F.count_if(F.col("chrom") == "X").alias("x_reads"),
        F.count_if(F.col("chrom") == "Y").alias("y_reads"),
        F.count_if(in_regions([sry], pos="start_pos")).alias("sry_reads"),
    )
    ratio = F.when(F.col("y_reads") > 0, F.col("x_reads") / F.when(F.col("y_reads") > 0, F.col("y_reads"))).otherwise(F.lit(float("inf")))
    low, high = ratio_bounds

    def sex(test: Column) -> Column:
        return F.when(test, "Male").otherwise("Female")

    return c.select(
        "*", ratio.alias("xy_read_ratio"), sex(F.col("y_reads") > male_y).alias("chry_sex"),
        sex(F.col("sry_reads") >= male_sry).alias("sry_sex"), sex((ratio > low) & (ratio < high)).alias("xy_sex"),
    )


def sentinel_check(samples: DataFrame, records: DataFrame, sentinel: DataFrame, build: str = "GRCh38") -> DataFrame:
    """PASS / FAIL / NOT_FOUND by the build at whose sentinel position the sample has a call.

    ``sentinel``: build, chrom, pos (two rows).
    """
    hits = records.where(is_site(F.col("alts"))).join(sentinel, ["chrom", "pos"]).groupBy("sample_id").agg(
        F.bool_or(F.col("build") == build).alias("_here"), F.bool_or(F.col("build") != build).alias("_there")
    )
    here, there = F.coalesce("_here", F.lit(False)), F.coalesce("_there", F.lit(False))
    return samples.join(hits, "sample_id", "left").withColumn(
        "spot_check", F.when(here, "PASS").when(there, "FAIL").otherwise("NOT_FOUND")
    ).drop("_here", "_there")


def validate_build(samples: DataFrame, records: DataFrame, sentinel: DataFrame, build: str = "GRCh38") -> DataFrame:
    """PASS / WARN / FAIL from the declared build and the sentinel. ``samples``: sample_id, declared (nullable)."""
    checked = sentinel_check(samples, records, sentinel, build)
    declared = N.normal_build(F.col("declared"))
    status = (
        F.when(declared.isNotNull() & (declared != build), "FAIL")
        .when(F.col("spot_check") == "FAIL", "FAIL")
        .when((F.col("spot_check") == "NOT_FOUND") & F.col("declared").isNull(), "WARN")
        .otherwise("PASS")
    )
    # scoring goes on with a warning where validation fails
    return checked.withColumn("build_status", status).withColumn(
        "scoring_status", F.when(status == "FAIL", "WARN").otherwise(status)
    )


def scoring_file_quality(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts of what is wrong with a score's rows, the reasons, and ok / flagged / rejected."""
    bad_chrom = ~F.col("chrom").isin(K.SCORE_CHROMS)
    weight = F.col("weight_text").try_cast("double")
    c = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("variant_count"),
        F.count_if(bad_chrom).alias("bad_chroms"),
        F.count_if(~G.single_base(F.col("effect_allele"))).alias("bad_alleles"),
        F.count_if(weight.isNull() | F.isnan(weight)).alias("bad_weights"),
    )
    n = F.col("variant_count")
    reasons = F.filter(
        F.array(
            F.when(n == 0, "zero_variants").when(n < 5, "too_few_variants"),
            F.when(F.col("bad_chroms") > 0, "invalid_chroms"),
            F.when(F.col("bad_alleles") > n * 0.1, "invalid_alleles"),
            F.when(F.col("bad_weights") > 0, "bad_weights"),
        ),
        lambda r: r.isNotNull(),
    )
    return c.withColumn("reasons", reasons).withColumn(
        "eligibility", F.when(n < 5, "rejected").when(F.size("reasons") > 0, "flagged").otherwise("ok")
    )
