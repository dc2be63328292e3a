"""Principal-component projection, centroids, admixture shares and haplogroups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import genotype as G
from .picks import first_rows

SUPERPOPS = ["AFR", "AMR", "EAS", "EUR", "SAS"]


def allele_frequencies(calls: DataFrame, by: Sequence[str] = ("chrom", "pos")) -> DataFrame:
    """ALT frequency, missing rate and minor-allele frequency per variant."""
    d = F.col("dosage")
    called = F.count(d)
    return calls.groupBy(*by).agg(
        called.alias("n_called"), F.count(F.lit(1)).alias("n_records"),
        (F.sum(d) / F.when(called > 0, 2 * called)).alias("alt_freq"),
    ).withColumn("missing_rate", 1 - F.col("n_called") / F.col("n_records")).withColumn(
        "maf", F.least("alt_freq", 1 - F.col("alt_freq"))
    )


def panel_sites(calls: DataFrame, min_maf: float = 0.05, max_missing: float = 0.02) -> DataFrame:
    """Autosomal biallelic SNVs that are common and well called."""
    snvs = calls.where(
        F.col("chrom").isin(K.AUTOSOMES) & (F.length("ref") == 1) & (F.length("alt") == 1)
    )
    freq = allele_frequencies(snvs, ["chrom", "pos", "ref", "alt"])
    return freq.where((F.col("maf") >= min_maf) & (F.col("missing_rate") <= max_missing))


def standardised(dosage: Column, freq: Column) -> Column:
    """(d - 2p) / sqrt(2p(1-p)); null for a variant without variation."""
    return (dosage - 2 * freq) / F.when((freq > 0) & (freq < 1), F.sqrt(2 * freq * (1 - freq)))


def project(calls: DataFrame, frequencies: DataFrame, loadings: DataFrame, n: int = 10) -> DataFrame:
    """PCs per sample: standardised dosage times loading, averaged over twice the called variants.

    ``loadings``: chrom, pos, loadings array.
    """
    f = frequencies.select("chrom", "pos", F.col("alt_freq").alias("_p")).where((F.col("_p") > 0) & (F.col("_p") < 1))
    w = loadings.select("chrom", "pos", "loadings").join(f, ["chrom", "pos"])
    joined = calls.where(F.col("dosage").isNotNull()).join(w, ["chrom", "pos"]).withColumn(
        "_z", standardised(F.col("dosage"), F.col("_p"))
    )
    sums = [F.sum(F.col("_z") * F.get("loadings", F.lit(i))).alias(f"_s{i}") for i in range(n)]
    per = joined.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_variants"), *sums)
    return per.select(
        "sample_id", "n_variants", F.array(*[F.col(f"_s{i}") / (2 * F.col("n_variants")) for i in range(n)]).alias("pcs")
    )


def centroids(projected: DataFrame, samples: DataFrame, n: int = 10) -> DataFrame:
    """Mean PCs per super-population, in the projected space."""
    means = [F.avg(F.get("pcs", F.lit(i))).alias(f"_m{i}") for i in range(n)]
    return projected.join(samples.select("sample_id", "superpop"), "sample_id").groupBy("superpop").agg(*means).select(
        "superpop", F.array(*[F.col(f"_m{i}") for i in range(n)]).alias("centroid")
    )


def distance(a: Column, b: Column, dims: int = K.ADMIXTURE_PCS) -> Column:
    squares = F.zip_with(F.slice(a, 1, dims), F.slice(b, 1, dims), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, s: acc + s))


def centroid_distances(projected: DataFrame, centres: DataFrame) -> DataFrame:
    """One row per (sample, super-population). The populations are a fixed list, so this is an equi join."""
    asked = projected.withColumn("superpop", F.explode(F.array(*[F.lit(p) for p in SUPERPOPS])))
    return asked.join(F.broadcast(centres), "superpop").select(
        "sample_id", "superpop", distance(F.col("pcs"), F.col("centroid")).alias("distance")
    )


def ranked_distances(distances: DataFrame) -> DataFrame:
    """Distances of a sample as an array, nearest first; five entries."""
    return distances.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct("distance", "superpop"))).alias("ranked")
    )


def closest_population(distances: DataFrame) -> DataFrame:
    r = F.col("ranked")
    first, second = F.get(r, F.lit(0)), F.get(r, F.lit(1))
    clear = second["distance"] - first["distance"] > 0.3 * first["distance"]
    return ranked_distances(distances).select(
        "sample_id", first["superpop"].alias("population"), first["distance"].alias("distance"),
        second["superpop"].alias("second_population"), second["distance"].alias("second_distance"),
        F.when(clear, "high").otherwise("moderate").alias("confidence"),
    )


def admixture(distances: DataFrame) -> DataFrame:
    """Softmax of minus distance over a fixed scale, as percent per (sample, super-population)."""
    nearest = distances.groupBy("sample_id").agg(F.min("distance").alias("_min"))
    e = distances.join(nearest, "sample_id").withColumn(
        "_e", F.exp(-(F.col("distance") - F.col("_min")) / K.ADMIXTURE_SCALE)
    )
    total = e.groupBy("sample_id").agg(F.sum("_e").alias("_total"))
    return e.join(total, "sample_id").select(
        "sample_id", "superpop", F.round(100 * F.col("_e") / F.col("_total"), 1).alias("percent"),
        (F.col("_e") / F.col("_total")).alias("share"),
    )


def admixture_shares(shares: DataFrame) -> DataFrame:
    """(sample, map population -> fraction), as the reference choice expects."""
    return shares.groupBy("sample_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("superpop", "share")))).alias("shares")
    )


def archaic_estimate(closest: DataFrame) -> DataFrame:
    table = closest.sparkSession.createDataFrame(K.ARCHAIC_RANGE, "population string, low double, high double")
    return closest.join(F.broadcast(table), "population").withColumn(
        "estimate", F.round((F.col("low") + F.col("high")) / 2, 2)
    )


# ---- haplogroups ---------------------------------------------------------------------------------------------------


def derived_markers(records: DataFrame, markers: DataFrame) -> DataFrame:
    """Marker hits: position, exact REF, primary ALT, and the sample carries it."""
    primary = F.get(G.strip_symbolic(F.col("alts")), F.lit(0))
    real = records.withColumn("alt", primary).where(F.col("alt").isNotNull() & G.carries_alt(F.col("gt")))
    return real.select("sample_id", "chrom", "pos", "ref", "alt").join(markers, ["chrom", "pos", "ref", "alt"])


def derived_positions(records: DataFrame, markers: DataFrame) -> DataFrame:
    """Mitochondrial form: position and ALT, no REF in the marker table."""
    primary = F.get(G.strip_symbolic(F.col("alts")), F.lit(0))
    real = records.withColumn("alt", primary).where(F.col("alt").isNotNull() & G.carries_alt(F.col("gt")))
    return real.select("sample_id", "chrom", "pos", "alt").join(markers, ["chrom", "pos", "alt"])


def marker_support(hits: DataFrame, markers: DataFrame) -> DataFrame:
    """Derived count, label total and rate per (sample, label)."""
    totals = markers.groupBy("haplogroup").agg(F.count(F.lit(1)).alias("label_total"))
    counts = hits.groupBy("sample_id", "haplogroup").agg(F.count(F.lit(1)).alias("derived"))
    return counts.join(totals, "haplogroup").withColumn("rate", F.col("derived") / F.col("label_total"))


def pick_haplogroup(support: DataFrame, min_derived: int = 5, min_rate: float = 0.5) -> DataFrame:
    """Deepest strongly supported label; without one, the label with most markers."""
    strong = (F.col("derived") >= min_derived) & (F.col("rate") >= min_rate)
    depth = F.length("haplogroup")
    s = support.withColumn("strong", strong)
    order = [
        F.col("strong").desc(),
        F.when(F.col("strong"), depth).otherwise(F.col("derived")).desc(),
        F.when(F.col("strong"), F.col("derived")).otherwise(depth).desc(),
        F.when(F.col("strong"), F.col("rate")).desc(),
        F.col("haplogroup"),
    ]
    return first_rows(s, ["sample_id"], order)


def top_labels(support: DataFrame, k: int = 5) -> DataFrame:
    return first_rows(
        support, ["sample_id"], [F.col("derived").desc(), F.length("haplogroup").desc(), F.col("haplogroup")], k, "place"
    )
