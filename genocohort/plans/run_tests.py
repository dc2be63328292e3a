"""Run a set of tests over samples: every kind of test is one plan over all samples that ask for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clinical as P
from ..operators import lookup as L
from ..operators import mart as M
from ..operators import qc as Q
from ..operators import scoring as O
from ..session import written


def choose_tests(tests: DataFrame, test_id: str | None = None, category: str | None = None, curated: DataFrame | None = None) -> DataFrame:
    """One test, a category, a curated list, or all of them."""
    if test_id is not None:
        return tests.where(F.col("test_id") == test_id)
    if category is not None:
        return tests.where(F.col("category") == category)
    return tests if curated is None else tests.join(curated, "test_id", "left_semi")


def specialized_results(
    populations: DataFrame, admixture: DataFrame, archaic: DataFrame, y_haplogroups: DataFrame, mt_evidence: DataFrame,
    roh: DataFrame, hla: DataFrame, proxies: DataFrame, repeats: DataFrame,
) -> DataFrame:
    """(sample_id, target, status, headline) of the specialized tests, from the results of their operators.

    Targets are the method, with the allele or gene behind a colon where a test names one. The mtDNA headline tells the label
    with most derived markers, as the tree walk is not built. One sample has one result per target.
    """
    text = lambda c: F.col(c).cast("string")
    best = M.first_rows(mt_evidence, ["sample_id"], [F.col("derived").desc(), F.length("haplogroup").desc(), F.col("haplogroup")])
    carrier = F.col("carrier_state") == "carrier"
    parts = [
        (populations, F.lit("pca_1000g"), F.lit("passed"), F.concat(F.lit("Ancestry: "), "population", F.lit(" ("), "confidence", F.lit(" confidence)"))),
        (admixture, F.lit("admixture"), F.lit("passed"), F.concat(F.lit("Admixture: "), F.format_number("top_percent", 1), F.lit("% "), "top_population")),
        (archaic, F.lit("neanderthal"), F.lit("passed"), F.concat(F.lit("Neanderthal: about "), F.format_number("estimate", 2), F.lit("% ("), "population", F.lit(")"))),
        (y_haplogroups, F.lit("y_haplogroup"), F.lit("passed"), F.col("headline")),
        (best, F.lit("mt_haplogroup"), F.lit("passed"), F.concat(F.lit("mtDNA: "), "haplogroup", F.lit(" ("), text("mt_variants"), F.lit(" chrM variants)"))),
        (roh, F.lit("roh"), F.lit("passed"), F.col("headline")),
        (hla, F.lit("hla_typing"), F.lit("passed"), F.col("headline")),
        (proxies, F.concat(F.lit("hla_typing:"), "hla_allele"), F.when(carrier | (F.col("carrier_state") == "undetermined"), "warning").otherwise("passed"),
         F.when(F.col("carrier_state") == "undetermined", F.concat("hla_allele", F.lit(": proxy SNP "), "rsid", F.lit(" not in VCF")))
         .otherwise(F.concat("hla_allele", F.lit(": "), F.when(carrier, "CARRIER").otherwise("non-carrier"), F.lit(" (proxy "), "rsid", F.lit(")")))),
        (repeats, F.concat(F.lit("repeat_expansion:"), "gene"), F.when(F.col("carrier"), "carrier").otherwise("negative"),
         F.concat("gene", F.lit(": "), "repeat_class", F.lit(" ("), F.array_join(F.col("counts").cast("array<string>"), "/"), F.lit(" repeats)"))),
    ]
    out = None
    for rows, target, status, headline in parts:
        part = rows.select("sample_id", target.alias("target"), status.alias("status"), headline.alias("headline"))
        out = part if out is None else out.unionByName(part)
    return out


def run_tests(
    requests: DataFrame, tests: DataFrame, records: DataFrame, genotypes: DataFrame, weights: DataFrame,
    test_variants: DataFrame, annotations: DataFrame, panel_genes: DataFrame, specialized: DataFrame | None = None,
) -> DataFrame:
    """(sample_id, test_id, status, headline) for every requested pair.

    ``requests``: sample_id, test_id. ``tests``: test_id, category, test_type, target (score id, variant test, panel,
    metric or method). ``specialized``: sample_id, target, status, headline, as of ``specialized_results``.
    """
    # every kind reads the requests, and so does the end: written once, or each would work them out again
    asked = written(requests.join(tests.select("test_id", "category", "test_type", "target"), "test_id"), "asked")
    kinds = {row["test_type"] for row in asked.select("test_type").distinct().collect()}

    def of(kind: str) -> DataFrame:
        rows = asked.where(F.col("test_type") == kind).drop("category", "test_type")
        # a kind that nobody asks for is known to be empty when the job is planned: its records are not shuffled to find that out
        return rows if kind in kinds else rows.limit(0)

    wanted_scores = of("pgs_score").withColumnRenamed("target", "pgs_id")
    # samples and scores that nobody asked for go before anything is matched, pairs as they are summed
    asked_weights = weights.join(wanted_scores.select("pgs_id").distinct(), "pgs_id", "left_semi")
    asked_calls = genotypes.join(wanted_scores.select("sample_id").distinct(), "sample_id", "left_semi")
    sides = O.settled(asked_calls, asked_weights)
    matched = O.match_effect_allele(*sides, parts=O.parts_by_score(*sides), asked=wanted_scores.select("sample_id", "pgs_id").distinct())
    scored = O.with_match_rate(O.sum_asked(matched), sides[1]).join(wanted_scores, ["sample_id", "pgs_id"])
    scores = scored.select(
        "sample_id", "test_id", "status",
        F.concat(F.lit("Matched "), F.col("matched").cast("string"), F.lit("/"), F.col("total").cast("string")).alias("headline"),
    )

    wanted = of("variant_lookup").withColumnRenamed("target", "test_no")
    lookups = L.lookup_rollup(L.look_up(wanted, records, listed=test_variants), ["sample_id", "test_id"]).select("sample_id", "test_id", "status", "headline")

    screens_asked = of("clinvar_screen").withColumnRenamed("target", "panel")
    findings = P.pathogenic_findings(P.annotate(records, annotations), panel_genes)
    screens = P.screen_rollup(screens_asked.select("sample_id", "panel").distinct(), panel_genes, findings).join(
        screens_asked, ["sample_id", "panel"]
    ).select("sample_id", "test_id", "status", "headline")

    metric = F.col("target")
    stats_asked = of("vcf_stats")
    measured = Q.sample_metrics(records.join(stats_asked.select("sample_id").distinct(), "sample_id", "left_semi"))
    qc = stats_asked.join(measured, "sample_id").select(
        "sample_id", "test_id",
        F.when(metric == "titv", F.col("titv_status")).when(metric == "het_hom", F.col("het_hom_status"))
        .when(metric == "snps", F.col("snp_status")).when(metric == "indels", F.col("indel_status")).alias("status"),
        F.concat(metric, F.lit(": "), F.when(metric == "snps", F.col("n_snps").cast("string")).when(metric == "indels", F.col("n_indels").cast("string"))
                 .when(metric == "titv", F.format_number("titv", 3)).otherwise(F.format_number("het_hom", 3))).alias("headline"),
    )
    done = scores.unionByName(lookups).unionByName(screens).unionByName(qc)
    if specialized is not None:
        done = done.unionByName(of("specialized").join(specialized, ["sample_id", "target"]).select("sample_id", "test_id", "status", "headline"))
    # a requested pair without any row of input fails rather than vanishes
    return M.with_contract(
        asked.drop("test_type", "target").join(done, ["sample_id", "test_id"], "left")
        .withColumn("status", F.coalesce("status", F.lit("failed"))).withColumn("headline", F.coalesce("headline", F.lit("No data")))
    )
