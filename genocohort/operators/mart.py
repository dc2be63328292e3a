"""Result mart: latest and best results, file choice, report texts, batches, catalogue search."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.genotype import whole
from .. import constants as K
from ..functions import files as N
from ..session import cut_lineage
from .picks import first_rows
from .running import running_total


def latest_reports(reports: DataFrame, by: Sequence[str] = ("file_id", "test_id")) -> DataFrame:
    return first_rows(reports, by, [F.col("completed_at").desc(), F.col("task_id").desc()])


def best_results(reports: DataFrame, by: Sequence[str] = ("test_id",), k: int | None = None) -> DataFrame:
    """Best first: match rate, then newest; ``place`` counts from 1. All of them, or the first ``k`` per group."""
    order = [F.col("match_rate").desc(), F.col("completed_at").desc(), F.col("task_id").desc()]
    if k is not None:
        return first_rows(reports, by, order, k, "place")
    return reports.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def report_list(reports: DataFrame, files: DataFrame) -> DataFrame:
    """Reports with the file's name, or a marker with the id when the file is gone."""
    named = reports.join(files.select("file_id", "file_name"), "file_id", "left")
    return named.withColumn(
        "file_name", F.coalesce("file_name", F.concat(F.lit("(unknown: "), F.col("file_id").cast("string"), F.lit(")")))
    )


def newest_reports(reports: DataFrame, n: int) -> DataFrame:
    """The n newest; Spark keeps n rows per task and merges those."""
    return reports.orderBy(F.col("completed_at").desc(), F.col("task_id").desc()).limit(n)


def reportable(results: DataFrame) -> DataFrame:
    return results.where(~F.coalesce("no_report", F.lit(False)))


def file_preferences(spark: SparkSession) -> DataFrame:
    rows = [(kind, cls, rank) for kind, order in K.FILE_PREFERENCE for rank, cls in enumerate(order)]
    return spark.createDataFrame(rows, "kind string, file_class string, type_rank int")


def input_kind(runner: Column, category: Column) -> Column:
    """Which file types a test asks for, and in which order: by its runner, else its category, else variants first."""
    return (
        F.when(F.coalesce(runner.isin(K.READS_ONLY_RUNNERS), F.lit(False)), "reads_only")
        .when(F.coalesce(F.lower(category).isin(K.ALIGNMENT_FIRST_CATEGORIES), F.lit(False)), "alignment_first").otherwise("default")
    )


def files_for_tests(files: DataFrame, requests: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Best file of the profile for each requested test (``requests``: profile_id, test_id, runner, category), or why there is none."""
    asked = requests.withColumn("kind", input_kind(F.col("runner"), F.col("category")))
    best = best_files(files, file_preferences(files.sparkSession), excluded)
    return asked.join(best, ["profile_id", "kind"], "left").select(
        "profile_id", "test_id", "kind", "file_id", "file_class", F.coalesce("reason", F.lit("No compatible files in profile")).alias("reason")
    )


def best_files(files: DataFrame, kinds: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Best input file per (profile, kind of test).

    ``files``: profile_id, file_id, path, registered (order), preferred. ``kinds``: kind, file_class, type_rank.
    """
    usable = files if excluded is None else files.join(excluded, "file_id", "left_anti")
    typed = usable.withColumn("file_class", N.file_class(F.col("path"))).join(F.broadcast(kinds), "file_class")
    best = first_rows(
        typed, ["profile_id", "kind"], ["type_rank", F.col("preferred").desc(), "registered", "file_id"]
    )
    name = F.upper("file_class")
    reason = F.when(F.col("preferred"), F.concat(F.lit("Preferred "), name, F.lit(" file"))).otherwise(
        F.concat(F.lit("Auto-selected "), name, F.lit(" (first available)"))
    )
    return best.select("profile_id", "kind", "file_id", "file_class", reason.alias("reason"))


def sibling_files(alignments: DataFrame, variant_files: DataFrame) -> DataFrame:
    """Variant file of the same sample for each alignment, by suffix rank."""
    name = F.lower(F.col("file_name"))
    rank = F.lit(None).cast("int")
    for suffix, place in reversed(K.SIBLING_SUFFIX_RANK):
        rank = F.when(name.endswith(f".{suffix}"), place).otherwise(rank)
    # the longest suffix decides: g.vcf.gz also ends with vcf.gz
    rank = F.when(name.endswith(".g.vcf.gz"), dict(K.SIBLING_SUFFIX_RANK)["g.vcf.gz"]).otherwise(rank)
    ranked = variant_files.withColumn("suffix_rank", rank).where(F.col("suffix_rank").isNotNull())
    best = first_rows(ranked, ["sample_name"], ["suffix_rank", "file_name"]).select(
        "sample_name", F.col("file_name").alias("variant_file"), "suffix_rank"
    )
    return alignments.join(best, "sample_name")


def detected_ancestry(files: DataFrame, reports: DataFrame) -> DataFrame:
    """The file's newest ancestry report, else the newest of a file with the same sample name.

    ``files``: file_id, sample_name. ``reports``: file_id, task_id, completed_at, population.
    """
    newest = first_rows(reports, ["file_id"], [F.col("completed_at").desc(), F.col("task_id").desc()])
    own = newest.select("file_id", F.col("population").alias("_own"))
    by_name = first_rows(
        newest.join(files, "file_id"), ["sample_name"], [F.col("completed_at").desc(), F.col("task_id").desc()]
    ).select("sample_name", F.col("population").alias("_shared"))
    return files.join(own, "file_id", "left").join(by_name, "sample_name", "left").select(
        "file_id", F.coalesce("_own", "_shared").alias("population"),
        F.when(F.col("_own").isNotNull(), "own").when(F.col("_shared").isNotNull(), "sibling").otherwise("none").alias("origin"),
    )


def enrich_tests(tests: DataFrame, enrichment: DataFrame, coverage: DataFrame) -> DataFrame:
    return tests.join(enrichment, "pgs_id", "left").join(coverage, "pgs_id", "left").withColumn(
        "populations", F.coalesce("populations", F.lit(""))
    )


def with_contract(results: DataFrame) -> DataFrame:
    """Status and headline are always present."""
    return results.withColumn("status", F.coalesce("status", F.lit("passed"))).withColumn(
        "headline", F.coalesce("headline", F.lit(""))
    )


def report_index(reports: DataFrame) -> DataFrame:
    """Results per file and category with the distinct tests of the pair."""
    per = reports.groupBy("file_id", "category", "test_id").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy("file_id", "category").agg(
        F.sum("_n").alias("n_results"), F.count(F.lit(1)).alias("n_tests"),
        F.array_join(F.array_sort(F.collect_list("test_id")), ",").alias("tests"),
    )


# ---- texts -----------------------------------------------------------------------------------------------------------


def capped(text: Column, n: int, mark: str = "") -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(mark))).otherwise(text)


def report_text(report_name: Column, category: Column, result: Column, interpretation: Column) -> Column:
    """Concise text of one report; null parts vanish, at most five variants are spelled out."""

    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {label}: "), value.cast("string")))

    variants = result["variants"]
    shown = F.transform(
        F.slice(variants, 1, 5),
        lambda v: F.concat(F.lit("  Variant: "), F.coalesce(v["name"], v["variant"], F.lit("?")), F.lit(" -> "), F.coalesce(v["genotype"], F.lit("?"))),
    )
    more = F.when(F.size(variants) > 5, F.concat(F.lit("  ... and "), (F.size(variants) - 5).cast("string"), F.lit(" more variants")))
    has_text = F.coalesce(interpretation, F.lit("")) != ""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("**"), F.coalesce(report_name, F.lit("?")), F.lit("** ("), F.coalesce(category, F.lit("?")), F.lit(")")),
        line("Headline", result["headline"]), line("Percentile", result["percentile"]), line("Match rate", result["match_rate"]),
        line("Status", result["status"]),
        F.when(has_text, line("Interpretation", capped(interpretation, 500, "...")))
        .otherwise(line("Output", F.left(result["output"], F.lit(300)))),
        F.when(F.coalesce(result["pgs_id"], F.lit("")) != "", F.concat(F.lit("  PGS ID: "), result["pgs_id"], F.lit(", Trait: "), F.coalesce(result["trait"], F.lit("?")))),
        F.when(F.coalesce(result["matched_variants"], F.lit(0)) > 0, F.concat(
            F.lit("  Variants: "), result["matched_variants"].cast("string"), F.lit("/"), F.coalesce(result["total_variants"].cast("string"), F.lit("?")))),
        F.array_join(shown, "\n"), more,
    )


def score_summary(pgs_id: Column, trait: Column, raw: Column, matched: Column, total: Column, percentile: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Polygenic Score: "), trait, F.lit(" ("), pgs_id, F.lit(")")),
        F.concat(F.lit("Raw score: "), F.coalesce(raw.cast("string"), F.lit("N/A"))),
        F.concat(F.lit("Matched variants: "), F.format_number(matched, 0), F.lit(" / "), F.format_number(total, 0)),
        F.when(percentile.isNotNull(), F.concat(F.lit("Percentile: "), F.format_number(percentile, 1), F.lit("%")))
        .otherwise("Percentile: N/A (no reference panel stats)"),
    )


def lookup_summary(answers: DataFrame, by: list[str], title: Column, name: Column, variant: Column) -> DataFrame:
    """Text of a variant test: a line per answer, in order of the lines. A test lists a handful of variants."""
    line = F.concat(
        F.lit("  "), F.coalesce("gene", F.lit("")), F.lit(" "), name, F.lit(" ("), variant, F.lit("): "), F.coalesce("genotype", F.lit("not found")),
        F.lit(" [via "), "source", F.lit("]"),
    )
    rolled = answers.groupBy(*by).agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    return rolled.select(*by, F.concat(F.lit("Variant lookup for: "), title, F.lit("\n"), F.array_join("_lines", "\n")).alias("summary"))


def screen_summary(requests: DataFrame, panel_genes: DataFrame, findings: DataFrame) -> DataFrame:
    """Text of a requested (sample, panel): genes screened and a line per finding, in order of the lines."""
    line = F.concat(
        F.lit("  "), "gene", F.lit(": "), "chrom", F.lit(":"), F.col("pos").cast("string"), F.lit(" "), "ref", F.lit(">"), "alt", F.lit(" ["), "clnsig",
        F.lit("] GT="), "gt",
    )
    genes = panel_genes.groupBy("panel").agg(F.countDistinct("gene").alias("_genes"))
    found = findings.groupBy("sample_id", "panel").agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    n = F.size("_lines")
    none = "No pathogenic/likely pathogenic variants found in screened genes.\nNote: VCF must have ClinVar annotations for this screen to work. Run with an annotated VCF for complete results."
    text = F.when(n > 0, F.concat(F.lit("FINDINGS: "), n.cast("string"), F.lit(" pathogenic/likely pathogenic variant(s) found!\n"), F.array_join("_lines", "\n"))).otherwise(none)
    return requests.join(genes, "panel", "left").join(found, ["sample_id", "panel"], "left").select(
        "sample_id", "panel",
        F.concat(F.lit("Monogenic Screening: "), "panel", F.lit(" Panel\nGenes screened: "), F.coalesce("_genes", F.lit(0)).cast("string"), F.lit("\n"), text).alias("summary"),
    )


def provenance(
    path: Column, pgs_id: Column, build: Column, original_build: Column, lifted: Column, method: Column, harmonised: Column | None = None,
    population: Column | None = None,
) -> Column:
    """How a score came about. ``build``: that of the positions used; ``harmonised``: whether they are the catalogue's harmonised ones;
    ``population``: the reference population, if another than the default."""
    kind = N.input_label(path)
    harmonised = F.lit(False) if harmonised is None else F.coalesce(harmonised, F.lit(False))
    positions = F.coalesce(build, F.lit("GRCh38"))
    return F.named_struct(
        F.lit("scoring_tool"), F.lit(K.SCORING_TOOL), F.lit("scoring_method"), method, F.lit("input_file"), N.base_name(path), F.lit("input_type"), kind,
        F.lit("genome_build"), positions, F.lit("scoring_file_build"), positions, F.lit("original_build"), F.coalesce(original_build, F.lit("unknown")),
        F.lit("used_harmonized_positions"), harmonised, F.lit("liftover"), F.when(lifted != "", lifted), F.lit("score_id"), pgs_id,
        F.lit("reference_population"), F.lit(K.REFERENCE_POPULATION) if population is None else F.coalesce(population, F.lit(K.REFERENCE_POPULATION)),
        F.lit("reference_panel"), F.lit(K.REFERENCE_PANEL), F.lit("score_url"), F.concat(F.lit("https://www.pgscatalog.org/score/"), pgs_id, F.lit("/")),
        F.lit("normalization"), F.when(kind == "gVCF", "block expansion at target positions").when(kind == "VCF", "standard VCF")
        .when(kind.isin("BAM", "CRAM"), "variant calling").otherwise("none"),
    )


# ---- catalogue -------------------------------------------------------------------------------------------------------


def flatten_catalogue(docs: DataFrame) -> DataFrame:
    """Catalogue documents -> citation, DOI, builds, ancestry text (largest share first)."""
    pub, gwas = F.col("publication"), F.col("ancestry_distribution.gwas")
    author = F.coalesce(pub["firstauthor"], F.lit(""))
    year = F.left(F.coalesce(pub["date_publication"], F.lit("")), F.lit(4))
    ftp = F.col("ftp_harmonized_scoring_files")
    builds = F.filter(
        F.array(*[F.when(F.size(F.coalesce(ftp[b], F.create_map())) > 0, b) for b in ("GRCh37", "GRCh38")]), lambda b: b.isNotNull()
    )
    shares = F.array_sort(F.transform(F.map_entries(gwas["dist"]), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    ancestry = F.array_join(F.transform(shares, lambda e: F.concat(e["k"], F.lit(": "), (-e["n"]).cast("string"), F.lit("%"))), ", ")
    return docs.select(
        F.col("id").alias("pgs_id"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("trait_reported", F.lit("")).alias("trait"),
        F.col("variants_number").alias("variants"),
        F.when(author != "", F.concat(author, F.lit(" et al., "), F.coalesce(pub["journal"], F.lit("")), F.lit(" ("), year, F.lit(")"))).otherwise("").alias("citation"),
        F.when(F.coalesce(pub["doi"], F.lit("")) != "", F.concat(F.lit("https://doi.org/"), pub["doi"])).alias("doi"),
        F.coalesce("original_genome_build", F.get(builds, F.lit(0)), F.lit("NR")).alias("genome_build"),
        F.array_join(builds, ",").alias("builds_available"), F.coalesce("weight_type", F.lit("NR")).alias("weight_type"),
        F.coalesce(pub["title"], F.lit("")).alias("pub_title"), pub["PMID"].alias("pub_pmid"), F.coalesce("method_name", F.lit("")).alias("method_name"),
        F.coalesce(F.get("trait_efo", F.lit(0))["description"], F.lit("")).alias("trait_description"),
        F.when(F.coalesce(F.size(shares), F.lit(0)) > 0, ancestry).otherwise("Not reported").alias("gwas_ancestry"), gwas["count"].alias("gwas_n"),
    )


def enrichment_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Notes on changed variant count or trait; only where both sides have a value."""
    o = old.select("pgs_id", F.col("variants").alias("_v"), F.col("trait").alias("_t"))
    j = new.join(o, "pgs_id")
    n_changed = (F.coalesce("_v", F.lit(0)) != 0) & (F.coalesce("variants", F.lit(0)) != 0) & (F.col("_v") != F.col("variants"))
    t_changed = (F.coalesce("_t", F.lit("")) != "") & (F.coalesce("trait", F.lit("")) != "") & (F.col("_t") != F.col("trait"))
    notes = F.concat_ws(
        "; ",
        F.when(n_changed, F.concat(F.lit("Variant count changed: "), F.col("_v").cast("string"), F.lit(" -> "), F.col("variants").cast("string"))),
        F.when(t_changed, F.concat(F.lit("Trait name changed: '"), F.col("_t"), F.lit("' -> '"), F.col("trait"), F.lit("'"))),
    )
    return j.select("pgs_id", notes.alias("notes")).where(F.col("notes") != "")


def merge_hits(*sources: DataFrame) -> DataFrame:
    """Hits of several searches; the first source that has an id wins."""
    ranked = None
    for i, s in enumerate(sources):
        part = s.select("pgs_id", "name", "trait").withColumn("source_rank", F.lit(i))
        ranked = part if ranked is None else ranked.unionByName(part)
    return first_rows(ranked, ["pgs_id"], ["source_rank", "name", "trait"])


def search_catalogue(catalogue: DataFrame, traits: DataFrame, text: str, limit: int) -> DataFrame:
    """A score id finds that score alone; other texts of two characters or more find score hits before trait hits. ``traits``: trait_label,
    pgs_id."""
    wanted = text.strip().lower()
    if len(wanted) < 2:
        return merge_hits(catalogue.where(F.lit(False)))
    if re.fullmatch(r"pgs\d{6,}", wanted):
        return merge_hits(catalogue.where(F.lower("pgs_id") == wanted)).limit(limit)
    hits = catalogue.where(F.lower("pgs_id").contains(wanted) | F.lower("name").contains(wanted))
    by_trait = catalogue.join(traits.where(F.lower("trait_label").contains(wanted)).select("pgs_id").distinct(), "pgs_id", "left_semi")
    return merge_hits(hits, by_trait).orderBy("source_rank", "pgs_id").limit(limit)


# ---- batches ---------------------------------------------------------------------------------------------------------


def pack_batches(blocks: DataFrame, owner: str, order: str, length: str, budget: int) -> DataFrame:
    """Number the batches in which an owner's blocks travel: a batch closes before the block that would exceed ``budget``.

    Each block knows, from running sums, which block would open the next batch if it opened one. The real openers are the
    blocks reached from the first one; reach doubles every round, so a huge owner costs log(batches) joins, not one task.
    ``order`` is an integer that rises along the owner's blocks.
    """
    piece_of_order = whole(F.col(order), 1024)
    summed = running_total(blocks.select(owner, order, length), [owner], piece_of_order, [order], F.col(length), "_upto")
    summed = cut_lineage(running_total(summed, [owner], piece_of_order, [order], F.lit(1), "_seq"))
    counts = summed.groupBy(owner).agg(F.count(F.lit(1)).alias("_n"))
    # block ends and the limits asked for meet on one number line, cut into budget-wide pieces
    ends = summed.select(owner, F.col("_upto").alias("_x"), F.lit(0).alias("_q"), F.col("_seq").alias("_at"))
    asked = summed.select(owner, (F.col("_upto") - F.col(length) + budget).alias("_x"), F.lit(1).alias("_q"), F.col("_seq").alias("_at"))
    line = ends.unionByName(asked).withColumn("_piece", whole(F.col("_x"), budget))
    end_seq = F.when(F.col("_q") == 0, F.col("_at"))
    inside = Window.partitionBy(owner, "_piece").orderBy("_x", "_q", "_at").rowsBetween(1, Window.unboundedFollowing)
    placed = line.withColumn("_next", F.first(end_seq, ignorenulls=True).over(inside)).where("_q = 1")
    pieces = line.groupBy(owner, "_piece").agg(F.min(end_seq).alias("_first"))
    later = Window.partitionBy(owner).orderBy("_piece").rowsBetween(1, Window.unboundedFollowing)
    following = pieces.select(owner, "_piece", F.first("_first", ignorenulls=True).over(later).alias("_later"))
    over = F.coalesce("_next", "_later")
    # a block over the budget travels alone: the one after it opens the next batch
    jumps = cut_lineage(
        placed.join(following, [owner, "_piece"]).join(counts, owner)
        .select(owner, F.col("_at").alias("_a"), F.greatest(over, F.when(over.isNotNull(), F.col("_at") + 1)).alias("_b"), "_n")
        .where("_b <= _n").select(owner, "_a", "_b")
    )
    openers = cut_lineage(counts.select(owner, F.lit(1).cast("bigint").alias("_a")))
    while True:
        reached = openers.join(jumps, [owner, "_a"]).select(owner, F.col("_b").alias("_a"))
        fresh = cut_lineage(reached.join(openers, [owner, "_a"], "left_anti"))
        if fresh.isEmpty():
            break
        openers = cut_lineage(openers.unionByName(fresh))
        onward = jumps.select(owner, F.col("_a").alias("_b"), F.col("_b").alias("_c"))
        jumps = cut_lineage(jumps.join(onward, [owner, "_b"]).select(owner, "_a", F.col("_c").alias("_b")))
    marked = summed.join(openers.select(owner, F.col("_a").alias("_seq"), F.lit(1).alias("_open")), [owner, "_seq"], "left")
    return running_total(
        marked, [owner], piece_of_order, [order], F.coalesce("_open", F.lit(0)), "batch_no"
    ).select(owner, order, length, "batch_no")
