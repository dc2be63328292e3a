"""Variant lookup: rsID, then position with allele check, then reference block, then inferred reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import genotype as G
from ..session import written
from .degrees import PARTS_FOR_OUTPUT
from .intervals import interval_join
from .picks import first_rows
from .pileup import genotype_sites

#: Requests that a part of a lookup holds, with what was found for them.
REQUESTS_OF_A_PART = 1 << 17
#: Order of records of which it is not known where they stood in their file.
SPELLING_ORDER = ("pos", "ref", "alt_csv", "gt")


def file_order(records: DataFrame) -> list[str]:
    """The columns that put a sample's records in file order: their line, or else their spelling."""
    return ["line_no"] if "line_no" in records.columns else list(SPELLING_ORDER)


def evidence_at_sites(sites: DataFrame, records: DataFrame) -> DataFrame:
    """Per (sample, asked position): the distinct called records there, and whether a reference block covers it.

    Only the asked positions are looked at: called records are kept by a semi join, blocks are expanded over the few
    sites, never over the requests.
    """
    places = sites.select("chrom", "pos").distinct()
    block = G.is_ref_block(F.col("alts"), F.col("gt"))
    called = records.where(~block).join(places, ["chrom", "pos"], "left_semi").select(
        "sample_id", "chrom", "pos", F.struct("ref", "alt_csv", "gt").alias("_rec")
    )
    covering = records.where(block).select(
        "sample_id", "chrom", F.col("pos").alias("_start"), G.block_end(F.col("info_end"), F.col("pos")).alias("_end")
    )
    covered = interval_join(places, covering, "pos", "_start", "_end", salt=4).select("sample_id", "chrom", "pos")
    both = called.withColumn("_blocked", F.lit(False)).unionByName(
        covered.withColumn("_blocked", F.lit(True)), allowMissingColumns=True
    )
    # distinct allele spellings of one sample at one position: a handful
    return both.groupBy("sample_id", "chrom", "pos").agg(
        F.array_sort(F.collect_set("_rec")).alias("_recs"), F.bool_or("_blocked").alias("_blocked")
    )


def first_by_id(records: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    return first_rows(records.where(F.col("id") != "."), ["sample_id", "id"], list(order or file_order(records)))


def look_up(wanted: DataFrame, records: DataFrame, order: Sequence[str] | None = None, listed: DataFrame | None = None, on: Sequence[str] = ("test_no",)) -> DataFrame:
    """Best answer per wanted row.

    ``wanted``: request keys plus sample_id, rsid (null: not callable from short variants), chrom, pos, ref, alt (null
    when no position is known). ``records``: sample_id, chrom, pos, id, ref, alt_csv, alts, gt, info_end.

    With ``listed`` the wanted rows are given in two parts: ``wanted`` holds requests (sample_id, ``on``) and ``listed`` the rows that each
    ``on`` stands for (a test and its handful of variants). Requests then meet what was found for them before they become one row per variant,
    so the many rows of which nothing was found are never shuffled.
    """
    if listed is not None:
        return _answers(_listed_evidence(wanted, records, order, listed, list(on)), [*wanted.columns, *[c for c in listed.columns if c not in on]])
    by_id = first_by_id(
        records.join(wanted.select(F.col("rsid").alias("id")).distinct(), "id", "left_semi"), order
    ).select("sample_id", F.col("id").alias("rsid"), F.struct("chrom", "pos", "ref", "alt_csv", "gt").alias("_id"))
    sites = wanted.where(F.col("pos").isNotNull())
    evidence = evidence_at_sites(sites, records)
    joined = wanted.join(by_id, ["sample_id", "rsid"], "left").join(evidence, ["sample_id", "chrom", "pos"], "left")
    return _answers(joined, wanted.columns)


def _listed_evidence(requests: DataFrame, records: DataFrame, order: Sequence[str] | None, listed: DataFrame, on: list[str]) -> DataFrame:
    """Requests times their listed rows, with ``_id``, ``_recs`` and ``_blocked`` as the joins of ``look_up`` give them."""
    first = list(order or file_order(records))
    told = ["chrom", "pos", "ref", "alt_csv", "gt"]
    block = G.is_ref_block(F.col("alts"), F.col("gt"))
    # a record found both by id and by place is one element of the set
    record = F.struct(*first, *[c for c in told if c not in first], "id", block.alias("blocked")).alias("_found")
    asked = listed.where(F.col("rsid").isNotNull())
    ids = asked.select(*on, F.col("rsid").alias("id")).distinct()
    places = asked.where(F.col("pos").isNotNull()).select(*on, "chrom", "pos").distinct()
    by_id = records.where(F.col("id") != ".").join(ids, "id").select("sample_id", *on, record)
    called = records.where(~block).join(places, ["chrom", "pos"]).select("sample_id", *on, record)
    covering = records.where(block).select(
        "sample_id", "chrom", F.col("pos").alias("_start"), G.block_end(F.col("info_end"), F.col("pos")).alias("_end")
    )
    covered = interval_join(places, covering, "pos", "_start", "_end", salt=4).select("sample_id", *on, F.struct("chrom", "pos").alias("_covered"))
    found = by_id.unionByName(called).unionByName(covered, allowMissingColumns=True)
    # what one sample has at the places and ids of one test: a handful. A request is one more row of what it asks for: all are shuffled
    # once, to the listed rows, and what no request asks for goes there
    kinds = ("_found", "_covered")
    rest = [c for c in requests.columns if c not in ("sample_id", *on)]
    requests = written(requests, "requests")
    # packed rows say little of what their sets and texts take: Spark would merge the parts by their bytes
    parts = max(PARTS_FOR_OUTPUT * int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-requests.count() // REQUESTS_OF_A_PART))
    asks = requests.select("sample_id", *on, F.struct(F.lit(True).alias("_asked"), *rest).alias("_request"))
    keyed = F.col("sample_id").isNotNull()
    for c in on:
        keyed = keyed & F.col(c).isNotNull()
    met = found.where(keyed).unionByName(asks, allowMissingColumns=True).repartition(parts, *on).groupBy("sample_id", *on)
    met = met.agg(F.collect_list("_request").alias("_requests"), *[F.collect_set(c).alias(c) for c in kinds]).where(F.size("_requests") > 0)
    each = met.withColumn("_request", F.explode("_requests")).select("sample_id", *on, *[F.col(f"_request.{c}").alias(c) for c in rest], *kinds)
    joined = each.select(*requests.columns, *kinds).join(listed, on)

    def here(c):
        return (c["chrom"] == F.col("chrom")) & (c["pos"] == F.col("pos"))

    def alleles(r):
        return F.struct(*[r[c].alias(c) for c in ("ref", "alt_csv", "gt")])

    return joined.select(
        *[c for c in joined.columns if c not in kinds],
        F.array_min(F.filter("_found", lambda r: (r["id"] == F.col("rsid")) & (r["id"] != "."))).alias("_id"),
        F.array_sort(F.transform(F.filter("_found", lambda r: ~r["blocked"] & here(r)), alleles)).alias("_recs"),
        F.exists("_covered", here).alias("_blocked"),
    )


def _answers(joined: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The answer of every wanted row (its ``columns``) from the record of its id, those at its position and whether a block covers it."""
    ref, alt = F.upper("ref"), F.upper("alt")
    exact = F.get(
        F.filter("_recs", lambda r: (F.upper(r["ref"]) == ref) & F.array_contains(F.split(F.upper(r["alt_csv"]), ","), alt)),
        F.lit(0),
    )
    callable_ = F.col("rsid").isNotNull()
    answered = joined.withColumns({
        "_exact": F.when(callable_, exact), "_any": F.when(callable_, F.get("_recs", F.lit(0))),
    })
    has_id, has_exact, has_any = F.col("_id").isNotNull(), F.col("_exact").isNotNull(), F.col("_any").isNotNull()
    placed = F.col("pos").isNotNull()
    blocked = callable_ & F.coalesce("_blocked", F.lit(False))
    record = F.coalesce("_exact", "_any")

    def choose(by_identity, by_record, otherwise):
        return F.when(has_id, by_identity).when(record.isNotNull(), by_record).otherwise(otherwise)

    source = (
        F.when(has_id, "rsID").when(has_any, "position").when(blocked, "gvcf_refblock").when(~callable_, "cnv_only")
        .when(placed, "position-inferred").otherwise("none")
    )
    match = F.when(has_id, "rsid").when(has_exact, "exact").when(has_any, "locus_mismatch").when(blocked, "ref_block")
    keep = [c for c in columns if c not in ("chrom", "pos", "ref", "alt")]
    return answered.select(
        *keep, source.alias("source"), match.alias("match_type"), (has_id | has_any | blocked).alias("found"),
        F.when(has_id, F.col("_id.chrom")).otherwise(F.col("chrom")).alias("chrom"),
        F.when(has_id, F.col("_id.pos")).otherwise(F.col("pos")).alias("pos"),
        choose(F.col("_id.ref"), record["ref"], F.col("ref")).alias("ref"),
        choose(F.col("_id.alt_csv"), record["alt_csv"], F.col("alt")).alias("alt"),
        choose(F.col("_id.gt"), record["gt"], F.when(callable_ & placed, "0/0")).alias("genotype"),
        F.col("ref").alias("expected_ref"), F.col("alt").alias("expected_alt"),
    )


def batch_genotypes(wanted: DataFrame, records: DataFrame, order: Sequence[str] | None = None, listed: DataFrame | None = None, on: Sequence[str] = ("test_no",)) -> DataFrame:
    """Genotype per wanted rsID in one pass: by id, else by position with the alleles checked, else a reference block,
    else inferred reference. Calls without an id are found by their position. ``listed`` as in ``look_up``."""
    return look_up(wanted, records, order, listed, on).drop("found", "expected_ref", "expected_alt")


def genotypes_by_position(regions: DataFrame, records: DataFrame) -> DataFrame:
    """Genotype at each asked position; the last record of a position in its file wins (without ``line_no``: the last by spelling)."""
    last = first_rows(
        records.join(regions.select("sample_id", "chrom", "pos").distinct(), ["sample_id", "chrom", "pos"], "left_semi"),
        ["sample_id", "chrom", "pos"], [F.col(c).desc() for c in file_order(records)],
    )
    return last.select("sample_id", "chrom", "pos", "gt")


def lookup_rollup(answers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, status and headline of one test of one sample. A test lists a handful of variants."""
    resolved = F.col("source").isin("rsID", "position", "position-inferred", "gvcf_refblock")
    mismatch = F.coalesce(F.col("match_type") == "locus_mismatch", F.lit(False))
    alt_call = F.col("found") & ~mismatch & G.carries_alt(F.col("genotype"))
    rolled = answers.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_variants"),
        F.count_if(resolved).alias("n_resolved"),
        F.count_if(mismatch).alias("n_mismatch"),
        F.count_if(F.coalesce(alt_call, F.lit(False))).alias("n_alt"),
        F.count_if(F.col("source") == "none").alias("n_unresolvable"),
        F.count_if(F.col("source") == "cnv_only").alias("n_cnv"),
        F.array_sort(F.collect_list(F.when(alt_call, F.concat("gene", F.lit(" "), F.col("rsid"), F.lit("="), F.col("genotype"))))).alias("_calls"),
    )
    failed = (F.col("n_resolved") == 0) & (F.col("n_cnv") == 0)
    cnv = (F.col("n_resolved") == 0) & (F.col("n_cnv") > 0)
    unclear = (F.col("n_mismatch") > 0) & (F.col("n_alt") == 0)
    status = F.when(failed, "failed").when(cnv | unclear, "warning").otherwise("passed")
    shown = F.array_join(F.slice("_calls", 1, 3), ", ")
    headline = (
        F.when(failed, F.concat(F.lit("No data: "), F.col("n_variants").cast("string"), F.lit(" variant(s) unresolvable")))
        .when(cnv, F.lit("Requires a dedicated assay"))
        .when(unclear, F.concat(F.lit("Inconclusive: "), F.col("n_mismatch").cast("string"), F.lit(" locus-only match(es)")))
        .when(F.col("n_alt") == 0, F.lit("All ref/ref (no alt calls)"))
        .otherwise(F.concat(F.col("n_alt").cast("string"), F.lit("/"), F.col("n_variants").cast("string"), F.lit(" alt calls: "), shown))
    )
    return rolled.withColumn("status", status).withColumn("headline", headline).drop("_calls")


def lookup_from_reads(wanted: DataFrame, reads: DataFrame, reference_bases: DataFrame | None = None) -> DataFrame:
    """Answer per wanted row from a pileup of its site (``wanted`` as in look_up, alleles known where a position is): source, found,
    genotype, dosage, depth. A row without rsID is left to a dedicated assay, one without position has no data."""
    placed = F.col("rsid").isNotNull() & F.col("pos").isNotNull()
    sites = wanted.where(placed).select("chrom", "pos", "ref", "alt").distinct()
    calls = genotype_sites(reads, sites, reference_bases).select("sample_id", "chrom", "pos", "ref", "alt", "dosage", "depth", "genotype", "strand_flip")
    source = F.when(F.col("rsid").isNull(), "cnv_only").when(F.col("pos").isNull(), "none").when(F.length("ref") != F.length("alt"), "pileup_indel").otherwise("pileup")
    return wanted.join(calls, ["sample_id", "chrom", "pos", "ref", "alt"], "left").withColumns({
        "source": source, "found": F.col("dosage").isNotNull(), "depth": F.when(placed, F.coalesce("depth", F.lit(0))),
        "genotype": F.when(placed, F.coalesce("genotype", F.lit("./."))), "strand_flip": F.coalesce("strand_flip", F.lit(False)),
    })


def reads_rollup(answers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, status and headline of one test of one sample from reads (``answers``: gene, rsid, source, dosage, depth, genotype and, of
    pharmacogenes, star_allele). Two star alleles of one gene, both with two copies, cannot be: such a test is a caller's artefact."""
    resolved = ~F.col("source").isin("none", "cnv_only")
    alt = F.coalesce(resolved & (F.col("dosage") > 0), F.lit(False))
    call = F.struct("gene", "rsid", F.concat("gene", F.lit("="), "genotype").alias("text"))
    rolled = answers.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_variants"), F.count_if(resolved).alias("n_resolved"), F.count_if(alt).alias("n_alt"),
        F.count_if(F.col("source") == "cnv_only").alias("n_cnv"), F.count_if(resolved & (F.col("depth") < K.MIN_DEPTH)).alias("n_low_coverage"),
        F.min(F.when(F.col("source") == "cnv_only", F.coalesce("gene", F.lit("Structural variant")))).alias("_cnv_gene"),
        F.array_sort(F.collect_list(F.when(alt, call))).alias("_calls"),  # a test lists a handful of variants
    )
    stars = answers.where(F.col("star_allele").isNotNull()).select(*by, "gene", F.col("star_allele").alias("allele"), "dosage")
    clash = impossible_diplotypes(stars, [*by, "gene"]).groupBy(*by).agg(F.min(F.struct("gene", "alleles")).alias("_clash"))
    joined = rolled.join(clash, list(by), "left")
    impossible, none = F.col("_clash").isNotNull(), F.col("n_resolved") == 0
    shown = F.array_join(F.transform(F.slice("_calls", 1, 3), lambda c: c["text"]), ", ")
    headline = (
        F.when(impossible, F.concat(F.col("_clash.gene"), F.lit(": impossible call detected (hom for "), F.array_join("_clash.alleles", ", "), F.lit(")")))
        .when(none & (F.col("n_cnv") == 0), F.concat(F.lit("No data: "), F.col("n_variants").cast("string"), F.lit(" variant(s) unresolvable")))
        .when(none, F.concat("_cnv_gene", F.lit(": requires specialized assay")))
        .when(F.col("n_alt") == 0, "All ref/ref (no alt calls)")
        .otherwise(F.concat(F.col("n_alt").cast("string"), F.lit("/"), F.col("n_resolved").cast("string"), F.lit(" alt calls: "), shown))
    )
    status = F.when(impossible, "warning").when(none & (F.col("n_cnv") == 0), "failed").when(none, "warning").otherwise("passed")
    return joined.select(*by, "n_variants", "n_resolved", "n_alt", "n_low_coverage", status.alias("status"), headline.alias("headline"))


def impossible_diplotypes(doses: DataFrame, by: Sequence[str]) -> DataFrame:
    """Genes in which more than one star allele has two copies. A gene lists a bounded set of star alleles."""
    return doses.where(F.col("dosage") == 2).groupBy(*by).agg(
        F.array_sort(F.collect_set("allele")).alias("alleles")
    ).where(F.size("alleles") > 1)
