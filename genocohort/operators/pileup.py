"""Genotypes from aligned reads: reads meet the sorted sites of the blocks they touch, the CIGAR is folded per read, counts are grouped.

Sites are folded to one sorted list a block of the chromosome. A read is shuffled once, to its block (two, where it crosses a border),
and takes the part of the list that it covers: no pair of a read and a site outside it is ever made. SNVs and indels branch
after that, inside one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import clinical as C
from ..functions import genotype as G
from ..session import written
from .picks import never_broadcast

# a deep amplicon puts very many reads on one block; sites are few, so repeating them is cheap
SALT = 8
#: Blocks of 1024 bases, several times as long as a short read; a list longer than this goes on in another row.
BLOCK_BITS = 10
SITES_OF_A_LIST = 4096
DROP_SNV = K.FLAG_UNMAPPED | K.FLAG_SECONDARY | K.FLAG_QC_FAIL | K.FLAG_DUPLICATE
DROP_INDEL = DROP_SNV | K.FLAG_SUPPLEMENTARY


def usable_reads(reads: DataFrame, indel: bool = False) -> DataFrame:
    """Mapping quality and flags; the base quality is judged at the site."""
    return reads.where(
        (F.col("mapq") >= K.MIN_MAPQ) & (F.col("flag").bitwiseAND(DROP_INDEL if indel else DROP_SNV) == 0)
    )


def read_spans(reads: DataFrame, salt: int = 1) -> DataFrame:
    """Reads with ``ops``, ``end_pos`` and ``_salt``. The columns are generated: what is asked of them later stays above, and does not
    become part of a join below, where a read would be hashed and its CIGAR taken apart once more for every place that names them."""
    plain = [f.name for f in reads.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    parsed = F.struct(G.parse_cigar(F.col("cigar")).alias("ops"), F.pmod(F.xxhash64(*plain), F.lit(salt)).cast("int").alias("_salt"))
    # by a lambda, as Spark computes it then by the rules for nulls: a compiled element_at may have made a CIGAR out of a null
    known = reads.where(F.size(F.filter(F.array("cigar"), lambda c: F.length(c) >= 0)) > 0)
    spans = known.withColumn("_read", F.explode(F.array(parsed))).select("*", "_read.*").drop("_read")
    return spans.withColumn("end_pos", F.explode(F.array(F.col("start_pos") + G.reference_span(F.col("ops")) - 1)))


def site_lists(sites: DataFrame, salt: int) -> DataFrame:
    """(chrom, _block, _salt, _low, _high, _sites): the sites of each block in order, repeated for every salt."""
    placed = sites.withColumnRenamed("pos", "site_pos").withColumn("_block", F.call_function("shiftright", F.col("site_pos").cast("bigint"), F.lit(BLOCK_BITS)))
    kept = [c for c in placed.columns if c not in ("chrom", "_block", "site_pos")]
    sizes = placed.groupBy("chrom", "_block").agg(F.ceil(F.count(F.lit(1)) / SITES_OF_A_LIST).alias("_parts"))
    part = F.pmod(F.xxhash64("site_pos", *kept), F.col("_parts"))
    listed = placed.join(never_broadcast(sizes), ["chrom", "_block"]).groupBy("chrom", "_block", part.alias("_part")).agg(
        F.min("site_pos").alias("_low"), F.max("site_pos").alias("_high"), F.sort_array(F.collect_list(F.struct("site_pos", *kept))).alias("_sites")
    )
    return listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))).drop("_part")


def reads_in_blocks(reads: DataFrame, sites: DataFrame, salt: int = SALT) -> DataFrame:
    """Every read with the site lists of the blocks it touches, as far as a list reaches into the read."""
    block = lambda c: F.call_function("shiftright", F.col(c).cast("bigint"), F.lit(BLOCK_BITS))
    dealt = read_spans(reads, salt).where(F.col("end_pos") >= F.col("start_pos")).withColumn("_block", F.explode(F.sequence(block("start_pos"), block("end_pos"))))
    met = dealt.join(never_broadcast(site_lists(sites, salt)), ["chrom", "_block", "_salt"])
    return met.where((F.col("_low") <= F.col("end_pos")) & (F.col("_high") >= F.col("start_pos"))).drop("_block", "_salt", "_low", "_high")


def reads_over_sites(reads: DataFrame, sites: DataFrame, salt: int = SALT) -> DataFrame:
    """Every (site, read) with the site inside the read's reference span. ``sites``: chrom, pos and what they carry."""
    covered = F.filter("_sites", lambda s: s["site_pos"].between(F.col("start_pos"), F.col("end_pos")))
    met = reads_in_blocks(reads, sites, salt).withColumn("_site", F.explode(covered)).drop("_sites")
    return met.select("*", "_site.*").drop("_site")


def walk(ops: Column, start: Column, site: Column) -> Column:
    """Fold a CIGAR up to the site.

    struct(i, r, q, hit, at, left, gap): ``hit`` is the index of the aligned block that holds the site (-1: none), ``at``
    the 0-based read offset of the site, ``left`` the aligned bases of that block after it, ``gap`` the length of a
    deletion that begins right after the site without an aligned block before it.
    """
    zero = F.struct(
        F.lit(0).alias("i"), start.cast("bigint").alias("r"), F.lit(0).alias("q"), F.lit(-1).alias("hit"),
        F.lit(-1).alias("at"), F.lit(-1).alias("left"), F.lit(0).alias("gap"),
    )

    def step(s: Column, o: Column) -> Column:
        aligned = o["op"].isin("M", "=", "X")
        here = (s["hit"] < 0) & aligned & (s["r"] <= site) & (site < s["r"] + o["n"])
        early = (s["hit"] < 0) & (o["op"] == "D") & (s["r"] == site + 1) & (s["gap"] == 0)
        return F.struct(
            (s["i"] + 1).alias("i"),
            (s["r"] + F.when(aligned | o["op"].isin("D", "N"), o["n"]).otherwise(0)).alias("r"),
            (s["q"] + F.when(aligned | o["op"].isin("I", "S"), o["n"]).otherwise(0)).alias("q"),
            F.when(here, s["i"]).otherwise(s["hit"]).alias("hit"),
            F.when(here, (s["q"] + site - s["r"]).cast("int")).otherwise(s["at"]).alias("at"),
            F.when(here, (s["r"] + o["n"] - site - 1).cast("int")).otherwise(s["left"]).alias("left"),
            F.when(early, o["n"]).otherwise(s["gap"]).alias("gap"),
        )

    return F.aggregate(ops, zero, step)


def base_walk(ops: Column, start: Column, site: Column) -> Column:
    """The part of a walk that bases need: struct(left, q, at), ``at`` as above and ``left`` the bases still to go to the site."""
    zero = F.struct((site - start).cast("bigint").alias("left"), F.lit(0).alias("q"), F.lit(-1).alias("at"))

    def step(s: Column, o: Column) -> Column:
        aligned = o["op"].isin("M", "=", "X")
        here = (s["at"] < 0) & aligned & (s["left"] >= 0) & (s["left"] < o["n"])
        return F.struct(
            (s["left"] - F.when(aligned | o["op"].isin("D", "N"), o["n"]).otherwise(0)).alias("left"),
            (s["q"] + F.when(aligned | o["op"].isin("I", "S"), o["n"]).otherwise(0)).alias("q"),
            F.when(here, (s["q"] + s["left"]).cast("int")).otherwise(s["at"]).alias("at"),
        )

    return F.aggregate(ops, zero, step)


def walked(fold=walk) -> Column:
    """The walk as a generated column: filters on it then stay above the join instead of becoming part of its condition."""
    return F.explode(F.array(fold(F.col("ops"), F.col("start_pos"), F.col("site_pos"))))


def _with_base(over: DataFrame) -> DataFrame:
    offset = F.col("_w.at") + 1
    return over.withColumns({
        "base": F.upper(F.col("seq").substr(offset, F.lit(1))),
        "quality": F.ascii(F.col("quals").substr(offset, F.lit(1))) - 33,
        "is_reverse": F.col("flag").bitwiseAND(16) != 0,
    })


def _shows_base() -> Column:
    return (F.col("_w.at") >= 0) & (F.col("quality") >= K.MIN_BASEQ) & F.col("base").isin("A", "C", "G", "T")


def base_observations(reads: DataFrame, sites: DataFrame, salt: int = SALT) -> DataFrame:
    """One row per (site, read) that shows a base of sufficient quality at the site."""
    return _with_base(reads_over_sites(usable_reads(reads), sites, salt).withColumn("_w", walked(base_walk))).where(_shows_base())


def _base_sums() -> list[Column]:
    return [
        F.count_if((F.col("base") == b) & (F.col("is_reverse") if strand == "rev" else ~F.col("is_reverse"))).alias(f"{b}_{strand}") for b in "ACGT" for strand in ("fwd", "rev")
    ]


def base_counts(observed: DataFrame, by: Sequence[str]) -> DataFrame:
    """A/C/G/T counts by strand, and depth. Partial sums per input task keep a deep site small in the shuffle."""
    return observed.groupBy(*by).agg(F.count(F.lit(1)).alias("depth"), *_base_sums())


def _count_of(base: Column, strands: Sequence[str] = ("fwd", "rev")) -> Column:
    out = F.lit(0)
    for b in "ACGT":
        total = sum((F.col(f"{b}_{s}") for s in strands[1:]), F.col(f"{b}_{strands[0]}"))
        out = F.when(base == b, total).otherwise(out)
    return out


def call_snvs(counts: DataFrame, reference_bases: DataFrame | None = None) -> DataFrame:
    """Dosage, sanity, strand-flip and strand-bias marks per (sample, site); needs ref, alt and the base counts."""
    ref, alt = F.upper(F.col("ref").substr(1, 1)), F.upper(F.col("alt").substr(1, 1))
    c = counts
    if reference_bases is not None:
        bases = reference_bases.select("chrom", "pos", F.upper("base").alias("reference_base"))
        c = c.join(never_broadcast(bases), ["chrom", "pos"], "left")
    else:
        c = c.withColumn("reference_base", F.lit(None).cast("string"))
    c = c.withColumns({
        "_ref_n": _count_of(ref), "_alt_n": _count_of(alt),
        "_ref_c": _count_of(G.complement(ref)), "_alt_c": _count_of(G.complement(alt)),
        "_alt_fwd": _count_of(alt, ["fwd"]), "_alt_rev": _count_of(alt, ["rev"]),
    })
    deep = F.col("depth") >= K.MIN_DEPTH
    wrong = deep & (F.col("_alt_n") == F.col("depth")) & (ref != alt) & F.coalesce(F.col("reference_base") != ref, F.lit(False))
    flipped = (F.col("_ref_n") == 0) & (F.col("_alt_n") == 0) & ((F.col("_ref_c") > 0) | (F.col("_alt_c") > 0))
    alt_count = F.when(flipped, F.col("_alt_c")).otherwise(F.col("_alt_n"))
    dosage = F.when(wrong, 0).otherwise(C.snv_dosage(alt_count, F.col("depth")))
    return (
        c.withColumn("ref_sanity_failed", wrong)
        .withColumn("strand_flip", deep & ~wrong & flipped)
        .withColumn("alt_count", alt_count)
        .withColumn("dosage", dosage)
        .withColumn("genotype", C.dosage_text(F.col("dosage")))
        .withColumn("strand_bias", ~wrong & C.strand_biased(F.col("dosage"), F.col("depth"), F.col("_alt_fwd"), F.col("_alt_rev")))
        .drop("_ref_n", "_alt_n", "_ref_c", "_alt_c", "_alt_fwd", "_alt_rev")
    )


def _verdict() -> Column:
    """ref / alt / other for the indel of the row's site, null where the read says nothing."""
    w = F.col("_w")
    deletion = F.length("ref") > F.length("alt")
    size = F.abs(F.length("ref") - F.length("alt"))
    following = F.get("ops", w["hit"] + 1)
    ends_here = w["left"] == 0
    inserted = F.upper(F.col("alt").substr(F.length("ref") + 1, size))
    seen = F.upper(F.col("seq").substr(w["at"] + 2, size))
    by_deletion = (
        F.when(ends_here & following.isNull(), None)
        .when(ends_here & (following["op"] == "D"), F.when(following["n"] == size, "alt").otherwise("other"))
        .when(ends_here, "ref")
        .when(w["left"] >= size, "ref")
    )
    by_insertion = (
        F.when(ends_here & following.isNull(), None)
        .when(
            ends_here & (following["op"] == "I"),
            F.when((following["n"] == size) & (seen == inserted), "alt").otherwise("other"),
        )
        .otherwise("ref")
    )
    no_anchor = F.when(deletion & (w["gap"] > 0), F.when(w["gap"] == size, "alt").otherwise("other"))
    return F.when(w["hit"] < 0, no_anchor).when(deletion, by_deletion).otherwise(by_insertion)


def indel_verdicts(reads: DataFrame, sites: DataFrame, salt: int = SALT) -> DataFrame:
    """ref / alt / other per informative (site, read); a read that ends at the anchor says nothing."""
    over = reads_over_sites(usable_reads(reads, indel=True), sites, salt).withColumn("_w", walked())
    return over.withColumn("verdict", _verdict()).where(F.col("verdict").isNotNull())


def _verdict_sums() -> list[Column]:
    return [F.count_if(F.col("verdict") == v).alias(f"{v}_count") for v in ("ref", "alt", "other")]


def call_indels(verdicts: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = verdicts.groupBy(*by).agg(F.count(F.lit(1)).alias("depth"), *_verdict_sums())
    return counts.withColumn("dosage", C.indel_dosage(F.col("alt_count"), F.col("depth"))).withColumn(
        "genotype", C.dosage_text(F.col("dosage"))
    )


SITE_KEYS = ["sample_id", "chrom", "site_pos", "ref", "alt"]


def genotype_sites(reads: DataFrame, sites: DataFrame, reference_bases: DataFrame | None = None) -> DataFrame:
    """SNV and indel genotypes of all samples at all sites, in one pass over the reads. ``sites``: chrom, pos, ref, alt.

    A supplementary alignment shows bases but no indel.
    """
    indel = F.length("ref") != F.length("alt")
    over = _with_base(reads_over_sites(usable_reads(reads), sites.select("chrom", "pos", "ref", "alt")).withColumn("_w", walked()))
    over = over.withColumn("verdict", F.when(indel & (F.col("flag").bitwiseAND(K.FLAG_SUPPLEMENTARY) == 0), _verdict()))
    counts = over.where(F.when(indel, F.col("verdict").isNotNull()).otherwise(_shows_base())).groupBy(*SITE_KEYS).agg(
        F.count(F.lit(1)).alias("depth"), *_base_sums(), *_verdict_sums()
    )
    counted = counts.withColumnsRenamed({"site_pos": "pos", "alt_count": "_indel_alt"})
    called = call_snvs(counted, reference_bases).withColumn("dosage", F.when(indel, C.indel_dosage(F.col("_indel_alt"), F.col("depth"))).otherwise(F.col("dosage")))
    marks = ("ref_sanity_failed", "strand_flip", "strand_bias")
    return called.select(
        "sample_id", "chrom", "pos", "ref", "alt", "depth", F.when(indel, F.col("_indel_alt")).otherwise(F.col("alt_count")).alias("alt_count"), "dosage",
        C.dosage_text(F.col("dosage")).alias("genotype"), *[(~indel & F.col(c)).alias(c) for c in marks],
    )


def score_from_reads(reads: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores straight from reads: effect-allele share at each weight's position.

    A site below the depth cut counts as low coverage and as missing; the complement is tried when the effect base is
    unseen. AVG is SUM over twice the matched sites.
    """
    # sites, weights and totals read the same table: written once, or each would work it out again
    weights = written(weights.select("pgs_id", "chrom", "pos", "effect_allele", "weight"), "read-weights")
    sites = weights.select("chrom", "pos").distinct()
    counts = base_counts(base_observations(reads, sites), ["sample_id", "chrom", "site_pos"]).withColumnRenamed("site_pos", "pos")
    effect = F.upper(F.col("effect_allele").substr(1, 1))
    # samples without any usable read at a weight's site are counted from the totals below
    joined = counts.join(never_broadcast(weights), ["chrom", "pos"])
    direct, turned = _count_of(effect), _count_of(G.complement(effect))
    flip = (direct == 0) & (turned > 0)
    joined = joined.withColumn("_n", F.when(flip, turned).otherwise(direct)).withColumn(
        "_covered", F.col("depth") >= K.MIN_DEPTH
    ).withColumn("_flip", F.col("_covered") & flip).withColumn("_d", C.snv_dosage(F.col("_n"), F.col("depth")))
    per = joined.groupBy("sample_id", "pgs_id").agg(
        F.coalesce(F.sum(F.col("_d") * F.col("weight")), F.lit(0.0)).alias("score_sum"),
        F.count_if("_covered").alias("matched"),
        F.count_if("_flip").alias("strand_flips"),
    )
    totals = weights.groupBy("pgs_id").agg(F.count(F.lit(1)).alias("total"))
    return per.join(never_broadcast(totals), "pgs_id").select(
        "sample_id", "pgs_id", "score_sum", "matched", (F.col("total") - F.col("matched")).alias("missing"),
        (F.col("total") - F.col("matched")).alias("low_cov"), "strand_flips", "total",
        F.when(F.col("matched") > 0, F.col("score_sum") / (2 * F.col("matched"))).alias("raw_score"),
    )
