"""Linkage: r2 of neighbouring variants over bit planes of dosages, and pruning to a set without linked pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genotype import whole
from ..session import written
from .picks import never_broadcast
from .running import numbered, ordinal

MEGABASE = 1_000_000
#: Samples of a word, and words of a row: 16,384 samples.
WORD, CHUNK_WORDS = 64, 256
#: Up to so many words a row, sums over words are spelled out: Spark compiles these, but walks through an array one call a cell.
SPELLED_WORDS = 4
#: Partitions of the pairs for each of the session's shuffle partitions: planes are small against the pairs that they make.
PARTS_FOR_PAIRS = 2


def variant_index(variants: DataFrame) -> DataFrame:
    """0-based place of each distinct position on its chromosome."""
    sites = variants.select("chrom", "pos").distinct()
    return ordinal(sites, ["chrom"], whole(F.col("pos"), MEGABASE), ["pos"], "idx")


def bit_planes(calls: DataFrame) -> tuple[DataFrame, int]:
    """The planes and the number of chunks, see ``sized_planes``."""
    planes, chunks, _ = sized_planes(calls)
    return planes, chunks


def sized_planes(calls: DataFrame) -> tuple[DataFrame, int, int]:
    """(chrom, pos, _chunk, called, low, high), the number of chunks and the words of a row: dosages of a variant as bits, one a sample in a fixed order, in words of 64.

    ``called`` marks the samples with a call, ``low`` and ``high`` hold the two bits of the dosage (0, 1 or 2). A chunk is at most
    CHUNK_WORDS words, so the row of a variant is bounded whatever the number of samples. A sample has one call a position.
    """
    known = calls.where(F.col("dosage").isNotNull())
    # as files, so that Spark knows how small it is before it would shuffle all calls by sample
    placed = written(numbered(known, "sample_id", "_s"), "sample-numbers")
    all_words = max(1, -(-placed.count() // WORD))
    words = min(CHUNK_WORDS, all_words)
    d = F.col("dosage").cast("int")
    bit = F.expr(f"shiftleft(1L, cast(_s % {WORD} AS int))")
    plane = lambda on, name: F.coalesce(F.bit_or(F.when(on, bit)), F.lit(0).cast("long")).alias(name)
    word = whole(F.col("_s"), WORD)
    per_word = known.join(placed, "sample_id").groupBy("chrom", "pos", whole(word, CHUNK_WORDS).alias("_chunk"), (word % CHUNK_WORDS).cast("int").alias("_word")).agg(
        plane(F.lit(True), "called"), plane(d.bitwiseAND(1) != 0, "low"), plane(d.bitwiseAND(2) != 0, "high")
    )
    held = per_word.groupBy("chrom", "pos", "_chunk").agg(F.map_from_entries(F.collect_list(F.struct("_word", F.struct("called", "low", "high")))).alias("_words"))
    row = lambda name: F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.coalesce(F.element_at("_words", w)[name], F.lit(0).cast("long"))).alias(name)
    return held.select("chrom", "pos", "_chunk", row("called"), row("low"), row("high")), -(-all_words // words), words


def _both(a: str, b: str, words: int) -> Column:
    """Samples whose bits are set in both planes of so many words."""
    if words <= SPELLED_WORDS:
        counts = [F.bit_count(F.get(a, F.lit(w)).bitwiseAND(F.get(b, F.lit(w)))) for w in range(words)]
        return sum(counts[1:], counts[0]).cast("long")
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x).cast("long")


def ld_pairs(calls: DataFrame, window: int = 1000, step: int = 50, min_r2: float = 0.0) -> DataFrame:
    """r2 of every pair inside a window of ``window`` variants that moves by ``step``.

    A variant is one row of bit planes (for each chunk of samples) and meets only the variants of its own and the next index block:
    variants x window rows are joined, and the sums over samples are bit counts of and-ed words.
    """
    # every part below reads the calls: written once, or each would work them out again
    calls = written(calls.select("sample_id", "chrom", "pos", "dosage"), "linkage-calls")
    packed, chunks, words = sized_planes(calls)
    # written once, as both sides of the join read them: three bits a call
    planes = written(packed.join(variant_index(calls), ["chrom", "pos"]), "bit-planes")
    home = whole(F.col("idx"), window)
    side = lambda n: [F.col("idx").alias(n), F.col("pos").alias(f"pos_{n}"), *(F.col(p).alias(f"{p}_{n}") for p in ("called", "low", "high"))]
    left = planes.select("chrom", "_chunk", home.alias("_block"), *side("i"))
    right = planes.select("chrom", "_chunk", F.explode(F.array(home, home - 1)).alias("_block"), *side("j"))
    near = (F.col("j") > F.col("i")) & (F.col("j") - whole(F.col("i"), step) * step < window)
    both = lambda a, b: _both(a, b, words)
    sums = {
        "n": both("called_i", "called_j"), "x1": both("low_i", "called_j"), "x2": both("high_i", "called_j"), "y1": both("called_i", "low_j"), "y2": both("called_i", "high_j"),
        "sxy": both("low_i", "low_j") + 2 * (both("low_i", "high_j") + both("high_i", "low_j")) + 4 * both("high_i", "high_j"),
    }
    meet = ["chrom", "_chunk", "_block"]
    parts = PARTS_FOR_PAIRS * int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # generated, so that the filters on r2 stay above: inside the join they would count the bits again wherever a sum is named
    counted = left.repartition(parts, *meet).join(never_broadcast(right.repartition(parts, *meet)), meet).where(near).select(
        "chrom", "pos_i", "pos_j", F.explode(F.array(F.struct(*[x.alias(name) for name, x in sums.items()]))).alias("_sums")
    ).select("chrom", "pos_i", "pos_j", "_sums.*")
    if chunks > 1:
        counted = counted.groupBy("chrom", "pos_i", "pos_j").agg(*[F.sum(c).alias(c) for c in ("n", "x1", "x2", "y1", "y2", "sxy")])
    n, sx, sy = F.col("n"), F.col("x1") + 2 * F.col("x2"), F.col("y1") + 2 * F.col("y2")
    spreads = {
        "cov": n * F.col("sxy") - sx * sy,
        "vx": n * (F.col("x1") + 4 * F.col("x2")) - sx * sx,
        "vy": n * (F.col("y1") + 4 * F.col("y2")) - sy * sy,
    }
    # generated too: written out in every place that names r2, they make a method that the JVM does not compile
    counted = counted.withColumn("_spreads", F.explode(F.array(F.struct(*[x.alias(name) for name, x in spreads.items()])))).select("chrom", "pos_i", "pos_j", "n", "_spreads.*")
    cov, vx, vy = (F.col(name).cast("double") for name in spreads)
    r2 = cov * cov / F.when((vx > 0) & (vy > 0), vx * vy)
    out = counted.withColumn("r2", r2).where(F.col("r2").isNotNull())
    if min_r2:
        out = out.where(F.col("r2") > min_r2)
    return out.select("chrom", "pos_i", "pos_j", "n", "r2")


def ld_prune(linked: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Variants to keep: no two linked, the more frequent of a pair goes first.

    ``linked``: chrom, pos_i, pos_j of pairs over the threshold. ``frequencies``: chrom, pos, maf. A pair is one row, from the variant that
    outranks to the other. Each round the variants that no remaining pair outranks win, and drop their neighbours, which is the greedy
    result whatever the round count; what is never dropped is kept. Ranks are compared once and do not move, and a round's table is written.
    Equal frequencies go in md5 order of the position: neighbours with ties are then decided in few rounds, where an order
    along the chromosome would decide two a round.
    """
    nodes = frequencies.groupBy("chrom", "pos").agg(F.min(-F.col("maf")).alias("first"))
    ra = nodes.select("chrom", F.col("pos").alias("pos_i"), F.col("first").alias("first_i"))
    rb = nodes.select("chrom", F.col("pos").alias("pos_j"), F.col("first").alias("first_j"))
    rank = lambda x: F.struct(F.col(f"first_{x}").alias("a"), F.md5(F.concat_ws(":", "chrom", F.col(f"pos_{x}").cast("string")).cast("binary")).alias("b"), F.col(f"pos_{x}").alias("c"))
    ahead = rank("i") < rank("j")
    pairs = linked.select("chrom", "pos_i", "pos_j").join(never_broadcast(ra), ["chrom", "pos_i"]).join(never_broadcast(rb), ["chrom", "pos_j"])
    edges = written(pairs.select("chrom", F.when(ahead, F.col("pos_i")).otherwise(F.col("pos_j")).alias("over"), F.when(ahead, F.col("pos_j")).otherwise(F.col("pos_i")).alias("under")), "linked")
    kept = frequencies.select("chrom", "pos")
    dropped = None
    while not edges.isEmpty():
        outranked = edges.select("chrom", F.col("under").alias("over")).distinct()
        losers = written(edges.join(outranked, ["chrom", "over"], "left_anti").select("chrom", F.col("under").alias("pos")).distinct(), "dropped")
        dropped = losers if dropped is None else dropped.unionByName(losers)
        # a winner's pairs are all with losers, so what is left has no winner in it
        for end in ("over", "under"):
            edges = edges.join(losers.withColumnRenamed("pos", end), ["chrom", end], "left_anti")
        edges = written(edges, "linked")
    return kept if dropped is None else kept.join(dropped, ["chrom", "pos"], "left_anti")
