"""Products dealt by score: the rows of plain joins, lists in place of pairs in the shuffle, and nothing shuffled after the sums."""

import random

from pyspark.sql import functions as F

from genocohort.checks import distribution, scoring
from genocohort.fixtures import Views
from genocohort.operators import distribution as D
from genocohort.operators import scoring as O
from genocohort.operators.degrees import packed, unpacked
from genocohort.plans.backfill import backfill_stats
from genocohort.plans.polygenic import matched_panel_stats
from genocohort.sources.sinks import write_raw_scores
from tests.compare import ROOT

SF = f"{ROOT}/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def calls_of(spark, ids, kind):
    r = random.Random(8)
    rows = [(s, r.choice("12"), r.randint(1, 6), r.choice(["A", "C", None]), r.choice("GT"), r.choice([0, 1, 2, None])) for s in ids for _ in range(6)]
    return spark.createDataFrame(rows, f"sample_id {kind}, chrom string, pos long, ref string, alt string, dosage int")


def weights_of(spark):
    r = random.Random(9)
    rows = [(p, r.choice("12"), r.choice([1, 2, 3, 4, 5, 6, None]), r.choice("ACGT"), r.choice(["A", "C", "G", None]), r.choice([0.5, -0.25, None])) for p in ("P", "Q", "R", None) for _ in range(40)]
    return spark.createDataFrame(rows, "pgs_id string, chrom string, pos long, effect_allele string, other_allele string, weight double")


def rows(df):
    return sorted(map(str, df.collect()))


def test_dealt_products_are_those_of_the_plain_join(spark):
    """Null, repeated, negative and very long ids, texts as ids, and calls of several ALTs."""
    columns = ["sample_id", "pgs_id", "weight", "effect_dosage"]
    weights = weights_of(spark)
    for ids, kind in (([1, 1, -7, None, 2**62, -(2**63), 2**63 - 1, 300], "long"), ([5, -5, None, 2**31 - 1], "int"), (["a", None, ""], "string")):
        calls = calls_of(spark, ids, kind)
        several = calls.withColumns({"alts": F.array("alt", F.lit("C")), "gt": F.element_at(F.array(*[F.lit(g) for g in ("0/1", "1/2", "./.", "1")]), F.coalesce("dosage", F.lit(3)) + 1)})
        for match, side in ((O.match_effect_allele, calls), (O.match_allele_pair, calls), (O.match_effect_allele, several)):
            sides = O.settled(side, weights)
            plain, dealt = match(*sides).select(*columns), match(*sides, parts=5).select(*columns)
            assert rows(dealt) == rows(plain) and dealt.schema["sample_id"].dataType == plain.schema["sample_id"].dataType
            assert plain.count() > 5


def test_numbers_come_back_from_their_bytes(spark):
    numbers = [0, 1, -1, 255, 256, -256, 2**24, 2**31, -(2**63), 2**63 - 1, None]
    df = spark.createDataFrame([(numbers,)], "n array<bigint>").select(*[x.alias(c) for c, x in packed(F.col("n"), 3).items()])
    zipped = df.withColumn("e", F.explode(F.arrays_zip(*df.columns)))
    assert [r[0] for r in zipped.select(unpacked(lambda c: F.col(f"e.{c}"), 3)).collect()] == numbers


def test_lists_are_dealt_where_they_are_smaller(spark):
    """Few shared positions: lists. Every sample at every position of every score: sums of the positions' parts. One score of nearly all: sums."""
    def sides(samples, scores, positions):
        calls = spark.range(samples * positions).select((F.col("id") % samples).alias("sample_id"), F.lit("1").alias("chrom"), F.floor(F.col("id") / samples).alias("pos"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.lit(1).alias("dosage"))
        listed = spark.range(scores * positions).select((F.col("id") % scores).cast("string").alias("pgs_id"), F.lit("1").alias("chrom"), F.floor(F.col("id") / scores).alias("pos"), F.lit("C").alias("effect_allele"), F.lit(0.5).alias("weight"))
        return calls, listed

    parts = O.PARTS_FOR_OUTPUT * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert O.parts_by_score(*sides(20, 20, 3)) == parts
    assert O.parts_by_score(*sides(2, 2, 100 * parts)) is None
    calls, listed = sides(3000, 1, 6000)
    few = spark.range(3).select(F.lit("few").alias("pgs_id"), F.lit("1").alias("chrom"), F.col("id").alias("pos"), F.lit("C").alias("effect_allele"), F.lit(0.5).alias("weight"))
    assert O.parts_by_score(calls, listed.unionByName(few)) is None


def test_sums_are_not_shuffled(spark):
    """Products come dealt by score; their sums, rates and percentiles, and what a sample's row adds, are worked out where they are."""
    v = Views(spark, SF)
    for query in (scoring.ag1, scoring.ag2, distribution.jn2, distribution.sc17, distribution.ag5):
        plan = plan_of(query(v))
        assert "Exchange" not in plan[:plan.index("Generate explode(_entries")], query
    for query in (distribution.sc11_every, distribution.pl6, distribution.confidence, distribution.pl4_every):
        plan = plan_of(query(v))
        assert plan[:plan.index("Generate explode(_entries")].count("Exchange") <= 1, query  # the tags, broadcast


def test_tagged_calls_bring_their_samples_rows(spark):
    """Samples without a row, with several and with equal ones, and a null id: the rows of a join by sample."""
    calls = calls_of(spark, [1, 2, 3, 4, None, 9], "long")
    places = spark.createDataFrame([(1, "EUR"), (2, "EUR"), (2, "MIX"), (3, "AFR"), (3, "AFR"), (4, None), (None, "EUR"), (7, "EUR")], "sample_id long, population string")
    tagged, tags = D.tagged(calls, places)
    assert tags.count() == 4  # EUR, EUR and MIX, AFR twice, null
    sides = O.settled(tagged, weights_of(spark))
    for parts in (None, 4):
        scored = O.sum_scores(O.match_effect_allele(*sides, parts=parts), O.pair_columns(tagged))
        joined = O.sum_scores(O.match_effect_allele(calls, weights_of(spark))).join(places, "sample_id")
        found = D.with_rows(scored, tags)
        assert rows(found.select(*joined.columns)) == rows(joined) and found.count() > 9
    refs = places.where("population is not null").withColumn("is_primary", F.lit(True))
    stats = spark.createDataFrame([("P", "EUR", 0.1, 0.5), ("P", "MIX", 0.2, 0.5), ("Q", "AFR", 0.0, 0.0)], "pgs_id string, population string, mean double, std double")
    tagged, tags = D.tagged(calls, refs)
    scored = O.sum_scores(O.match_effect_allele(*O.settled(tagged, weights_of(spark)), parts=3), O.pair_columns(tagged))
    plain = D.percentiles(scored.drop("_tag"), refs, stats)
    assert rows(D.percentiles(scored, tags, stats).select(*plain.columns)) == rows(plain) and plain.count() > 9


def test_requested_scores_are_worked_out_once(spark):
    worked = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            worked.add(batch.num_rows)
            yield batch

    calls, weights = calls_of(spark, [1, 2], "long"), weights_of(spark)
    asked = spark.createDataFrame([(1, "P"), (2, "Q"), (3, "P")], "sample_id long, pgs_id string")
    n = [t.count() for t in (calls, weights, asked)]
    got = O.score_samples(*[t.mapInArrow(counted, t.schema) for t in (calls, weights, asked)]).collect()
    assert len(got) == 3 and worked.value == sum(n)


def test_dealt_scores_are_ordered_where_they_lie(spark):
    """The quantiles and moments of the two passes, in one that shuffles nothing; groups without a value, or a key, have no row."""
    r = random.Random(3)
    data = [(f"S{i % 7}", r.choice(["EUR", "MIX", None]), r.choice([None, -0.5, 0.25, r.random()])) for i in range(900)] + [("none", "EUR", None), ("one", "EUR", 2.0), (None, "EUR", 1.0)]
    df = spark.createDataFrame(data, "pgs_id string, population string, v double")
    more = [F.max("v").alias("top")]
    dealt = D.score_distribution(df.repartition(4, "pgs_id"), ["pgs_id", "population"], "v", more=more, dealt=True)
    shown = [c for c in dealt.columns if c not in ("mean", "std", "quantiles")]
    as_rows = lambda d: rows(d.select(*shown, *[F.round(c, 9) for c in ("mean", "std")], F.transform(F.map_values("quantiles"), lambda q: F.round(q, 9))))
    plain = D.score_distribution(df, ["pgs_id", "population"], "v", more=more)
    assert as_rows(dealt) == as_rows(plain) and plain.count() == 15
    assert plan_of(dealt).count("Exchange") == 1


def test_distributions_shuffle_no_scores(spark):
    v = Views(spark, SF)
    for query in (distribution.ag3, distribution.ag4, distribution.pl2, distribution.pl3):
        plan = plan_of(query(v))
        assert plan.count("Generate explode(_entries") == 1 and "Exchange hash" not in plan[:plan.index("Generate explode(_entries")], query


def test_stats_read_their_inputs_once(spark):
    """The panel and the weights of backfilled and of matched statistics are worked out once, whatever reads them."""
    worked = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            worked.add(batch.num_rows)
            yield batch

    calls, weights = (t.mapInArrow(counted, t.schema) for t in (calls_of(spark, [1, 2], "long"), weights_of(spark)))
    samples = spark.createDataFrame([(1, "EUR"), (2, "EAS")], "sample_id long, superpop string")
    log = spark.createDataFrame([("Q", "ok")], "pgs_id string, status string")
    stats = spark.createDataFrame([], "pgs_id string, population string")
    n = calls_of(spark, [1, 2], "long").count() + weights_of(spark).count()
    found = backfill_stats(calls, weights, samples, log, stats).select("pgs_id", "population").collect()
    assert worked.value == n and {r.pgs_id for r in found} <= {"P", "R", None} and {r.population for r in found} >= {"EUR", "MIX"}
    positions = weights_of(spark).select("chrom", "pos").distinct()
    assert matched_panel_stats(positions, calls, weights, samples).collect() and worked.value == 2 * n


def test_sums_of_requests_are_those_of_a_join(spark):
    """Requests as rows of the sums: pairs nobody asked for, pairs without a product and null ids go, a pair asked for twice is one row."""
    calls, weights = calls_of(spark, [1, 2, 3, None], "long"), weights_of(spark)
    asked = spark.createDataFrame([(1, "P"), (1, "P"), (2, "Q"), (3, "none"), (9, "P"), (3, "R")], "sample_id int, pgs_id string")
    want = O.sum_scores(O.match_effect_allele(calls, weights)).join(asked.distinct(), ["sample_id", "pgs_id"], "left_semi")
    sides = O.settled(calls, weights)
    for parts in (None, 3):
        got = O.sum_asked(O.match_effect_allele(*sides, parts=parts, asked=asked))
        assert rows(got.select(*want.columns)) == rows(want) and want.count() == 3


def test_scores_not_stored_yet_are_added(spark, tmp_path):
    """Files of other scores stay as they are; a score that is given again replaces its rows, and no other."""
    def table(*given):
        return spark.createDataFrame([(p, q, s, x) for p, q, s, x in given], "pgs_id string, population string, sample_id long, raw_score double")

    path = f"{tmp_path}/scores"
    stored = lambda: spark.read.parquet(path).select("pgs_id", "population", "sample_id", "raw_score")
    files = lambda: {str(f) for f in tmp_path.rglob("*.parquet")}
    first = [(f"P{i}", q, 1, 0.5) for i in range(40) for q in ("EUR", "MIX")]
    write_raw_scores(table(*first), path)
    before = files()
    new = [(f"Q{i}", q, 1, 0.5) for i in range(40) for q in ("EUR", "MIX")]
    write_raw_scores(table(*new), path, spark.read.parquet(path))
    assert before < files() and rows(stored()) == rows(table(*first, *new))
    write_raw_scores(table(("P3", "EUR", 2, 0.75)), path, spark.read.parquet(path))
    assert rows(stored()) == rows(table(*[r for r in first if r[:2] != ("P3", "EUR")], *new, ("P3", "EUR", 2, 0.75)))
