"""The registered queries, each a thin digest of what its operator gives, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontamination, jaccard, language, mixing, negatives, pages, spelling, suffixes, tokens, toxicity, vectors
from .shared import table, text_crc


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(text_crc("doc_id"), F.lit(3)) == 1
    filters = language.learn(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = language.identified(docs.select("doc_id", held_out.alias("held_out"), "text"), filters)
    return found.select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_lang_score").alias("score"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "pages")
    found = pages.extracted(given.select("page_id", "url", "html"), pages.learn(given.select("page_id", "html")))
    return found.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, share=(85, 100))


SQL_OP3 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common WHERE 100 * i >= 85 * (na + nb - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = s.doc_id)::BIGINT AS component_id FROM s
"""


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL_OP4 = r"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= 0.9 * a.n * b.n),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, (SELECT min(b) FROM reach WHERE a = vec_id)::BIGINT AS component_id,
       (SELECT min(b) FROM reach WHERE a = vec_id) = vec_id AS kept FROM v
"""


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed_documents(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", F.round("position", 6).alias("position"))


SQL_OP5 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
w AS (SELECT source, source_size, n % 3 AS class, CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM t),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (
          ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
a AS (SELECT *, 2 * source_size / weight > level AS free, max(CASE WHEN 2 * source_size / weight > level THEN level END) OVER () AS top FROM l),
g AS (SELECT source, class, source_size, CASE WHEN free THEN weight * top ELSE (2 * source_size)::DOUBLE END AS target FROM a),
c AS (SELECT doc_id, d.source, size, class, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS rate,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
s AS (SELECT *, CASE WHEN source_size > 0 THEN before / source_size ELSE 0 END::DOUBLE AS x FROM c)
SELECT doc_id, size, source_size, target, source,
       (rate * size + least(greatest(round(target - rate * source_size)::BIGINT - before, 0), size))::BIGINT AS taken,
       round(CASE class WHEN 1 THEN x WHEN 0 THEN (sqrt(0.25 + 2 * x) - 0.5) ELSE 1.5 - sqrt(greatest(2.25 - 2 * x, 0)) END::DOUBLE, 6) AS position
FROM s
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.with_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("_items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), decontamination.hit_words().alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"),
    )


SQL_OP7 = r"""
WITH dw AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM bw WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, k, array_to_string(w[i + 1 : i + k], ' ') AS g FROM bs),
ks AS (SELECT DISTINCT k FROM bg),
ds AS (SELECT doc_id, k, w, unnest(range(0, len(w) - k + 1)) AS i FROM dw, ks WHERE len(w) >= k),
hits AS (SELECT doc_id, item_id, i, ds.k FROM ds JOIN bg ON ds.k = bg.k AND array_to_string(w[i + 1 : i + ds.k], ' ') = g),
places AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = tokens.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read_documents(files)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(text_crc("doc_id"), F.lit(5)) == 0
    # one label per id, and about SAMPLE_PER_CLASS of either, before they meet the texts
    labels = table(spark, sf_dir, "labels").where(~held_out & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    machine = toxicity.learn(docs.join(toxicity.sampled(labels), "doc_id"))
    found = toxicity.toxicity(docs.withColumn("held_out", held_out), machine)
    return found.select("doc_id", "held_out", F.col("_toxicity").alias("score"), (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"))


def op10_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_trees(chat.write_trees(turns))


SQL_OP10 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, length('<s>[INST][/INST]</s>') + length(role) + length(text) + len(regexp_extract_all(role || text, '[<\[\\]')) AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(spelling.runs(F.col("text"))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    place = F.pmod(h, F.length("run")).cast("int")
    words = found.select(F.when(h % 199 == 0, spelling.without(F.col("run"), place)).otherwise(F.col("run")).alias("word"))
    return spelling.grouped(spelling.counted(words))


SQL_OP11 = r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{6,}')) AS run FROM documents),
d AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS bytes FROM d),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM b, t),
e AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
c AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM w, range(1, 2000) k(i) WHERE i <= length(word)),
p AS MATERIALIZED (SELECT a.word, b.word AS near, b.n AS near_n FROM c a JOIN c b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT c.word, w.word, w.n FROM c JOIN w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM c JOIN w ON c.rest = w.word),
g AS (SELECT word, count(*)::BIGINT AS n_near, min({'less': -near_n, 'near': near}) AS f FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -f.less >= 5 * w.n THEN f.near END AS form, CASE WHEN -f.less >= 5 * w.n THEN -f.less END::BIGINT AS form_n
      FROM w LEFT JOIN g USING (word)),
up AS (SELECT word, word AS at FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON up.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.at AS root, f.n, f.n_near, f.form_n FROM f JOIN up ON f.word = up.word JOIN f last ON up.at = last.word WHERE last.form IS NULL
"""


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    found = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    listed = F.array_join(F.transform("_ids", lambda x: x.cast("string")), " ")
    return found.select(
        "doc_id", F.size("_ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("_decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), negatives.rounded(F.col("embedding")).alias("vector"))
    return negatives.mined(rows, F.col("vec_id") % 50 == 0)


SQL_OP13 = r"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_language_id, op2_main_text, op3_jaccard_join, op4_near_vectors, op5_curriculum_mix, op6_suffix_dedup, op7_decontamination, op8_token_files, op9_toxicity, op10_chat_trees,
    op11_spelling_variants, op12_bpe_round_trip, op13_hard_negatives,
)}
ORACLES: dict[str, str] = {"op3_jaccard_join": SQL_OP3, "op4_near_vectors": SQL_OP4, "op5_curriculum_mix": SQL_OP5, "op7_decontamination": SQL_OP7, "op10_chat_trees": SQL_OP10, "op11_spelling_variants": SQL_OP11, "op13_hard_negatives": SQL_OP13}
