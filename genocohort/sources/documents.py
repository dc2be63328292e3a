"""JSON sources: report documents, line logs, catalogue score documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VARIANT = T.StructType([T.StructField(n, T.StringType()) for n in ("variant", "gene", "name", "genotype")])
RESULT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("status", "headline", "match_rate", "output", "pgs_id", "trait")]
    + [T.StructField("percentile", T.DoubleType()), T.StructField("match_rate_value", T.DoubleType()),
       T.StructField("no_report", T.BooleanType()), T.StructField("matched_variants", T.LongType()),
       T.StructField("total_variants", T.LongType()), T.StructField("variants", T.ArrayType(VARIANT))]
)
REPORT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("task_id", "test_id", "test_name", "category", "file_id", "completed_at",
                                                "profile_id", "interpretation")]
    + [T.StructField("elapsed_seconds", T.DoubleType()), T.StructField("attempt", T.IntegerType()),
       T.StructField("result", RESULT)]
)
LOG = T.StructType([T.StructField(n, T.StringType()) for n in ("timestamp", "ts", "task_id", "test_id", "test_name", "error",
                                                               "pgs_id", "status", "detail")])
CATALOGUE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("trait_reported", T.StringType()),
    T.StructField("variants_number", T.LongType()), T.StructField("weight_type", T.StringType()),
    T.StructField("method_name", T.StringType()), T.StructField("original_genome_build", T.StringType()),
    T.StructField("publication", T.StructType([T.StructField(n, T.StringType()) for n in (
        "firstauthor", "journal", "date_publication", "doi", "title", "PMID")])),
    T.StructField("ancestry_distribution", T.StructType([T.StructField("gwas", T.StructType([
        T.StructField("dist", T.MapType(T.StringType(), T.DoubleType())), T.StructField("count", T.LongType())]))])),
    T.StructField("ftp_harmonized_scoring_files", T.StructType([
        T.StructField(b, T.MapType(T.StringType(), T.StringType())) for b in ("GRCh37", "GRCh38")])),
    T.StructField("trait_efo", T.ArrayType(T.StructType([T.StructField("description", T.StringType())]))),
])


def parse_json(rows: DataFrame, schema: T.StructType, text: str = "value") -> DataFrame:
    """Typed documents; text that is not JSON drops out."""
    with_mark = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = rows.withColumn(
        "_doc", F.from_json(text, with_mark, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    ).where(F.col("_doc").isNotNull() & F.col("_doc._corrupt").isNull())
    return parsed.select(
        *[c for c in rows.columns if c != text], *[F.col(f"_doc.{f.name}").alias(f.name) for f in schema.fields]
    )


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """``<root>/<file_id>/*.json``: the folder names the file when the document does not."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_path"))
    folder = F.element_at(F.split("_path", "/"), -2)
    return parse_json(raw, REPORT).withColumn("file_id", F.coalesce("file_id", folder)).drop("_path")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_json(spark.read.text(path), LOG)
