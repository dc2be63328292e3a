"""New variant files are parsed once and appended to the record table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.vcf import parse_vcf, sample_names, with_samples

RECORD_COLUMNS = ["sample_id", "chrom", "pos", "end_pos", "id", "ref", "alt_csv", "gt", "min_dp", "is_ref_block"]


def _append(rows: DataFrame, batch_id: int, place: str) -> None:
    rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(place)


def prepare_arrivals(spark: SparkSession, source: str, target: str, checkpoint: str) -> None:
    """Process the files that arrived since the last run. The checkpoint makes each file count once; a batch that is
    retried after a lost executor overwrites its own partition.

    A file may hold any number of samples. Its column header is kept by file in a table beside the target (``<target>_samples``), and
    every body line takes the name of its sample column from there, whichever task or batch read the header.
    """
    names_place = f"{target.rstrip('/')}_samples"
    lines = spark.readStream.format("text").load(source).withColumn("file", F.col("_metadata.file_path"))
    # folder columns of the source (such as a lot) travel along
    extra = [c for c in lines.columns if c not in ("value", "file")]

    def store(batch: DataFrame, batch_id: int) -> None:
        _append(sample_names(batch), batch_id, names_place)
        arrived = batch.select("file").distinct()
        known = spark.read.parquet(names_place).where(F.col("batch_id") <= batch_id).select("file", "sample_no", "sample_id")
        # a header that came twice names a column once
        names = known.join(arrived, "file", "left_semi").groupBy("file", "sample_no").agg(F.min("sample_id").alias("sample_id"))
        records = with_samples(parse_vcf(batch, keep=("file", *extra)), names)
        _append(records.select(*extra, *RECORD_COLUMNS), batch_id, target)

    query = (
        lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
