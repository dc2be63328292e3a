"""Text lines with their file and an order key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, value, line_order). ``line_order`` follows file order, also when Spark splits a large file."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        "value",
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")
        ).alias("line_order"),
    )


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, value, line_no): lines with their number in the file, from 0, the same however Spark splits the files.

    The lines of every split are counted, and counts are added up over the splits before it in its file; inside a split a line's
    place is its distance from the split's first. The splits, a row each, are joined by file and offset, so a large file is many keys.
    """
    split = [F.col("line_order.block").alias("block"), F.col("line_order.n").alias("n")]
    lines = read_lines(spark, paths).select("file", "value", *split)
    splits = read_lines(spark, paths).select("file", *split).groupBy("file", "block").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("lines"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = splits.select("file", "block", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    return lines.join(placed, ["file", "block"]).select("file", "value", (F.col("before") + F.col("n") - F.col("first")).alias("line_no"))


def worked_out(rows: DataFrame, **columns: Column) -> DataFrame:
    """The rows with further columns, each worked out once a row. A plain column is copied into every filter and join condition that asks
    for it, and into each place that it is named there; what an explode made is not."""
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return rows.withColumn("_made", F.explode(F.array(made))).select("*", *[F.col("_made")[name].alias(name) for name in columns]).drop("_made")


def split_columns(rows: DataFrame, headers: DataFrame, by: str = "file") -> DataFrame:
    """Attach ``cells``: column name -> text, using the header row of each file."""
    named = rows.join(headers, by)
    cells = F.split("value", "\t")
    names = F.col("names")
    # short rows keep the columns they have
    width = F.least(F.size(names), F.size(cells))
    return worked_out(named, cells=F.map_from_arrays(F.slice(names, F.lit(1), width), F.slice(cells, F.lit(1), width))).drop("names")
