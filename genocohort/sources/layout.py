"""Records stored by place, so that a few sites read a few files.

Rows lie in folders by chromosome and tile (16 million bases), inside a folder in order of position. A filter on places names the folders,
which Spark prunes before it opens a file; the statistics of Parquet row groups and pages skip most of what is left. A Bloom filter on the
id column lets a lookup by id skip the row groups that cannot hold it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.regions import in_regions

TILE_BITS = 24
#: Sites named one by one in a filter; more are joined, and the join prunes folders at run time.
MOST_NAMED = 1000
FOLDERS = ["at_chrom", "at_tile"]


def tile(pos: Column) -> Column:
    return F.call_function("shiftright", pos.cast("bigint"), F.lit(TILE_BITS)).cast("int")


def _placed(rows: DataFrame) -> DataFrame:
    # a letter in front keeps folder names from being read as numbers
    return rows.withColumn("at_chrom", F.concat(F.lit("c"), "chrom")).withColumn("at_tile", tile(F.col("pos")))


def write_by_place(rows: DataFrame, path: str, id_column: str | None = "id", row_group_bytes: int = 16 << 20) -> None:
    """Writes rows (chrom, pos, ...) by place. Ranges are cut by sampled positions, so a crowded tile is several files; equal positions may
    be spread by sample as well."""
    more = [c for c in ("sample_id",) if c in rows.columns]
    ordered = _placed(rows).repartitionByRange(*FOLDERS, "pos", *more).sortWithinPartitions(*FOLDERS, "pos", *more)
    writer = ordered.write.mode("overwrite").option("parquet.block.size", row_group_bytes)
    if id_column:
        writer = writer.option(f"parquet.bloom.filter.enabled#{id_column}", "true").option(f"parquet.enable.dictionary#{id_column}", "false")
    writer.partitionBy(*FOLDERS).parquet(path)


def read_regions(spark: SparkSession, path: str, regions: Sequence[tuple[str, int | None, int | None]]) -> DataFrame:
    """Rows inside any of (chrom, first, last); open ends are None."""
    folders = F.lit(False)
    for chrom, first, last in regions:
        part = F.col("at_chrom") == f"c{chrom}"
        if first is not None:
            part &= F.col("at_tile") >= first >> TILE_BITS
        if last is not None:
            part &= F.col("at_tile") <= last >> TILE_BITS
        folders |= part
    return spark.read.parquet(path).where(folders & in_regions(regions)).drop(*FOLDERS)


def read_at_sites(spark: SparkSession, path: str, sites: DataFrame, reach: int = 0) -> DataFrame:
    """Rows that start at one of the sites (chrom, pos), or up to ``reach`` bases before it (reference blocks: their greatest length).

    A panel of at most MOST_NAMED sites becomes a filter of literals; a larger one is joined by folder, tile by tile.
    """
    places = sites.select("chrom", F.col("pos").cast("bigint").alias("pos")).distinct()
    named = places.limit(MOST_NAMED + 1).collect()
    if len(named) <= MOST_NAMED:
        return read_regions(spark, path, sorted((r["chrom"], r["pos"] - reach, r["pos"]) for r in named))
    tiles = F.explode(F.sequence(tile(F.greatest(F.col("pos") - reach, F.lit(0))), tile(F.col("pos"))))
    asked = places.select(F.concat(F.lit("c"), "chrom").alias("at_chrom"), tiles.alias("at_tile"), F.col("pos").alias("_site"))
    rows = spark.read.parquet(path)
    if not reach:
        return rows.join(asked.withColumnRenamed("_site", "pos"), [*FOLDERS, "pos"], "left_semi").select(*[c for c in rows.columns if c not in FOLDERS])
    near = (rows.at_chrom == asked.at_chrom) & (rows.at_tile == asked.at_tile) & (rows.pos <= asked["_site"]) & (rows.pos >= asked["_site"] - reach)
    return rows.join(asked, near, "left_semi").drop(*FOLDERS)


def read_ids(spark: SparkSession, path: str, ids: Sequence[str], id_column: str = "id") -> DataFrame:
    """Rows of the given ids; row groups whose Bloom filter holds none of them are not read."""
    return spark.read.parquet(path).where(F.col(id_column).isin(*ids)).drop(*FOLDERS)
