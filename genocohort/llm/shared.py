"""What several operators share: input tables, the shared folder, written tables, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()
#: Bytes of an Arrow batch: rows are texts of any length, so a number of rows bounds nothing. A longer text stands alone.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shipped(spark: SparkSession) -> SparkSession:
    """Gives the executors' Python workers this library, once per application, whether or not it is installed there, and bounds the
    session's Arrow batches by bytes if they are not bounded as tightly already.

    The archive is the driver's own: Spark's file server hands it out.
    """
    context = spark.sparkContext
    if int(spark.conf.get(_BATCH_SETTING).removesuffix("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="library-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def lean(run):
    """A mapInArrow function that hands the memory its batches took back when it is done: the worker lives on, idle or for another task."""

    def wrapped(batches):
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read as Spark reads it."""
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session that names none gets one of its own; a cluster must name it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return tempfile.mkdtemp(prefix="llm-")


def stored(df: DataFrame, name: str, places: list[str] | None = None) -> DataFrame:
    """Writes a table to a fresh place in the shared folder and reads it back: lineage ends, lost executors cost nothing.

    ``places``: a list that takes the place, for a table that is removed when what follows from it is written."""
    place = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    if places is not None:
        places.append(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def removed(spark: SparkSession, places: list[str]) -> None:
    """Deletes tables written by `stored` that nothing reads any more, and empties the list."""
    for place in places:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    places.clear()


def text_crc(column: str) -> F.Column:
    """crc32 of a value as text, as used to fix folds; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def in_blocks(df: DataFrame, size: F.Column, most: int) -> list[list]:
    """Rows of a query-side table in driver-sized blocks of at most `most` units of size (a larger row stands alone).

    Rows come partition by partition; one block is held at a time by the caller's broadcast.
    """
    blocks: list[list] = []
    filled = most + 1
    for row in df.withColumn("_size", size).toLocalIterator():
        if filled + row["_size"] > most:
            blocks.append([])
            filled = 0
        blocks[-1].append(row)
        filled += row["_size"]
    return blocks


#: Bits of a membership filter, at most: 32 MB. Beyond about a tenth as many keys it lets more strangers through, no member less.
MOST_BITS = 1 << 28
FILTER_SHIFTS = (0, 18, 36)


def membership_filter(keys: DataFrame, most_bits: int = MOST_BITS):
    """A Bloom filter, as packed bits of bounded size, of the distinct values of the only column of keys, 64-bit hashes.

    Built by Spark: every key gives three bits, bits are or-ed by 64-bit words, and the words come to the driver. It only spares
    work: whoever uses it joins with the keys afterwards.
    """
    import numpy as np

    name = keys.columns[0]
    n = keys.count()
    size = 1 << 13
    while size < min(most_bits, 16 * n):
        size *= 2
    places = F.array(*(F.shiftrightunsigned(name, k).bitwiseAND(F.lit(size - 1)) for k in FILTER_SHIFTS))
    bits = keys.select(F.explode(places).alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 AS int))").alias("mask"))
    words = bits.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # as columns: a row object a word would take many times the filter
    packed = np.zeros(size // 64, np.uint64)
    packed[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return packed


def may_hold(packed, keys):
    """Whether a filter may hold the keys (a numpy array of unsigned 64-bit hashes)."""
    import numpy as np

    last = np.uint64(len(packed) * 64 - 1)

    def bit(x):
        return (packed[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & np.uint64(1) > 0

    found = np.ones(len(keys), bool)
    for k in FILTER_SHIFTS:
        found &= bit(keys >> np.uint64(k) & last)
    return found
