"""Tables in the folder that the driver and all executors see, running numbers over groups of any size, code in workers, stores."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


PACKAGE_ROOT = str(Path(__file__).resolve().parents[1])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it runs from a checkout; on a cluster that has the package this is harmless."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])


def store_of(path: str):
    """The file store of a path (local, or any that a URI names), and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a new local folder in local mode (tests), and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and any executor can read it. Stored small, by zstd."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ranged(rows: DataFrame, keys: list[str | Column], label: str, out: str = "part") -> DataFrame:
    """``rows``, stored, with the number of the range of ``keys`` that each is in: near-equal parts that follow the distribution.

    ``row`` is added where it is missing, a number that no other row has, and ends the keys: rows that are equal in all else are
    dealt too. ``rows`` should be a stored table or a projection of one, and narrow.
    """
    marked = rows.withColumn("row", F.monotonically_increasing_id()) if "row" not in rows.columns else rows
    return written(marked.repartitionByRange(width(rows.sparkSession), *keys, "row").withColumn(out, F.spark_partition_id()), label)


def running(rows: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, out: str, total: str | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group that come before, and optionally the group's ``total``.

    Rows are ordered by ``bucket``, then ``order``. A task holds one bucket of one group: those of ``ranged``
    are near equal. Totals per bucket are thousands of times fewer than rows.
    """
    rows = rows.withColumn("_value", value)
    sums = rows.groupBy(*group, bucket).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"_{g}") for g in group], F.col(bucket).alias("_bucket"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), F.sum("_sum").over(Window.partitionBy(*group)).alias("_total"))
    condition = F.col(bucket) == F.col("_bucket")
    for g in group:
        condition = condition & F.col(g).eqNullSafe(F.col(f"_{g}"))
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_own", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    joined = own.join(sums, condition).withColumn(out, F.col("_base") + F.col("_own"))
    if total:
        joined = joined.withColumn(total, F.col("_total"))
    return joined.drop("_value", "_own", "_base", "_total", "_bucket", *[f"_{g}" for g in group])


#: Bits of a filter of keys: at least, for each key, and at most (16 MB, so that it can be sent to all tasks).
LEAST_BITS, BITS_A_KEY, MOST_BITS = 1 << 15, 16, 1 << 27


def key_filter(keys: DataFrame, column: str) -> tuple[DataFrame, int]:
    """(bucket, bitmap) of the hashes of a stored table's keys, and the number of bits: 4,096 rows of 4 KB at most, however many keys there are."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    return keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")), bits


def with_maybe(rows: DataFrame, column: str, filter_: tuple[DataFrame, int], out: str = "_maybe") -> DataFrame:
    """Add ``out``: false where ``column`` is null or surely none of the keys. What is true still has to meet them.

    Rows stay where they are. With more keys than the filter has room for, more of them are true.
    """
    bitmap, bits = filter_
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    sent = F.broadcast(bitmap.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap")))
    marked = rows.withColumn("_bucket", F.when(F.col(column).isNotNull(), F.bitmap_bucket_number(place))).withColumn("_at", F.bitmap_bit_position(place)).join(sent, "_bucket", "left")
    byte = F.conv(F.hex(F.substring("_bitmap", (F.expr("_at div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = marked.withColumn("_byte", byte).withColumn(out, F.coalesce(F.expr("shiftright(_byte, cast(_at % 8 AS int)) & 1") == 1, F.lit(False)))
    return marked.drop("_bucket", "_bitmap", "_at", "_byte")
