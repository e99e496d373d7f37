"""Shared plumbing: the package in Python workers, batches, and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.shared import ship as ship_package

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Words of the contracts: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it runs from a checkout.

    A cluster gets the package through ``--py-files`` or its image; then this is harmless. Batches for
    Python are held to a few megabytes unless the session says otherwise, however long the texts are.
    """
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(8 << 20))
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id is in no fold (-1)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1)).cast("int")
