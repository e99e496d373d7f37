"""Evidence files: complete listing, classification by content and name, digests."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.errors import ArtifactError, IntegrityError
from tracewell.shared import ship, store_of, written

REGISTRY, EVENT_LOG, SHORTCUT, JUMP_LIST, UNKNOWN = "registry_hive", "evtx_log", "lnk_shortcut", "jump_list", "unknown"
#: First bytes of each format, as hexadecimal digits, in the order in which they are tried.
MAGIC = ((REGISTRY, "72656766"), (EVENT_LOG, "456C6646696C6500"), (SHORTCUT, "4C000000"))
SUFFIXES = ((EVENT_LOG, ".evtx"), (SHORTCUT, ".lnk"), (JUMP_LIST, ".automaticdestinations-ms"), (JUMP_LIST, ".customdestinations-ms"))
CHUNK = 65_536
#: Names of a folder that one batch of a listing holds.
LISTED = 10_000


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What lies in folders: path, size, and whether it is a folder. Links to folders are not followed."""
    for batch in batches:
        for folder in batch["folder"]:
            store, path = store_of(folder)
            if isinstance(store, fs.LocalFileSystem):
                with os.scandir(path) as entries:
                    rows = [(e.path, 0 if e.is_dir(follow_symlinks=False) else e.stat().st_size, e.is_dir(follow_symlinks=False)) for e in entries if e.is_dir(follow_symlinks=False) or e.is_file()]
            else:
                prefix = folder[: len(folder) - len(path)]
                rows = [(prefix + e.path, e.size or 0, e.type == fs.FileType.Directory) for e in store.get_file_info(fs.FileSelector(path))]
            for at in range(0, len(rows), LISTED):
                yield pd.DataFrame(rows[at : at + LISTED], columns=["path", "size_bytes", "is_folder"])


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path, rel_path and size of every regular file below ``root``, hidden and empty ones too.

    Spark's file sources skip names that begin with a dot or an underscore, and empty files; evidence may not be skipped.
    Folders are looked into level by level, those of each level dealt anew to all tasks, so neither a deep nor a wide part of
    the tree is one task's. ``root`` is a folder that executors see under the same path, or a URI of a store.
    """
    store, path = store_of(root)
    if store.get_file_info(path).type != fs.FileType.Directory:
        raise NotADirectoryError(root)
    ship(spark)
    top = (root[: root.index("://") + 3] + root.split("://", 1)[1].rstrip("/")) if "://" in root else path
    level, found = spark.createDataFrame([(top,)], "folder string"), []
    while True:
        step = written(level.repartition("folder").mapInPandas(_entries, "path string, size_bytes long, is_folder boolean"), "listing")
        found.append(step.where("NOT is_folder"))
        level = step.where("is_folder").select(F.col("path").alias("folder"))
        if level.isEmpty():
            break
    files = found[0]
    for more in found[1:]:
        files = files.unionByName(more)
    return files.select("path", F.substr("path", F.lit(len(top) + 2)).alias("rel_path"), "size_bytes")


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, name in zip(batch["path"], batch["source_artifact"], strict=True):
            store, own = store_of(path)
            with store.open_input_file(own) as f:
                yield pd.DataFrame({"source_artifact": [name], "content": [f.read()]})


def contents(found: DataFrame) -> DataFrame:
    """(source_artifact, content) of artifacts, read in tasks, one file at a time."""
    ship(found.sparkSession)
    return found.select("path", F.col("rel_path").alias("source_artifact")).mapInPandas(_contents, "source_artifact string, content binary")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        heads, digests = [], []
        for path in batch["path"]:
            digest, head = hashlib.sha256(), b""
            store, own = store_of(path)
            try:
                with store.open_input_file(own) as f:
                    while chunk := f.read(CHUNK):
                        head = head or chunk[:8]
                        digest.update(chunk)
            except OSError as e:
                raise ArtifactError(f"{path}: {e}") from e
            heads.append(head)
            digests.append(digest.hexdigest())
        yield batch.assign(header=heads, sha256=digests)


def artifact_type(header: Column, name: Column) -> Column:
    """Content decides; a name that promises an event log or shortcut over other content, or a short jump list, is an error ('!' before the type)."""
    digits, low = F.hex(header), F.lower(name)
    out = F.lit(UNKNOWN)
    for kind, suffix in reversed(SUFFIXES):
        wrong = F.octet_length(header) < 8 if kind == JUMP_LIST else F.lit(True)
        out = F.when(low.endswith(suffix), F.when(wrong, F.lit("!" + kind)).otherwise(F.lit(kind))).otherwise(out)
    for kind, magic in reversed(MAGIC):
        out = F.when(digits.startswith(magic), F.lit(kind)).otherwise(out)
    return out


def artifacts(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """path, rel_path, size_bytes, sha256 and artifact_type of all evidence; mislabelled files end a strict job, else keep their '!' type."""
    spread = listed(spark, root).repartition("path")
    read = spread.mapInPandas(_read, "path string, rel_path string, size_bytes long, header binary, sha256 string")
    kind = artifact_type(F.col("header"), F.col("rel_path"))
    checked = F.when(kind.startswith("!"), F.raise_error(F.concat(F.lit("mislabelled or truncated artifact: "), "rel_path")).cast("string")).otherwise(kind)
    return read.select("path", "rel_path", "size_bytes", "sha256", (checked if strict else kind).alias("artifact_type"))


def in_order(found: DataFrame) -> DataFrame:
    """By path components, so that a/b comes before a.txt."""
    return found.orderBy(F.split("rel_path", "/"))


def compared(intake: DataFrame, after: DataFrame) -> DataFrame:
    """(verdict): verified if both tables hold the same paths with the same digests, else failed; pending if there are none."""
    both = intake.select("rel_path", F.col("sha256").alias("before")).join(after.select("rel_path", F.col("sha256").alias("after")), "rel_path", "full")
    same = F.bool_and(F.col("before").eqNullSafe(F.col("after")))
    return both.agg(F.when(F.count(F.lit(1)) == 0, F.lit("pending")).when(same, F.lit("verified")).otherwise(F.lit("failed")).alias("verdict"))


def confirmed(intake: DataFrame, after: DataFrame) -> DataFrame:
    """``intake`` as it is, or an error at the first file whose digest is another one now, or that is gone."""
    now = after.select(F.col("rel_path").alias("_path"), F.col("sha256").alias("_now"))
    both = intake.join(now, F.col("rel_path") == F.col("_path"), "left")
    changed = F.raise_error(F.concat(F.lit(f"{IntegrityError.__name__}: digest mismatch: "), "rel_path")).cast("string")
    return both.withColumn("sha256", F.when(F.col("sha256").eqNullSafe(F.col("_now")), F.col("sha256")).otherwise(changed)).select(*intake.columns)
