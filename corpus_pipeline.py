"""From raw documents to packed training sequences: five stages, each a Parquet table for the next.

1. quality: documents that the compression classifier rejects go.
2. near_duplicates: of each group of near copies the document with the smallest doc_id stays.
3. secrets: found secrets are replaced by a mask.
4. mixing: documents return as often as the source schedule takes them.
5. packing: token pieces in sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import mixing, ngram_jaccard, packing, quality, secrets
from tracewell.llm.runtime import WORD, columns_of, quoted, table
from tracewell.shared import key_filter, with_maybe, written

#: Columns that exist between the steps of a stage only.
MAYBE, KEPT, REPEATED = "_near_maybe", "_near_kept", "_near_repeated"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, null and empty ones scored as an empty text; all of them where no model can be fitted.

    Ties and repeated rows go alike, other columns are kept, and an empty table gives an empty result.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the smallest doc_id; repeated rows of that id and text are one document, the least by its other columns.

    Null, empty and other texts without words are linked with nothing and stay, repeated or not; documents without an id can't
    stand for a group and stay. Other columns, whatever their names, are kept. An empty table gives an empty result.
    """
    found = ngram_jaccard.near_duplicates(docs).groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("kept"), (F.count(F.lit(1)) > 1).alias("repeated"))
    # most documents are one row that stays, and a filter of bounded size says so where they are: only the others' texts move
    decided = written(found.where("doc_id IS NOT NULL AND (repeated OR NOT kept)"), "decided-ids")
    marked = with_maybe(docs, "doc_id", key_filter(decided, "doc_id"), MAYBE)
    asked = marked.where(MAYBE).join(decided.select("doc_id", F.col("kept").alias(KEPT), F.col("repeated").alias(REPEATED)), "doc_id", "left")
    rows = written(asked.where(F.coalesce(KEPT, F.lit(True))).select(*columns_of(docs), F.coalesce(REPEATED, F.lit(False)).alias(REPEATED)), "asked-documents")
    single = rows.where(~F.col(REPEATED)).select(*columns_of(docs))
    # equal rows of an id that several have come down to one in each task before they meet
    counted = rows.where(REPEATED).select(*columns_of(docs))
    wordless = ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = counted.where(~wordless).groupBy("doc_id", F.sha2("text", 256).alias("_text")).agg(F.min(F.struct(*map(quoted, others), "text")).alias("_row"))
    once = least.select(*[F.col(c) if c == "doc_id" else F.col(f"_row.{quoted(c)}").alias(c) for c in docs.columns]).unionByName(counted.where(wordless))
    return marked.where(~F.col(MAYBE)).select(*columns_of(docs)).unionByName(single).unionByName(once)


def masked_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets masked; null and empty texts, repeated rows and other columns as they are. Empty tables stay empty."""
    return secrets.redact(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the schedule takes them, in its order; null and empty texts have no words to take. Repeated rows count each.

    Other columns are kept; an empty table gives an empty result.
    """
    return mixing.mixed(docs)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents (null text: empty) in sequences; repeated rows are packed each, other columns left out. No rows for none."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("near_duplicates", distinct_documents),
    ("secrets", masked_documents),
    ("mixing", mixed_documents),
    ("packing", packed_documents),
]

#: Classifier, links and tokens can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
