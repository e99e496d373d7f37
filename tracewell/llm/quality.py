"""Compression classifier: which of two zstandard dictionaries, of good or of bad text, shortens a text more.

Every text is compressed from end to end, in equal blocks that each start afresh with the dictionary: the history
of a long text would drown it. The evidence is the normalised size difference alone: (bad - good) / max(bad, good) of
each block, and of a text's blocks the lower quartile, so that junk within a text counts though most of it is good.
Dictionaries are trained on one half of a bounded sample of labelled rows; on the other half an isotonic regression
makes the difference a score, the share of good labels among texts of about that difference.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tracewell.llm.runtime import columns_of, crc_fold, quoted, ship
from tracewell.shared import written

#: Bytes of a block, at most.
BLOCK = 500
#: Of the differences of a text's blocks, the one that speaks for it.
QUARTILE = 0.25
#: Bounds of the sample that the model is fitted on, for each label: rows, and blocks of them (from anywhere in
#: the texts, those of least hash) for a dictionary. Sampled texts take part whole in the calibration.
SAMPLE_ROWS, SAMPLE_BLOCKS = 3000, 16_000
DICTIONARY_BYTES, LEVEL = 110_000, 3
FEWEST = 16
SCORED = "doc_id long, score double, good_bytes long, bad_bytes long"


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    #: The calibration: scores at ascending differences, linear between them.
    at: tuple[float, ...]
    scores: tuple[float, ...]
    prior: float

    def compressors(self) -> list[zstandard.ZstdCompressor] | None:
        return [_compressor(self.good), _compressor(self.bad)] if self.good else None


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def _blocks(raw: bytes) -> list[bytes]:
    n = max(1, -(-len(raw) // BLOCK))
    return [raw[i * len(raw) // n : (i + 1) * len(raw) // n] for i in range(n)]


def _measure(both: list[zstandard.ZstdCompressor], raw: bytes) -> tuple[int, int, float]:
    """Compressed sizes by the good and by the bad dictionary, and the normalised difference of the text."""
    sizes = [tuple(len(c.compress(b)) for c in both) for b in _blocks(raw)]
    parts = sorted((bad - good) / max(good, bad) for good, bad in sizes)
    place = QUARTILE * (len(parts) - 1)
    low = int(place)
    difference = parts[low] + (parts[min(low + 1, len(parts) - 1)] - parts[low]) * (place - low)
    return sum(g for g, _ in sizes), sum(b for _, b in sizes), difference


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(batch.column(1)):
            blocks = _blocks(text.as_buffer().to_pybytes())
            for at in range(0, len(blocks), 4096):
                part = blocks[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(part), pa.int32()), pa.array(part, pa.binary())], names=["quality", "block"])


def _measured(good: bytes, bad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [_compressor(good), _compressor(bad)]
        for batch in batches:
            found = [_measure(both, t.as_buffer().to_pybytes())[2] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["doc_id", "quality", "difference"])

    return run


def _calibrated(rows: list[tuple[float, int]]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Isotonic regression of (difference, label): the ends and the mean label of each pool of neighbours, in order."""
    pools: list[list[float]] = []
    for difference, label in sorted(rows):
        pools.append([difference, difference, label, 1])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, high, labels, n = pools.pop()
            pools[-1][1:] = [high, pools[-1][2] + labels, pools[-1][3] + n]
    return tuple(x for low, high, _, _ in pools for x in (low, high)), tuple(y for _, _, labels, n in pools for y in (labels / n,) * 2)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled rows outside fold 0: of each label the ``sample_rows`` ids of least hash."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_fold(F.col("doc_id"), folds) != 0)).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("quality = 0").orderBy(*order).limit(sample_rows).union(known.where("quality = 1").orderBy(*order).limit(sample_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0)
    # the sample has at most 2 * sample_rows ids, so it can be broadcast; whole texts stay in the shared folder
    sample = written(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text"), "labelled-texts")
    found = sorted((r.quality, r.doc_id) for r in sample.select("doc_id", "quality").distinct().collect())
    half = {q: [i for label, i in found if label == q] for q in (0, 1)}
    prior = len(half[1]) / len(found) if found else 0.5
    none = Model(b"", b"", (), (), prior)
    if min(map(len, half.values())) < FEWEST:
        return none
    part = F.broadcast(spark.createDataFrame([(i, q, n % 2) for q in (0, 1) for n, i in enumerate(half[q])], "doc_id long, quality int, part int"))
    halves = sample.join(part, ["doc_id", "quality"])
    cut = halves.where("part = 0").select("quality", "text").mapInArrow(_cut, "quality int, block binary")
    books = []
    for q in (1, 0):
        blocks = cut.where(F.col("quality") == q).orderBy(F.xxhash64("block"), "block").limit(SAMPLE_BLOCKS).collect()
        try:
            books.append(zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r.block) for r in blocks]).as_bytes())
        except zstandard.ZstdError:
            return none  # too little text for a dictionary
    measured = halves.where("part = 1").select("doc_id", "quality", "text").mapInArrow(_measured(*books), "doc_id long, quality int, difference double")
    # an id whose rows differ counts once, as at most sample_rows rows of a label may reach the driver
    rows = measured.groupBy("doc_id", "quality").agg(F.min("difference").alias("difference")).collect()
    return Model(*books, *_calibrated([(r.difference, r.quality) for r in rows]), prior)


def _score(model: Model, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = model.compressors()
        for batch in batches:
            scores, goods, bads = [], [], []
            for text in batch.column(batch.num_columns - 1):
                good, bad, difference = _measure(both, text.as_buffer().to_pybytes() if text.is_valid else b"") if both else (0, 0, 0.0)
                goods.append(good)
                bads.append(bad)
                scores.append(float(np.interp(difference, model.at, model.scores)) if both else model.prior)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carry))), pa.array(scores, pa.float64()), pa.array(goods, pa.int64()), pa.array(bads, pa.int64())], names=[*carry, "score", "good_bytes", "bad_bytes"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, score in [0, 1] (higher: good likelier) and both compressed sizes.

    Null texts score as empty ones. Without enough labels of both kinds every text gets the share of
    good labels. Other columns are ignored; repeated rows each return.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(_score(model, ["doc_id"]), SCORED)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out (its label takes no part in the fit), score and predicted.

    Null and empty texts are scored as an empty text; a null doc_id is not held out and has no label; repeated rows each
    return; a score equal to ``threshold`` predicts 1. An empty table gives an empty result. Other columns are ignored.
    """
    scored = score(docs, fit(docs, labels, folds))
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns as they are, whatever their names.

    Null and empty texts are scored as an empty text; repeated rows stay or go together; a score equal to ``threshold`` stays.

    Where no model can be fitted, for want of labels or text, nothing is known of any row: all stay, with a warning.
    """
    ship(docs.sparkSession)
    model = fit(docs, labels, folds)
    if not model.good:
        warnings.warn("quality: no model could be fitted, so all documents are kept", stacklevel=2)
        return docs
    held = docs.select(F.struct(*columns_of(docs)).alias("row"), F.col("text").cast("string").alias("text"))
    schema = StructType([held.schema["row"], StructField("score", DoubleType()), StructField("good_bytes", LongType()), StructField("bad_bytes", LongType())])
    return held.mapInArrow(_score(model, ["row"]), schema).where(F.col("score") >= threshold).select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])
