"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by hash and laid end to end; the stream is read up to three
times and cut into blocks of equal tokens. Slot t of the mix takes the golden-ratio point of t,
which falls into one source's part of the cumulative weights; the k-th slot of a source gets
its k-th block. Any stretch of slots so holds every source near its weight, and the mixed documents
are delivered in the order of their slots. DataFrame functions only; ``mix`` moves no text, only
ids and sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.runtime import WORD, columns_of, quoted
from tracewell.shared import ranged, running, written

BLOCK = 256
CAP = 3
#: The golden ratio's fraction of 2^32, and the parts into which points are dealt.
GOLDEN, POINTS, CELL = 2654435769, 1 << 32, 1 << 20
#: Slots that are counted together.
BUCKET = 4096


def sized(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """row, doc_id, source, mark (a hash of the text) and size: the number of words (null text: 0)."""
    row = F.monotonically_increasing_id() if row is None else row
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(row.cast("long").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("mark"), words.alias("size"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source: number (by code point, null last), source_size, target and the words to take.

    Weights are 1, 2, 3, repeating. The level L solves sum(min(3 * size, L * weight)) = total: in order of
    3 * size / weight, it is found at the first source that its level, with all before it at their caps, doesn't
    exceed. The table has a row per source, and is all that meets in one task.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sums.withColumn("number", F.row_number().over(by_name)).withColumn("weight", ((F.col("number") - 1) % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(CAP)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before, rest, all_ = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    found = weighted.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "number", "level"))).over(all_)["level"])
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return found.withColumn("target", target).withColumn("take", F.least(F.floor(F.col("target") + 0.5), (F.col("source_size") * CAP))).select("source", "number", "source_size", "target", "take")


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, number, rank): the source of each slot of the mix, and which of the source's blocks it takes."""
    spark = targets.sparkSession
    needs = targets.where("take > 0").select("number", F.expr(f"(take + {block - 1}) div {block}").alias("blocks"))
    total = needs.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")).first()["n"]
    below = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    share = F.lit(float(POINTS)) / F.lit(float(max(1, total)))
    edges = needs.withColumn("low", F.floor(F.coalesce(F.sum("blocks").over(below), F.lit(0)) * share)).withColumn("high", F.floor((F.coalesce(F.sum("blocks").over(below), F.lit(0)) + F.col("blocks")) * share))
    # a source's part in cells of equal width: at most 4096 rows and one for each source
    parts = edges.where("high > low").withColumn("cell", F.explode(F.expr(f"sequence(low div {CELL}, (high - 1) div {CELL})")))
    slots = spark.range(total).select(F.col("id").alias("slot"), (F.col("id").bitwiseAND(0x7FFFFFFF) * F.lit(GOLDEN)).bitwiseAND(POINTS - 1).alias("point"))
    slots = slots.withColumn("cell", F.expr(f"point div {CELL}")).join(parts, "cell").where("point >= low and point < high").select("slot", "number", "blocks")
    ranked = running(slots.withColumn("part", F.expr(f"slot div {BUCKET}")), ["number"], "part", [F.col("slot")], F.lit(1).cast("long"), "rank")
    dealt = ranked.where("rank < blocks").select("slot", "number", "rank")
    # a source's number of points misses its number of blocks by a few; those slots come last
    have = ranked.groupBy("number").agg(F.count(F.lit(1)).alias("have"))
    late = needs.join(have, "number", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < blocks").select("number", F.explode(F.expr("sequence(have, blocks - 1)")).alias("rank"))
    return dealt.unionByName(late.select((F.lit(total) + F.row_number().over(Window.orderBy("number", "rank"))).cast("long").alias("slot"), "number", "rank"))


def _placed(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows with size > 0 and where they begin in the shuffled stream of their source."""
    named = targets.where("take > 0").select(F.col("source").alias("_source"), "number", "take", F.col("source_size").alias("length"))
    numbered = sizes.where("size > 0").join(named, F.col("source").eqNullSafe(F.col("_source"))).select("row", "size", "number", "take", "length", F.xxhash64("doc_id", "mark", "number").alias("place"))
    dealt = ranged(numbered, ["number", "place"], "ranged")
    return running(dealt, ["number"], "part", [F.col("place"), F.col("row")], F.col("size"), "begin")


def pieces(placed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix: (slot, row, lap, size, first, words), words ``first`` onwards of a document's ``lap``-th copy in a slot."""
    laps = placed.withColumn("lap", F.explode(F.expr("sequence(0L, (take - 1) div length)"))).withColumn("low", F.col("lap") * F.col("length") + F.col("begin"))
    laps = laps.withColumn("high", F.least(F.col("low") + F.col("size"), F.col("take"))).where("low < high")
    cut = laps.withColumn("rank", F.explode(F.expr(f"sequence(low div {block}, (high - 1) div {block})")))
    start, end = F.greatest("low", F.col("rank") * block), F.least("high", (F.col("rank") + 1) * block)
    return cut.join(slots, ["number", "rank"]).select("slot", "row", "lap", "size", (start - F.col("low")).alias("first"), (end - start).alias("words"))


def _mixed_pieces(docs: DataFrame, block: int, row: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes = written(sized(docs, row), "sizes")
    targets = written(source_targets(sizes), "targets")
    return sizes, targets, pieces(written(_placed(sizes, targets), "placed"), schedule(targets, block), block)


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target (of its source), taken (the words that the mix takes), first_slot and slots.

    ``first_slot`` is the slot of the schedule where the document first appears, null if nothing of it is taken, and ``slots``
    how many slots hold words of it, counted for each copy. Texts that are null or without words have size 0 and give nothing; a null source is a
    source, last in order. A source's taken words are its target, rounded. The shuffle goes by doc_id and text; rows equal in
    both, repeated rows, are documents of their own. Other columns are ignored; an empty table gives an empty result.
    """
    sizes, targets, parts = _mixed_pieces(docs, block)
    taken = parts.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("slots"))
    named = targets.select(F.col("source").alias("_source"), "source_size", "target")
    every = sizes.join(named, F.col("source").eqNullSafe(F.col("_source"))).join(taken, "row", "left")
    none = F.lit(0).cast("long")
    return every.select("doc_id", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), "first_slot", F.coalesce("slots", none).alias("slots"))


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mixed documents in the order of the schedule: a copy of a document stands where its first word has its slot.

    Each whole text as often as it is taken whole, and the first words of one taken in part. Columns as in ``docs``; n_chars
    follows a text that is cut. Words of a cut text are joined by single spaces. Texts that are null, empty or without words are
    not taken. Repeated rows are taken each for itself. An empty table gives an empty result.
    """
    names = docs.columns
    # a stored number for each row, so that both its uses agree whatever ``docs`` is
    rows = written(docs.select(F.struct(*columns_of(docs)).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    _, _, parts = _mixed_pieces(rows.select("doc.doc_id", "doc.source", "doc.text", "row"), block, F.col("row"))
    copies = parts.groupBy("row", "lap", "size").agg(F.sum("words").alias("keep"), F.min(F.struct("slot", "first")).alias("at"))
    joined = rows.join(copies, "row").orderBy("at.slot", "row", "lap")
    whole = F.col("keep") == F.col("size")
    part = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("keep").cast("int")), " ")
    text = F.when(whole, F.col("doc.text")).otherwise(part)
    changed = {"text": text, "n_chars": F.when(whole, F.col("doc.n_chars")).otherwise(F.length(text).cast("long")) if "n_chars" in names else None}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(f"doc.{quoted(c)}").alias(c) for c in names])
