"""SpotSigs fingerprints with DataFrame functions only.

Common words of prose are anchors; each anchor and the next three content words behind it form a
chain, and a document's fingerprint is its set of chains. Page furniture has few anchors, prose
many, so the set follows the prose. Sets are compared by Jaccard likeness, which the sizes bound:
documents are partitioned by set size so that near ones are in one partition or in neighbouring ones, only
these meet, and a pair is dropped as soon as its sizes or the chains that are left rule it out.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.ngram_jaccard import linked_classes
from tracewell.shared import width, written

#: The commonest words of English, German, French and Spanish.
ANCHORS = (
    "the of to and a in is it that was for on are as with be at by this have from or not an "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de et un une du que est pour qui dans par pas au sur "
    "el los las y en se del por con no su para es al lo como"
).split()
CHAIN = 3
MARK = "\u0001"
#: Ranges of neighbours that a shuffle partition gets, and ranges at most: their lower ends pass the driver.
RANGES, MOST_RANGES = 4, 16_384
#: Likeness, in hundredths, from which documents are near.
NEAR = 80


def with_chains(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the sorted distinct 64-bit hashes of the chains of the column ``text``.

    A text without an anchor chain is taken by all chains of its words, one of fewer words than a chain by
    its words, one without a letter or digit as it is. An empty text has none. Columns are added step by
    step, so that no pattern runs twice over a text, and no pattern repeats a group, however long a text is.
    """
    rows = rows.withColumn("_words", F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" ")))
    marked = F.regexp_replace(F.regexp_replace("_words", f"(?<= )(?:{'|'.join(ANCHORS)}) ", MARK), f"{MARK}+", MARK)
    link = " ".join([f"{MARK}?[^ {MARK}]+"] * CHAIN)
    rows = rows.withColumn("_spots", F.regexp_extract_all(marked, F.lit(f"{MARK}(?=({link}))"), F.lit(1)))
    every = F.regexp_extract_all("_words", F.lit(f" (?=({link}))"), F.lit(1))
    words = F.trim("_words")
    short = F.when(words != "", F.array(words)).when(F.col(text) != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("_spots", F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(every))
    found = F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(short)
    return rows.withColumn(out, F.array_sort(F.array_distinct(F.transform(found, lambda c: F.xxhash64(F.translate(c, MARK, "")))))).drop("_words", "_spots")


def fingerprint(sets: Column) -> Column:
    return F.array_join(F.transform(sets, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets; two empty ones are alike."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(large == 0, F.lit(1.0)).when(small == 0, F.lit(0.0)).otherwise(common / (small + large - common))


def size_partition(n: Column, percent: int = NEAR) -> Column:
    """Number of the size partition: sets that are percent / 100 alike are in the same or in neighbouring ones."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / -F.log(F.lit(percent / 100)))).otherwise(F.lit(-1)).cast("int")


def near(a: Column, b: Column, percent: int = NEAR) -> Column:
    """Whether two sets are percent / 100 alike: ruled out by their size partitions, then by their sizes, before any chain is compared."""
    apart = F.abs(size_partition(F.size(a), percent) - size_partition(F.size(b), percent)) > 1
    bounded = F.least(F.size(a), F.size(b)) * 100 < F.greatest(F.size(a), F.size(b)) * percent
    return F.when(apart | bounded, F.lit(False)).otherwise(likeness(a, b) * 100 >= percent)


def _range_of(keys: DataFrame, key: Column) -> tuple[Column, int]:
    """Number of the range of ``key`` that a row is in, and how many there are: near-equal ranges that follow the keys' distribution.

    Only the lower ends, ``MOST_RANGES`` at most, reach the driver. They are looked up in two steps, among the first ends of
    groups and then within a group.
    """
    parts = min(MOST_RANGES, RANGES * width(keys.sparkSession))
    ends = keys.select(key.alias("key")).repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key")).collect()
    found = sorted(r["key"].asDict().items() for r in ends)
    side = max(1, math.isqrt(len(found)))
    groups = [[dict(k) for k in found[i : i + side]] for i in range(0, len(found), side)] or [[]]
    kind = "struct<known:boolean,id:bigint,mark:bigint>"
    constant = lambda value, depth: F.from_json(F.lit(json.dumps(value)), "array<" * depth + kind + ">" * depth)
    upto = lambda ends: F.greatest(F.size(F.filter(ends, lambda e: e <= key)), F.lit(1))
    group = upto(constant([g[0] for g in groups if g], 1))
    return (group - 1) * side + upto(F.element_at(constant(groups, 2), group)) - 1, max(1, len(found))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, own, next_text, next): each text with the next document's, in descending doc_id order, and the chains of both.

    Texts are dealt once to ranges of (doc_id, hash of the text) and ordered within their task; only one
    document of each range, the largest, travels to the next. Rows of one doc_id, or without any, are split by their texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("mark"))
    block, blocks = _range_of(rows, key)
    base = rows.withColumn("block", block.cast("long")).repartition("block")
    order = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    own = with_chains(base, "text", "own").withColumn("lower", F.lag(F.struct("text", "own")).over(order))
    # the last document of a range is before the first of the next, that of the last before the first of all; it is found
    # by a grouping of its own, in which each task sends one text for a range, so that the texts above move once
    greatest = rows.groupBy(block.cast("long").alias("block")).agg(F.max(F.struct(key.alias("key"), "text")).alias("last"))
    last = greatest.select(F.pmod(F.col("block") + 1, F.lit(blocks)).alias("block"), F.col("last.text").alias("carried"))
    carried = with_chains(last, "carried", "chains")
    joined = own.join(carried.select("block", F.struct(F.col("carried").alias("text"), F.col("chains").alias("own")).alias("carried")), "block", "left")
    lower = F.coalesce("lower", "carried")
    return joined.select("doc_id", "text", "own", lower["text"].alias("next_text"), lower["own"].alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text, whose last third the start of the next document replaces.

    Returns per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, size_class (the size
    partition of its set), and edited_is_near, next_is_near: whether they are near by the partitioned, pruned comparison.
    Null texts count as empty; rows with a null doc_id come last in order; rows of one doc_id, repeated or not, follow each other
    by a hash of their texts. Alone in the table, a document is its own next. An empty table gives an empty result. Other
    columns are ignored.
    """
    pairs = with_next(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.expr("int(n_chars div 3)"))
    edited = F.concat(F.expr("substring(text, 1, int(n_chars) - cut)"), F.expr("substring(next_text, 1, cut)"))
    texts = pairs.select("doc_id", "n_chars", "own", "next", edited.alias("edited"))
    sets = with_chains(texts, "edited", "other")
    return sets.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).cast("double").alias("near_edited"), likeness(F.col("own"), F.col("next")).cast("double").alias("near_next"),
        size_partition(F.size("own")).alias("size_class"), near(F.col("own"), F.col("other")).alias("edited_is_near"), near(F.col("own"), F.col("next")).alias("next_is_near"),
    )


def near_groups(docs: DataFrame, percent: int = NEAR) -> DataFrame:
    """(doc_id, component_id): documents whose fingerprints are at least percent / 100 alike, by links.

    Equal fingerprints are one class. A class looks among its rarest chains, so many that a near class must share one, for
    others of its own size partition and of the next: each stands under (chain, partition) in its own and in the one above, so
    neighbours meet once and others never. A pair is dropped when its sizes or the chains behind the shared one can't reach
    ``percent``, and else compared once.

    Null and empty texts have no chains and are near to none. Rows with a null doc_id get the least doc_id that they
    reach, or null; repeated rows each return. An empty table gives an empty result. Other columns are ignored.
    """
    own = with_chains(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), "text", "own")
    sets = written(own.select("doc_id", "own", F.md5(fingerprint(F.col("own"))).alias("set_key")), "spots")
    classes = sets.where(F.size("own") > 0).groupBy("set_key").agg(F.first("own").alias("own"))
    spread = classes.select("set_key", F.size("own").cast("long").alias("n"), F.explode("own").alias("token"))
    counts = spread.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = spread.join(counts, "token").groupBy("set_key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    tokens = F.transform("ranked", lambda x: x["token"])
    shape = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.size(F.filter("shared", lambda x: F.pmod(x, F.lit(16)) == i)))
    table = written(ranked.select("set_key", "n", tokens.alias("shared")).withColumn("shape", shape), "spot-classes")
    partition = size_partition(F.col("n"), percent)
    rarest = table.select("set_key", "n", F.posexplode(F.expr(f"slice(shared, 1, int(n - (n * {percent} + 99) div 100 + 1))")).alias("p", "chain"))
    placed = rarest.withColumn("partition", F.explode(F.array(partition, partition + 1)))
    prefix = written(placed.select(F.xxhash64("chain", "partition").alias("token"), "set_key", "n", F.lit(0).alias("unshared"), F.col("p").cast("long").alias("pos")), "spot-prefixes")
    labels = linked_classes(table, prefix, percent)
    named = sets.select("doc_id", "set_key", (F.size("own") > 0).alias("held")).join(labels, "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    least = named.where("held").groupBy("component").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component", "left").select("doc_id", F.when(F.col("held"), F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
