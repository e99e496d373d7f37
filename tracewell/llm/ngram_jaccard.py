"""N-gram Jaccard join: rare-first prefix filtering over word shingles.

1. Every task hashes the shingles of its documents and sends one packed array per
   hash bucket; a shingle that several documents of a chunk hold travels once, so a line
   that a third of the corpus repeats costs one entry a chunk.
2. A bucket counts its shingles and answers each chunk with those that occur elsewhere
   too. Only they can ever be common to two documents.
3. A document whose shared shingles are fewer than the threshold part of its set has no
   partner. Equal sets become one class; a class sends the first shingles of its rare-first
   order (its own unshared ones come first and need no row).
4. Classes that meet in a prefix pass length, positional and suffix filters and are
   verified once. Each shingle's members are first compared with one leader; afterwards
   only pairs of different components remain, so a group of g near copies needs
   g comparisons, not g * g.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import kernels
from tracewell.llm.runtime import ship
from tracewell.operators.components import connected_components
from tracewell.shared import written

CHUNK_BYTES = 8 << 20
CHUNK_DOCS = 60_000
CHUNK_CLASSES = 5000
MANY = 0xFFFF
#: 256 buckets at least, and one for about 1,024 documents or classes; 16 bits of a 64-bit entry number a chunk's documents.
FEWEST_BITS, MOST_BITS, ROWS_A_BUCKET = 8, 16, 1024
HEADER, LISTS, SINGLE, SEVERAL = 0, 1, 2, 3
PACKED = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
PACKED_DDL = "key long, chunk long, kind int, blob binary"
SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.string()), ("shared", pa.list_(pa.int64())), ("shape", pa.list_(pa.int32()))])
SETS_DDL = "doc_id long, n_shingles long, set_key string, shared array<long>, shape array<int>"
#: Parts of the suffix filter: shared shingles are counted by this many hash ranges.
PARTS = 16
#: Parts that the classes of one prefix shingle are dealt to where all pairs are wanted.
SALTS = 8


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PACKED.types, strict=True)], schema=PACKED)


def _chunk_rows(ids: list[int | None], sets: list[np.ndarray], n: np.ndarray, keys: bytes, chunk: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A chunk's header, its tokens by bucket, and which documents hold a token that several have."""
    known = np.array([i is not None for i in ids], dtype=np.uint8)
    header = np.array([i or 0 for i in ids], dtype=np.int64).tobytes() + n.tobytes() + known.tobytes() + keys
    own = -1 - chunk
    rows = [(own, chunk, HEADER, header)]
    all_h = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    doc = np.repeat(np.arange(len(sets), dtype=np.uint64), [len(s) for s in sets])
    order = np.argsort(all_h, kind="stable")
    token, doc = all_h[order] & ~np.uint64((1 << (16 - bits)) - 1), doc[order]
    if len(token):
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(first, append=len(token))
        several = count > 1
        if several.any():
            where = np.repeat(several, count)
            lists = np.concatenate([np.array([several.sum()], np.uint64), token[first[several]], count[several].astype(np.uint64)])
            rows.append((own, chunk, LISTS, lists.tobytes() + doc[where].astype(np.uint16).tobytes()))
        bucket = (token[first] >> np.uint64(64 - bits)).astype(np.int64)
        rest = (token[first] << np.uint64(bits)) & ~np.uint64(MANY)
        for kind, pick in ((SINGLE, ~several), (SEVERAL, several)):
            b, e = bucket[pick], rest[pick]
            e = e | doc[first[pick]] if kind == SINGLE else np.stack([e | np.uint64(MANY), count[pick].astype(np.uint64)], axis=1)
            edges = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, dtype=np.int64)
            for at, end in zip(edges.tolist(), [*edges[1:].tolist(), len(b)], strict=False):
                rows.append((int(b[at]), chunk, kind, e[at:end].tobytes()))
                if len(rows) >= 512:
                    yield _batch(rows)
                    rows = []
    if rows:
        yield _batch(rows)


def _first_chunk() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 24


def _map_texts(bits: int, shingle: int):
    def chunk_rows(ids: list[int | None], texts: list[bytes], chunk: int) -> Iterator[pa.RecordBatch]:
        sets = kernels.shingle_sets(texts, shingle)
        keys = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
        return _chunk_rows(ids, sets, np.array([len(s) for s in sets], dtype=np.int64), keys, chunk, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _first_chunk()
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size >= CHUNK_BYTES or len(ids) >= CHUNK_DOCS:
                    yield from chunk_rows(ids, texts, chunk)
                    chunk, ids, texts, size = chunk + 1, [], [], 0
        if ids:
            yield from chunk_rows(ids, texts, chunk)

    return run


def _map_classes(bits: int):
    """The same for classes: rows of (set_key, n, shared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = _first_chunk()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_CLASSES):
                part = batch.slice(at, CHUNK_CLASSES)
                sets = [np.sort(s.values.to_numpy().view(np.uint64)) for s in part.column(2)]
                keys = b"".join(map(bytes.fromhex, part.column(0).to_pylist()))
                yield from _chunk_rows([None] * len(sets), sets, part.column(1).to_numpy().astype(np.int64), keys, chunk, bits)
                chunk += 1

    return run


def _count_bucket(bits: int):
    """One bucket: answer each chunk with its shingles that more than one document holds."""

    def run(group: pa.Table) -> pa.Table:
        key = group.column("key")[0].as_py()
        if key < 0:
            return group
        entries, counts, chunks = [], [], []
        for chunk, kind, blob in zip(group.column("chunk").to_pylist(), group.column("kind").to_pylist(), group.column("blob"), strict=True):
            e = np.frombuffer(blob.as_buffer(), dtype=np.uint64)
            if kind == SEVERAL:
                counts.append(e[1::2])
                e = e[0::2]
            else:
                counts.append(np.ones(len(e), dtype=np.uint64))
            entries.append(e)
            chunks.append(np.full(len(e), chunk, dtype=np.int64))
        e, c, k = np.concatenate(entries), np.concatenate(counts), np.concatenate(chunks)
        order = np.argsort(e >> np.uint64(16), kind="stable")
        e, c, k = e[order], c[order], k[order]
        rest = e >> np.uint64(16)
        new = np.concatenate([[True], rest[1:] != rest[:-1]])
        group_of = np.cumsum(new) - 1
        df = np.add.reduceat(c, np.flatnonzero(new))[group_of]
        keep = df > 1
        e, df, k = e[keep], np.minimum(df[keep], 0xFFFF), k[keep]
        token = (np.uint64(key) << np.uint64(64 - bits)) | ((e & ~np.uint64(MANY)) >> np.uint64(bits))
        order = np.argsort(k, kind="stable")
        token, df, k, doc = token[order], df[order].astype(np.uint16), k[order], (e[order] & np.uint64(MANY)).astype(np.uint16)
        edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)
        rows = [(key, int(k[a]), SINGLE, token[a:b].tobytes() + df[a:b].tobytes() + doc[a:b].tobytes()) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(k)], strict=False)]
        return pa.Table.from_batches([_batch(rows)] if rows else [], schema=PACKED)

    return run


def _assemble(percent: int):
    """One chunk: each document's size and, where it can have a partner, its shared shingles rare-first."""

    def run(group: pa.Table) -> pa.Table:
        ids = n = known = keys = None
        listed: dict[int, np.ndarray] = {}
        tokens, dfs, docs = [], [], []
        for kind, blob in zip(group.column("kind").to_pylist(), group.column("blob").to_pylist(), strict=True):
            if kind == HEADER:
                m = len(blob) // 33
                ids, n = np.frombuffer(blob, np.int64, m), np.frombuffer(blob, np.int64, m, 8 * m)
                known, keys = np.frombuffer(blob, np.uint8, m, 16 * m), blob[17 * m :]
            elif kind == LISTS:
                m = int(np.frombuffer(blob, np.uint64, 1)[0])
                names, count = np.frombuffer(blob, np.uint64, m, 8), np.frombuffer(blob, np.uint64, m, 8 + 8 * m).astype(np.int64)
                listed = dict(zip(names.tolist(), np.split(np.frombuffer(blob, np.uint16, -1, 8 + 16 * m), np.cumsum(count)[:-1]), strict=True))
            else:
                m = len(blob) // 12
                tokens.append(np.frombuffer(blob, np.uint64, m))
                dfs.append(np.frombuffer(blob, np.uint16, m, 8 * m))
                docs.append(np.frombuffer(blob, np.uint16, m, 10 * m))
        if tokens:
            token, df, doc = np.concatenate(tokens), np.concatenate(dfs), np.concatenate(docs)
            many = doc == MANY
            at = [listed[t] for t in token[many].tolist()]
            size = [len(x) for x in at]
            token = np.concatenate([token[~many], np.repeat(token[many], size)])
            df = np.concatenate([df[~many], np.repeat(df[many], size)])
            doc = np.concatenate([doc[~many], *at])
        else:
            token, df, doc = np.zeros(0, np.uint64), np.zeros(0, np.uint16), np.zeros(0, np.uint16)
        shared = np.bincount(doc, minlength=len(ids))
        able = (n > 0) & (100 * shared >= percent * n)
        keep = able[doc]
        token, df, doc = token[keep], df[keep], doc[keep]
        order = np.lexsort((token, df, doc))
        shape = np.bincount(doc.astype(np.int64) * PARTS + (token >> np.uint64(60)).astype(np.int64), minlength=PARTS * len(ids))
        token = token[order].view(np.int64)
        ends = np.cumsum(np.where(able, shared, 0))
        return pa.table(
            [
                pa.array(ids, mask=known == 0),
                pa.array(n),
                pa.array([keys[16 * i : 16 * i + 16].hex() for i in range(len(ids))]),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(token)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, shape.size + 1, PARTS), pa.int32()), pa.array(shape.astype(np.int32))),
            ],
            schema=SETS,
        )

    return run


def _counted(packed: DataFrame, bits: int, percent: int) -> DataFrame:
    answered = packed.groupBy("key").applyInArrow(_count_bucket(bits), PACKED_DDL)
    return answered.groupBy("chunk").applyInArrow(_assemble(percent), SETS_DDL)


def _bits(rows: DataFrame) -> int:
    """Bits of a shingle's hash that name its bucket's task, by the number of rows; 48 more tell shingles apart within a bucket."""
    return min(MOST_BITS, max(FEWEST_BITS, (rows.count() // ROWS_A_BUCKET).bit_length()))


def shingle_table(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """Per document: set size, a key of its set, and its shared shingles (rare first) if it can have a partner.

    ``docs`` is a stored table or a projection of one: its rows are numbered by their place in a task, so a lost task must find
    them in the same order when it runs again. Pass anything else through ``runtime.written`` first.
    """
    ship(docs.sparkSession)
    bits = _bits(docs)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _counted(source.mapInArrow(_map_texts(bits, shingle), PACKED_DDL), bits, percent)


def class_table(sets: DataFrame, percent: int = 80) -> DataFrame:
    """Equal sets as one class, counted again: what only copies of one set share leaves, and most classes with it."""
    bits = _bits(sets)
    classes = sets.where("n_shingles > 0 and size(shared) > 0").groupBy("set_key").agg(F.first("n_shingles").alias("n"), F.first("shared").alias("shared"))
    # answers name classes by their place in a task's rows, which a task that is run again must repeat
    classes = classes.sortWithinPartitions("set_key")
    counted = _counted(classes.mapInArrow(_map_classes(bits), PACKED_DDL), bits, percent)
    return counted.where("size(shared) > 0").select("set_key", F.col("n_shingles").alias("n"), "shared", "shape")


def _checked(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Verify each pair (a, b) once. Filters come first, by cheap columns; then the sets are intersected."""
    small = classes.select("set_key", "n", "shape")
    sized = (
        pairs.join(small.select(F.col("set_key").alias("a"), F.col("n").alias("na"), F.col("shape").alias("sa")), "a")
        .join(small.select(F.col("set_key").alias("b"), F.col("n").alias("nb"), F.col("shape").alias("sb")), "b")
        .where(F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
        .select("a", "b", "na", "nb")
    )
    sets = classes.select("set_key", "shared")
    both = sized.join(sets.select(F.col("set_key").alias("a"), F.col("shared").alias("ta")), "a").join(sets.select(F.col("set_key").alias("b"), F.col("shared").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb")).cast("long")
    return both.select("a", "b", (common * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).alias("linked"))


def _met(a: DataFrame, b: DataFrame, percent: int, on_labels) -> DataFrame:
    """Distinct pairs of prefix rows of one shingle that pass the length and positional filters."""
    left = a.select("token", F.col("set_key").alias("ka"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("label").alias("la"))
    right = b.select("token", F.col("set_key").alias("kb"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("label").alias("lb"))
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    total = (F.col("na") + F.col("nb")) * percent
    return (
        left.join(right, "token")
        .where(on_labels(F.col("la"), F.col("lb")) & (F.col("ka") != F.col("kb")))
        .where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
        # the first common shingle has most behind it, and none before it is common: a pair that can be alike passes there
        .where(rest * (100 + percent) >= total)
        .select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
        .distinct()
    )


def _strangers(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows of one shingle under different labels, without meeting the pairs of the commonest label of a shingle.

    A passage that a large linked group holds has that group's label; its few rows of other labels meet all rows, the group's
    own rows only them.
    """
    # ``rows`` come dealt by shingle, and all that follows keeps to that: the shuffle of them is used again, not repeated
    counts = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("rows"))
    common = counts.groupBy("token").agg(F.max_by("label", F.struct("rows", "label")).alias("common"))
    both = rows.join(common, "token").select(*rows.columns, (F.col("label") == F.col("common")).alias("of_common"))
    few, many = both.where("not of_common"), both.where("of_common")
    return _met(few, few, percent, lambda x, y: x < y).union(_met(few, many, percent, lambda x, y: x != y)).distinct()


def linked_classes(classes: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    """Components of the classes whose sets are at least percent / 100 alike: (set_key, component).

    ``classes``: set_key, n (set size), shared (members that other sets may hold), shape (counts of them
    by hash range). ``prefix``: token, set_key, n, unshared (members that no other
    set holds), pos (place in the rare-first order of the whole set).
    """
    labels: DataFrame | None = None
    links: DataFrame | None = None
    verified: DataFrame | None = None
    for step in ("leaders", "rest"):
        rows = prefix.withColumn("label", F.col("set_key")) if labels is None else prefix.join(labels, "set_key", "left").withColumn("label", F.coalesce("component", "set_key"))
        # the leader is the class with the fewest shingles of its own: the text that others are edits of
        leader = F.min(F.struct("unshared", "set_key", "n", "pos", "label")).alias("leader")
        spread = rows.groupBy("token").agg(leader, F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        if step == "rest":
            pairs = _strangers(rows.join(spread.select("token"), "token", "left_semi"), percent)
        else:
            leaders = spread.select("token", "leader.*")
            pairs = _met(leaders, rows, percent, lambda x, y: x != y)
        if verified is not None:
            pairs = pairs.join(verified, ["a", "b"], "left_anti")
        checked = written(_checked(pairs, classes, percent), "shingle-pairs")
        verified = checked.select("a", "b") if verified is None else verified.unionByName(checked.select("a", "b"))
        new = checked.where("linked").select("a", "b")
        links = new if links is None else links.unionByName(new)
        labels = connected_components(links)
    return labels


def _prepared(docs: DataFrame, percent: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shingle sets by document, classes of equal sets that can have partners, and the prefixes of those."""
    sets = written(shingle_table(docs, percent, shingle), "shingle-sets")
    classes = written(class_table(sets, percent), "shingle-classes")
    prefix = written(
        classes.select("set_key", "n", F.size("shared").cast("long").alias("m"), F.posexplode(F.expr(f"slice(shared, 1, int(size(shared) - (n * {percent} + 99) div 100 + 1))")).alias("p", "token"))
        .select("token", "set_key", "n", (F.col("n") - F.col("m")).alias("unshared"), (F.col("n") - F.col("m") + F.col("p")).alias("pos")),
        "shingle-prefixes",
    )
    return sets, classes, prefix


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """Link documents whose shingle sets have Jaccard likeness of at least percent / 100; group by links.

    Returns per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id that links
    reach). Null or empty texts have no shingles and stay alone; rows with a null doc_id are
    kept and get the smallest doc_id that they reach, or null. Repeated rows each return.
    An empty table gives an empty result. Other columns of ``docs`` are ignored.
    """
    return _grouped(*_prepared(docs, percent, shingle), percent)


def _grouped(sets: DataFrame, classes: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    # tables of a row per linked class or component: both joins are then of plain scans, whose hot keys Spark can split
    labels = written(linked_classes(classes, prefix, percent), "class-labels")
    named = sets.select("doc_id", "n_shingles", "set_key").join(labels, "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    members = named.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members"))
    smallest = written(members.where("members > 1").select("component", "least"), "smallest")
    return named.join(smallest, (named.component == smallest.component) & (named.n_shingles > 0), "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def class_links(classes: DataFrame, prefix: DataFrame, percent: int) -> DataFrame:
    """Every pair (a, b), a < b, of classes that are at least percent / 100 alike, whether or not a component joins them already.

    The classes of a prefix shingle are dealt to ``SALTS`` parts, and each part meets all of them, so that a
    shingle of many classes is many tasks' work. g near copies are g * (g - 1) / 2 pairs.
    """
    salts = F.explode(F.array(*map(F.lit, range(SALTS))))
    rows = prefix.select("token", "set_key", "n", "pos", F.col("set_key").alias("label"))
    keyed = [rows.withColumn("salt", salt).withColumn("token", F.concat_ws(":", "token", "salt")) for salt in (F.pmod(F.xxhash64("set_key"), F.lit(SALTS)), salts)]
    return _checked(_met(*keyed, percent, lambda x, y: x < y), classes, percent).where("linked").select("a", "b")


def near_pairs(docs: DataFrame, percent: int = 80, shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """All links: (a, b) between classes of equal shingle sets, and membership (doc_id, n_shingles, set_key).

    Two documents are linked if they share a class or their classes are a pair. Documents without shingles are linked with none.
    """
    sets, classes, prefix = _prepared(docs, percent, shingle)
    return written(class_links(classes, prefix, percent), "class-links"), sets.select("doc_id", "n_shingles", "set_key")


def link_counts(docs: DataFrame, percent: int = 80, shingle: int = 5) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and n_links, how many other rows it is linked with."""
    pairs, members = near_pairs(docs, percent, shingle)
    sizes = written(members.where("n_shingles > 0").groupBy("set_key").agg(F.count(F.lit(1)).alias("members")), "class-sizes")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    beyond = both.join(sizes, both.b == sizes.set_key).groupBy("a").agg(F.sum("members").alias("beyond"))
    counts = written(sizes.join(beyond, sizes.set_key == beyond.a, "left").select("set_key", (F.col("members") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links")).where("n_links > 0"), "link-counts")
    linked = F.when(F.col("n_shingles") > 0, F.col("n_links"))
    return members.join(counts, "set_key", "left").select("doc_id", "n_shingles", F.coalesce(linked, F.lit(0)).cast("long").alias("n_links"))


#: The rows of ``near_duplicates`` on ``documents``, by comparing all sets that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS t FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY ALL) m USING (doc_id)
"""

#: The rows of ``link_counts`` on ``documents``.
LINKS_ORACLE = (
    ORACLE[: ORACLE.index(",\nr(a, b)")].replace("WITH RECURSIVE", "WITH")
    + " SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(k.n_links, 0) AS n_links FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY ALL) k USING (doc_id)"
)
