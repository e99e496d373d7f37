"""Exact substring removal by bucket-pointer refinement over sampled suffixes.

A byte goes if a ``length``-byte string over it also starts in a document with a smaller id.
Sorting every suffix of a corpus costs its size many times over; here sampled suffixes stand in buckets
that are refined only while they still hold different strings. A bucket is named by a hash of what its
suffixes share, so that any task can name the bucket of any offset of its own texts:

* Initial buckets: the q-gram at an offset. Each ``length``-byte window is entered at the least-hashed q-gram inside
  it. The choice depends on the window alone, so equal windows share a bucket. A run of neighbouring
  windows with one such q-gram is a single entry, about one for every 15 bytes.
* Refined names (``_names``): the bucket of 2q bytes at i is the pair of q-gram buckets at i and i + q, that of 4q bytes
  the pair of 2q buckets at i and i + 2q, and so on up to ``length``: each round reads the names that the one before gave to
  later offsets, never the text again. A run's stretch is named by the window buckets at its two ends.
* Round 1: within a q-gram bucket, entries are sorted by the names of their stretches and by document. One whose
  stretch starts in a smaller document is settled; so is a bucket with one stretch that no smaller document has.
* Round 2: only the first holders of each stretch in a still mixed bucket go on, sorted by window bucket and document. What a
  round settles is passed on and never looked at again.

Buckets receive at most a few entries of a q-gram from each chunk of
documents, so neither a passage that all documents share nor a large group of copies fills a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm import kernels
from tracewell.llm.runtime import ship

#: Long enough that few strings share one by chance, short enough that one entry stands for about 15 windows.
QGRAM = 20
CHUNK_DOCS = 700
#: Bytes of a chunk, about, however many documents they are: one Arrow group holds them.
CHUNK_BYTES = 16 << 20
#: Bytes that are sorted by chunk and compressed together.
PRESSED = 48 << 20
#: A bucket that has more extensions than this within a chunk is known to be mixed; one entry says so.
DIVERSE = 4
LAST = np.iinfo(np.int64).max
PACKED = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
PACKED_DDL = "key long, chunk long, kind int, blob binary"
NARROW, WIDE, SETTLED, PENDING, REPLY = 0, 1, 2, 3, 4
OUT = pa.schema([("doc_id", pa.int64()), ("copies", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])
OUT_DDL = "doc_id long, copies long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
U = np.uint64
PAIR = U(0x9E3779B97F4A7C15)
#: Bits of a q-gram's hash that name its bucket's task: 256 buckets at least, and one for about 1,024 documents.
FEWEST_BITS, MOST_BITS, DOCS_A_BUCKET = 8, 24, 1024


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    if not rows:
        return PACKED.empty_table()
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PACKED.types, strict=True)], schema=PACKED)


def _press():
    """Documents of a chunk as one compressed row per PRESSED bytes: the only time that texts are moved."""

    def pressed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        # a repeated row travels once from each task, with the number of its copies
        table = pa.Table.from_batches(held).group_by(["doc_id", "text", "chunk"]).aggregate([([], "count_all")]).rename_columns({"count_all": "copies"})
        chunk = table.column("chunk").to_numpy()
        order = np.argsort(chunk, kind="stable")
        edges = np.flatnonzero(np.diff(chunk[order], prepend=-1)).tolist()
        docs = table.select(["doc_id", "text", "copies"]).combine_chunks().take(pa.array(order))
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, docs.schema) as out:
                out.write_table(docs.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([chunk[order[a]]], pa.int64()), pa.array([press.compress(sink.getvalue())], pa.binary())], names=["chunk", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PRESSED:
                yield from pressed(held)
                held, size = [], 0
        if held:
            yield from pressed(held)

    return run


def _ordered(group: pa.Table) -> tuple[np.ndarray, list[bytes], list[tuple[int | None, int]]]:
    """Ids (null: last), texts as bytes, and the id with the number of copies of each, in an order that every pass repeats."""
    copies: dict[tuple[int | None, bytes], int] = {}
    for blob in group.column("docs"):
        docs = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob.as_buffer().to_pybytes())).read_all()
        for doc_id, text, n in zip(docs.column("doc_id").to_pylist(), docs.column("text"), docs.column("copies").to_pylist(), strict=True):
            key = doc_id, text.as_buffer().to_pybytes() if text.is_valid else b""
            copies[key] = copies.get(key, 0) + n
    rows = sorted(copies, key=lambda k: (k[0] is None, k[0] or 0, k[1]))
    return np.array([LAST if i is None else i for i, _ in rows], dtype=np.int64), [t for _, t in rows], [(k[0], copies[k]) for k in rows]


def _slices(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (document, first window, bytes) of about a megabyte; long texts overlap by a window."""
    held, size = [], 0
    for d, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), kernels.SLICE):
            held.append((d, at, text[at : at + kernels.SLICE + length - 1]))
            size += len(held[-1][2])
            if size >= kernels.SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    done = 1
    while done < n:
        step = min(done, n - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def _names(buf: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every offset: of its q-gram, and of its ``length``-byte window by the buckets of later offsets, round by round."""
    sums, at = kernels.prefix_sums(buf, 0), np.arange(max(0, len(buf) - QGRAM + 1))
    grams = kernels.span_hashes(sums, at, at + QGRAM)
    names, size = grams, QGRAM
    while size < length:
        step = min(size, length - size)
        names = _pair(names[: max(0, len(names) - step)], names[step:])
        size += step
    return grams, names


def _pair(first: np.ndarray, later: np.ndarray) -> np.ndarray:
    """The bucket of a bucket and the one at a later offset."""
    return kernels.mix(first * PAIR + later)


def _runs(texts: list[bytes], length: int) -> dict[str, np.ndarray]:
    """Runs of windows with the same least q-gram: document, windows [start, end), q-gram bucket, name of the stretch."""
    parts: list[tuple[np.ndarray, ...]] = []
    for held in _slices(texts, length):
        buf = np.frombuffer(b"".join(s for _, _, s in held), dtype=np.uint8)
        sizes = np.array([len(s) for _, _, s in held])
        begins = np.cumsum(sizes) - sizes
        of = np.repeat(np.arange(len(held)), sizes)
        grams, names = _names(buf, length)
        low = U((1 << 24) - 1)
        least = (_sliding_min((grams & ~low) | np.arange(len(grams)).astype(U), length - QGRAM + 1) & low).astype(np.int64)
        window = np.flatnonzero(of[: len(least)] == of[length - 1 :])
        if not len(window):
            continue
        chosen, segment = least[window], of[window]
        new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (segment[1:] != segment[:-1])])
        start = window[new]
        end = np.concatenate([window[np.flatnonzero(new)[1:] - 1], window[-1:]]) + 1
        segment = segment[new]
        shift = np.array([a for _, a, _ in held])[segment] - begins[segment]
        # the windows at both ends cover the stretch where they meet; a longer one is further told by its length
        ext = _pair(names[start], names[end - 1]) + (end - start).astype(U)
        parts.append((np.array([d for d, _, _ in held])[segment], start + shift, end + shift, grams[chosen[new]], ext))
    names = ("doc", "start", "end", "gram", "ext")
    if not parts:
        return {n: np.zeros(0, U if n in ("gram", "ext") else np.int64) for n in names}
    return {n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(names)}


def _windows(texts: list[bytes], doc: np.ndarray, start: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Two identifiers of every window in the ranges [start, end), with the range it is in: its bucket, and bits of its plain hash."""
    one, two, of = [], [], []
    at = 0
    while at < len(doc):
        stop, size, held = at, 0, []
        while stop < len(doc) and (size < kernels.SLICE or stop == at):
            held.append(texts[doc[stop]][start[stop] : end[stop] + length - 1])
            size += len(held[-1])
            stop += 1
        buf = np.frombuffer(b"".join(held), dtype=np.uint8)
        count = end[at:stop] - start[at:stop]
        sizes = count + length - 1
        first = np.cumsum(sizes) - sizes
        where = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        one.append(_names(buf, length)[1][where])
        two.append((kernels.span_hashes(kernels.prefix_sums(buf, 1), where, where + length, 1) >> U(48)).astype(np.uint16))
        of.append(np.repeat(np.arange(at, stop), count))
        at = stop
    if not one:
        return np.zeros(0, U), np.zeros(0, np.uint16), np.zeros(0, np.int64)
    return np.concatenate(one), np.concatenate(two), np.concatenate(of)


def _ext48(ext: np.ndarray) -> np.ndarray:
    return (ext >> U(16)) | U(1)  # never 0, which means "several"


def _sent(key_of: np.ndarray, first: np.ndarray, second: np.ndarray, ids: np.ndarray, chunk: int) -> list[tuple[int, int, int, bytes]]:
    """One row per bucket, entries packed; ``key_of`` is sorted."""
    if not len(key_of):
        return []
    rows = []
    edges = np.flatnonzero(np.concatenate([[True], key_of[1:] != key_of[:-1]])).tolist()
    for a, b in zip(edges, [*edges[1:], len(key_of)], strict=True):
        base = int(ids[a:b].min())
        narrow = int(ids[a:b].max()) - base < 1 << 32
        doc = (ids[a:b] - base).astype(np.uint32).tobytes() if narrow else ids[a:b].tobytes()
        rows.append((int(key_of[a]), chunk, NARROW if narrow else WIDE, np.int64(base).tobytes() + first[a:b].tobytes() + second[a:b].tobytes() + doc))
    return rows


def _received(group: pa.Table, narrow: type) -> tuple[np.ndarray, ...]:
    """Entries of a bucket: two identifiers, the least document and the chunk of each."""
    wide = 8 + np.dtype(narrow).itemsize
    first, second, ids, chunks = [], [], [], []
    for chunk, kind, blob in zip(group.column("chunk").to_pylist(), group.column("kind").to_pylist(), group.column("blob").to_pylist(), strict=True):
        m = (len(blob) - 8) // (wide + (4 if kind == NARROW else 8))
        first.append(np.frombuffer(blob, U, m, 8))
        second.append(np.frombuffer(blob, narrow, m, 8 + 8 * m))
        doc = np.frombuffer(blob, np.uint32 if kind == NARROW else np.int64, m, 8 + wide * m)
        ids.append(doc.astype(np.int64) + np.frombuffer(blob, np.int64, 1)[0] if kind == NARROW else doc)
        chunks.append(np.full(m, chunk, dtype=np.int64))
    return tuple(np.concatenate(x) for x in (first, second, ids, chunks))


def _answers(key: int, chunk: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    order = np.argsort(chunk, kind="stable")
    chunk = chunk[order]
    edges = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])).tolist() if len(chunk) else []
    return _table([(key, int(chunk[a]), REPLY, b"".join(c[order[a:b]].tobytes() for c in columns)) for a, b in zip(edges, [*edges[1:], len(chunk)], strict=False)])


def _local(runs: dict[str, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by (q-gram, extension, document); first of each (q-gram, extension); extensions of each q-gram; entry of each run."""
    order = np.lexsort((runs["doc"], runs["ext48"], runs["gram"]))
    gram, ext = runs["gram"][order], runs["ext48"][order]
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    new = new_gram | np.concatenate([[True], ext[1:] != ext[:-1]])
    first = np.flatnonzero(new)
    entry = np.cumsum(new) - 1
    of_gram = np.cumsum(new_gram[first]) - 1
    return order, first, np.bincount(of_gram)[of_gram], entry


def _level0(bits: int, length: int):
    def run(group: pa.Table) -> pa.Table:
        ids, texts, _ = _ordered(group)
        runs = _runs(texts, length)
        if not len(runs["doc"]):
            return _table([])
        runs["ext48"] = _ext48(runs["ext"])
        order, first, several, _ = _local(runs, ids)
        gram, ext, doc = runs["gram"][order][first], runs["ext48"][order][first].copy(), ids[runs["doc"][order][first]]
        diverse = several > DIVERSE
        ext[diverse] = 0
        lead = np.concatenate([[True], gram[1:] != gram[:-1]])
        keep = ~diverse | lead
        gram, ext, doc = gram[keep], ext[keep], doc[keep]
        e1 = (gram << U(bits)) & ~U(0xFFFF) | (ext >> U(32))
        e2 = (ext & U(0xFFFFFFFF)).astype(np.uint32)
        return _table(_sent((gram >> U(64 - bits)).astype(np.int64), e1, e2, doc, group.column("chunk")[0].as_py()))

    return run


def _refine_extensions(group: pa.Table) -> pa.Table:
    """Answer each chunk's entries: 1, the extension starts in a smaller document; 2, first of its extension in a mixed bucket."""
    e1, e2, ids, chunk = _received(group, np.uint32)
    order = np.lexsort((ids, e2, e1))
    e1, e2, ids, chunk = e1[order], e2[order], ids[order], chunk[order]
    gram = e1 >> U(16)
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    new = np.concatenate([[True], (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])])
    of_gram = np.cumsum(new_gram) - 1
    several = ((e1 & U(0xFFFF)) == 0) & (e2 == 0)
    mixed = (np.bincount(of_gram, weights=new) > 1) | (np.bincount(of_gram, weights=several) > 0)
    least = ids[np.flatnonzero(new)[np.cumsum(new) - 1]]
    flag = np.where(ids > least, 1, np.where(mixed[of_gram], 2, 0)).astype(np.uint8)
    keep = (flag > 0) & ~several
    return _answers(group.column("key")[0].as_py(), chunk[keep], [e1[keep], e2[keep], flag[keep]])


def _level1(bits: int, length: int):
    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _table([])
        ids, texts, _ = _ordered(group)
        runs = _runs(texts, length)
        chunk = group.column("chunk")[0].as_py()
        if not len(runs["doc"]):
            return _table([])
        runs["ext48"] = _ext48(runs["ext"])
        order, first, several, entry = _local(runs, ids)
        gram, ext = runs["gram"][order][first], runs["ext48"][order][first]
        e1 = (gram << U(bits)) & ~U(0xFFFF) | (ext >> U(32))
        bucket, e2 = (gram >> U(64 - bits)).astype(np.int64), (ext & U(0xFFFFFFFF)).astype(np.uint32)
        flags = np.zeros(len(first), dtype=np.uint8)
        flags[several > 1] = 2
        for key, blob in zip(replies.column("key").to_pylist(), replies.column("blob").to_pylist(), strict=True):
            m = len(blob) // 13
            a, b = np.searchsorted(bucket, [key, key + 1])
            # within a bucket the entries are in order of e1, e2, as the answers are
            asked = np.rec.fromarrays([np.frombuffer(blob, U, m), np.frombuffer(blob, np.uint32, m, 8 * m)])
            own = np.rec.fromarrays([e1[a:b], e2[a:b]])
            at = np.searchsorted(own, asked)
            flags[a + at] = np.frombuffer(blob, np.uint8, m, 12 * m)
        doc, start, end = runs["doc"][order], runs["start"][order], runs["end"][order]
        later = ids[doc] > ids[doc[first]][entry]  # a smaller document of this chunk has the extension
        flag = flags[entry]
        settled = later | (flag == 1)
        pending = ~settled & (flag == 2)
        rows = []
        own = -1 - chunk
        for kind, pick in ((SETTLED, settled), (PENDING, pending)):
            if pick.any():
                d, s, e = doc[pick], start[pick], end[pick]
                o = np.lexsort((s, d))
                d, s, e = d[o], s[o], e[o]
                cut = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != e[:-1])])
                last = np.concatenate([np.flatnonzero(cut)[1:] - 1, [len(d) - 1]])
                d, s, e = d[cut], s[cut], e[last]
                rows.append((own, chunk, kind, np.stack([d, s, e]).astype(np.int64).tobytes()))
                if kind == PENDING:
                    one, two, of = _windows(texts, d, s, e, length)
                    who = d[of]
                    o = np.lexsort((who, two, one))
                    one, two, who = one[o], two[o], who[o]
                    new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
                    one, two, who = one[new], two[new], who[new]
                    rows += _sent((one >> U(64 - bits)).astype(np.int64), one, two, ids[who], chunk)
        return _table(rows)

    return run


def _refine_windows(group: pa.Table) -> pa.Table:
    """Answer each chunk with its windows that start in a smaller document of another chunk."""
    key = group.column("key")[0].as_py()
    if key < 0:
        return group
    one, two, ids, chunk = _received(group, np.uint16)
    order = np.lexsort((ids, two, one))
    one, two, ids, chunk = one[order], two[order], ids[order], chunk[order]
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    keep = ids > ids[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return _answers(key, chunk[keep], [one[keep], two[keep]])


def _remove(length: int):
    def run(group: pa.Table, found: pa.Table) -> pa.Table:
        if not group.num_rows:
            return OUT.empty_table()
        ids, texts, rows = _ordered(group)
        settled = pending = np.zeros((3, 0), dtype=np.int64)
        ones, twos = [np.zeros(0, U)], [np.zeros(0, np.uint16)]
        for kind, blob in zip(found.column("kind").to_pylist(), found.column("blob").to_pylist(), strict=True):
            if kind == REPLY:
                m = len(blob) // 10
                ones.append(np.frombuffer(blob, U, m))
                twos.append(np.frombuffer(blob, np.uint16, m, 8 * m))
            else:
                ranges = np.frombuffer(blob, np.int64).reshape(3, -1)
                settled, pending = (ranges, pending) if kind == SETTLED else (settled, ranges)
        hit = [settled]
        if pending.shape[1]:
            d, s, e = pending
            one, two, of = _windows(texts, d, s, e, length)
            who = ids[d[of]]
            place = s[of] + np.arange(len(of)) - np.searchsorted(of, of)
            # a window goes if the answers name it or a smaller document of this chunk has it
            named_one, named_two = np.concatenate(ones), np.concatenate(twos)
            every = np.concatenate([one, named_one]), np.concatenate([two, named_two])
            rank = np.concatenate([who, np.full(len(named_one), np.iinfo(np.int64).min)])
            o = np.lexsort((rank, every[1], every[0]))
            a, b, rank = every[0][o], every[1][o], rank[o]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            gone = np.zeros(len(o), dtype=bool)
            gone[o] = rank > rank[np.flatnonzero(new)[np.cumsum(new) - 1]]
            gone = gone[: len(one)]
            hit.append(np.stack([d[of][gone], place[gone], place[gone] + 1]))
        d, s, e = np.concatenate(hit, axis=1)
        order = np.lexsort((s, d))
        d, s, e = d[order], s[order], e[order] + length - 1
        bounds = np.searchsorted(d, np.arange(len(texts) + 1))
        out = []
        for k, text in enumerate(texts):
            a, b = bounds[k], bounds[k + 1]
            kept, spans = text, []
            if a < b:
                reach = np.maximum.accumulate(e[a:b])
                cut = np.concatenate([[True], s[a + 1 : b] > reach[:-1]])
                begin, stop = s[a:b][cut].tolist(), reach[np.concatenate([np.flatnonzero(cut)[1:] - 1, [b - a - 1]])].tolist()
                spans = [x for pair in zip(begin, stop, strict=True) for x in pair]
                kept = b"".join(text[x:y] for x, y in zip([0, *stop], [*begin, len(text)], strict=True))
            out.append((*rows[k], len(text), len(text) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest(), spans))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), OUT.types, strict=True)], schema=OUT)

    return run


def remove_repeats(docs: DataFrame, length: int = 50, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts in a smaller document.

    Returns per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 of the remaining bytes, and spans (begin, end, begin, end, ... in bytes).
    Null texts count as empty; texts under ``length`` bytes lose nothing. Rows with a null doc_id
    count as after all others. Rows of one doc_id, repeated or not, take nothing from each other; equal ones travel once
    from each task and each return.
    An empty table gives an empty result; other columns are ignored.
    """
    if length <= QGRAM:
        raise ValueError(f"length must exceed {QGRAM}")
    spark = docs.sparkSession
    ship(spark)
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()
    bits = min(MOST_BITS, max(FEWEST_BITS, (n // DOCS_A_BUCKET).bit_length()))
    chunks = max(1, -(-n // chunk_docs), -(-size // CHUNK_BYTES))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # by id and text, so that rows without an id, however many, are dealt to all chunks
    source = source.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    by_chunk = source.mapInArrow(_press(), "chunk long, docs binary").groupBy("chunk")
    level0 = by_chunk.applyInArrow(_level0(bits, length), PACKED_DDL)
    answers = level0.groupBy("key").applyInArrow(_refine_extensions, PACKED_DDL)
    level1 = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_level1(bits, length), PACKED_DDL)
    settled = level1.groupBy("key").applyInArrow(_refine_windows, PACKED_DDL)
    found = by_chunk.cogroup(settled.groupBy("chunk")).applyInArrow(_remove(length), OUT_DDL)
    return found.withColumn("copies", F.explode(F.expr("sequence(1L, copies)"))).drop("copies")
