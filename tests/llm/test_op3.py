import hashlib
import struct
import zlib

import pytest
from pyspark.sql import Row

from tracewell.llm import matroska as M


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, None), (-2, ""), (-3, "a" * 64), (-4, "é" * 300_000), (None, "x")]
    got = M.round_trip(spark.createDataFrame([Row(doc_id=i, text=t, media=1) for i, t in rows])).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        media = M.mux(padded)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def block(track, time, flags, body):
    return M.vint(track) + struct.pack(">hB", time, flags) + body


def test_all_lacings_groups_and_unknown_sizes():
    frames = [b"a" * 300, b"b" * 10, b"c" * 255, b"d" * 7]
    xiph = bytes([3]) + bytes([255, 45]) + bytes([10]) + bytes([255, 0]) + b"".join(frames)
    ebml = M._laced(frames)
    assert ebml[0] == 0x06
    fixed = M._laced([b"xy"] * 5)
    parts = [
        M._uint(M.CLUSTER_TIME, 100),
        M._element(M.SIMPLE_BLOCK, block(1, 0, 0x80 | 0x02, xiph)),
        M._element(M.SIMPLE_BLOCK, block(2, -5, 0x06, ebml[1])),
        M._element(M.BLOCK_GROUP, M._element(M.BLOCK, block(200, 7, 0x04, fixed[1])) + M._uint(M.BLOCK_DURATION, 9)),
        M._element(0xEC, b"void"),
    ]
    body = b"".join(parts)
    unknown = b"\xff"
    data = M.HEAD + M._id(M.SEGMENT) + unknown + M.DESCRIBED + M._id(M.CLUSTER) + unknown + body + M._element(M.CLUSTER, M._uint(M.CLUSTER_TIME, 900) + M._element(M.SIMPLE_BLOCK, block(1, 1, 0, b"end")))
    got = M.parse(data)
    assert got.tracks[1]["codec"] == "A_PCM/INT/LIT" and got.tracks[1]["rate"] == 8000
    read = [(c, t, ns // 1_000_000, d, k, i, data[o : o + s]) for c, t, ns, d, k, i, o, s in got.packets]
    assert read[:4] == [(0, 1, 100, None, True, i, f) for i, f in enumerate(frames)]
    assert read[4:8] == [(0, 2, 95, None, False, i, f) for i, f in enumerate(frames)]
    assert read[8:13] == [(0, 200, 107, 9, True, i, b"xy") for i in range(5)]
    assert read[13] == (1, 1, 901, None, False, 0, b"end")


def test_cues_and_packet_table(spark):
    media = M.mux(bytes(range(256)) * 1024)
    parsed = M.parse(media)
    assert [o for _, _, o in parsed.cues] == parsed.clusters and len(parsed.clusters) == 4
    rows = M.packet_table(spark.createDataFrame([(5, bytearray(media)), (6, None)], "media_id long, media binary")).orderBy("offset").collect()
    assert len(rows) == 256 and all(r.is_cue and r.size == 1024 for r in rows)
    assert [r.cluster for r in rows[::64]] == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        M.parse(media[:-5])


@pytest.mark.parametrize("n", [0, 1, 126, 127, 128, 16382, 16383, 2**40])
def test_vint(n):
    assert M._vint(M.vint(n), 0) == (n, len(M.vint(n)))


def test_empty_table(spark):
    assert M.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_thousands_of_clusters_of_unknown_size():
    clusters = [M._id(M.CLUSTER) + b"\xff" + M._uint(M.CLUSTER_TIME, k) + M._element(M.SIMPLE_BLOCK, block(1, 0, 0x80, b"%d" % k)) for k in range(5000)]
    data = M.HEAD + M._id(M.SEGMENT) + b"\x01" + b"\xff" * 7 + M.DESCRIBED + b"".join(clusters) + M._element(M.CUES, b"")
    got = M.parse(data)
    assert [(c, ns // 1_000_000, data[o : o + s]) for c, _, ns, _, _, _, o, s in got.packets] == [(k, k, b"%d" % k) for k in range(5000)]


def test_reference_blocks_and_frame_durations():
    frames = M._laced([b"aa", b"bb", b"cc"])
    track = M._element(M.TRACKS, M._element(M.TRACK_ENTRY, M._uint(M.TRACK_NUMBER, 3) + M._uint(M.DEFAULT_DURATION, 20_000_000)))
    body = M._uint(M.CLUSTER_TIME, 50) + M._element(M.SIMPLE_BLOCK, block(3, 5, frames[0], frames[1]))
    body += M._element(M.BLOCK_GROUP, M._element(M.BLOCK, block(3, 100, 0, b"x")) + M._element(M.REFERENCE_BLOCK, b"\xff"))
    body += M._element(M.BLOCK_GROUP, M._element(M.BLOCK, block(4, 200, frames[0], frames[1])) + M._uint(M.BLOCK_DURATION, 30))
    got = M.parse(M.HEAD + M._element(M.SEGMENT, M._element(M.INFO, M._uint(M.TIMESTAMP_SCALE, 1_000_000)) + track + M._element(M.CLUSTER, body)))
    assert [(t, ns // 1_000_000, key) for _, t, ns, _, key, _, _, _ in got.packets] == [(3, 55, False), (3, 75, False), (3, 95, False), (3, 150, False), (4, 250, True), (4, 250, True), (4, 250, True)]


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same")] * 6 + [(None, "same")], "doc_id long, text string")
    got = M.round_trip(docs).collect()
    assert len(got) == 7 and len({(r.media_sha256, r.payload_sha256, r.feature) for r in got}) == 1


def test_cue_points_of_several_tracks():
    positions = lambda track, at: M._element(M.CUE_POSITIONS, M._uint(M.CUE_TRACK, track) + M._uint(M.CUE_CLUSTER, at))
    points = M._element(M.CUE_POINT, M._uint(M.CUE_TIME, 4) + positions(1, 11) + positions(2, 26)) + M._element(M.CUE_POINT, M._uint(M.CUE_TIME, 9) + positions(2, 40))
    got = M.parse(M.HEAD + M._element(M.SEGMENT, M._element(M.CUES, points)))
    base = got.cues[0][2] - 11
    assert [(ns // got.scale, track, at - base) for ns, track, at in got.cues] == [(4, 1, 11), (4, 2, 26), (9, 2, 40)]
