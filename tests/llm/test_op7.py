import gzip
import hashlib
import io
import random

import pyarrow as pa
import pytest
from pyspark.sql import Row

from tracewell.llm import warc


def brute(rows):
    digest = {i: hashlib.sha1((h or "").encode()).hexdigest() for i, h in rows}
    size = {i: len((h or "").encode()) for i, h in rows}
    keep = {}
    for i, d in digest.items():
        if size[i] >= 1000:
            keep[d] = max(keep.get(d, i), i)
    out = []
    for i, d in digest.items():
        k = keep.get(d, i) if size[i] >= 1000 else i
        out.append((i, size[i], d, "response" if k == i else "revisit", None if k == i else k))
    return sorted(out)


def test_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    rows += [(10_000 + i, "http://x/\r\nWARC-Type: warcinfo", rows[7][2]) for i in range(20)]
    rows += [(20_001, None, None), (20_002, "", ""), (20_003, "u", "é" * 500), (20_004, "u", "é" * 500), (20_005, "u", "a" * 999), (20_006, "u", "a" * 999), (20_007, "u", "b\r\n\r\nc" * 70000)]
    got = warc.archived(spark.createDataFrame([Row(page_id=i, url=u, html=h, payload=1, digest="d") for i, u, h in rows]))
    assert sorted(tuple(r) for r in got.collect()) == brute([(i, h) for i, _, h in rows])


def test_null_ids_repeats_and_empty(spark):
    rows = [(None, "u", "z" * 2000), (5, "u", "z" * 2000), (5, "u", "z" * 2000), (4, "u", "z" * 2000)]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("4", "revisit", 5), ("5", "response", None), ("5", "response", None), ("None", "revisit", 5)]
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pushdown_decides_on_headers(spark, tmp_path):
    warc.register(spark)
    rows = [(f"urn:page:{i}", f"http://h{i % 3}/p", bytearray(b"x" * 3000), "urn:page:1" if i % 4 == 0 else None) for i in range(40)]
    spark.createDataFrame(rows, "record_id string, target_uri string, payload binary, refers_to string").write.format("warc").mode("append").save(str(tmp_path))
    read = spark.read.format("warc").option("payload", "false").load(str(tmp_path))
    one = read.where("record_type = 'response' and target_uri like 'http://h1%'")
    got = one.collect()
    assert len(got) == sum(1 for i in range(40) if i % 4 and i % 3 == 1) and {r.payload_bytes for r in got} == {3000} and {r.payload for r in got} == {None}
    assert read.where("record_type = 'warcinfo'").count() >= 1


def test_foreign_files():
    one = warc.record("resource", {"WARC-Record-ID": "<urn:a>", "Content-Type": "text/plain", "X-Folded": "a\r\n b"}, b"hello")
    two = warc.page_record("urn:b", "http://b/", b"<p>" * 50_000)
    for data in (one + two, gzip.compress(one) + gzip.compress(two), warc.member(one) + gzip.compress(two)):
        for full in (True, False):
            got = list(warc.records(pa.PythonFile(io.BytesIO(data), "r"), lambda h: True, full))
            assert [(g[0]["warc-type"], g[1]) for g in got] == [("resource", 5), ("response", 150_000)]
            assert [g[2] for g in got] == ([b"hello", b"<p>" * 50_000] if full else [None, None])
    assert got[0][0]["x-folded"] == "a b"
    touched = []
    stream = pa.PythonFile(io.BytesIO(warc.member(two) * 3), "r")
    assert not list(warc.records(stream, lambda h: touched.append(h), True)) and len(touched) == 3


def test_unwanted_payloads_are_not_decoded(spark, tmp_path):
    """Behind their headers, the payloads of responses are broken: a query of revisits alone doesn't see it."""
    warc.register(spark)
    rng = random.Random(3)
    parts = []
    for i in range(12):
        whole = warc.member(warc.page_record(f"urn:page:{i}", f"http://h{i}/", rng.randbytes(200_000), None))
        parts += [whole[:-50_000] + bytes(40_000) + whole[-10_000:], warc.member(warc.page_record(f"urn:page:{100 + i}", f"http://h{i}/", b"x" * 2000, f"urn:page:{i}"))]
    (tmp_path / "broken.warc.gz").write_bytes(b"".join(parts))
    read = lambda: spark.read.format("warc").load(str(tmp_path))
    assert read().where("record_type = 'revisit'").count() == 12
    assert [r.record_id for r in read().where("record_type = 'revisit' and target_uri = 'http://h5/'").collect()] == ["urn:page:105"]
    with pytest.raises(Exception, match="damaged|decompressing"):
        read().collect()


def test_ranges_of_a_file_and_rolled_files(spark, tmp_path):
    warc.register(spark)
    rng = random.Random(8)
    rows = [(f"urn:page:{i}", f"http://h/{i}", bytearray(b"\x1f\x8b\x08\x04" + rng.randbytes(rng.randrange(9000)) + b"\x1f\x8b\x08\0"), None) for i in range(150)]
    frame = spark.createDataFrame(rows, "record_id string, target_uri string, payload binary, refers_to string").coalesce(1)
    frame.write.format("warc").mode("append").save(str(tmp_path / "one"))
    frame.write.format("warc").option("partBytes", "100000").mode("append").save(str(tmp_path / "many"))
    assert len(list((tmp_path / "one").iterdir())) == 1 and len(list((tmp_path / "many").iterdir())) >= 5
    for folder, size in (("one", 20_000), ("one", 777), ("many", 1 << 20), ("many", 50_000)):
        read = spark.read.format("warc").option("partBytes", str(size)).load(str(tmp_path / folder)).where("record_type = 'response'")
        assert sorted((r.record_id, r.payload) for r in read.collect()) == sorted((r[0], r[2]) for r in rows)
        if folder == "one":
            assert read.rdd.getNumPartitions() > 20


def test_payloads_are_not_shuffled_for_a_small_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert "BroadcastHashJoin" in warc.page_records(pages)._jdf.queryExecution().executedPlan().toString()


def nested(rng):
    """Pages whose payloads are themselves archives of incompressible records, which deflate stores as they are."""
    inner = lambda i: b"".join(warc.member(warc.page_record(f"urn:page:inner{i}-{k}", "http://in/", rng.randbytes(rng.randrange(40_000)))) for k in range(4))
    return [(f"urn:page:{i}", "http://out/", bytearray(inner(i)), None) for i in range(12)]


def test_archives_within_archives(spark, tmp_path):
    warc.register(spark)
    rows = nested(random.Random(2))
    spark.createDataFrame(rows, "record_id string, target_uri string, payload binary, refers_to string").coalesce(1).write.format("warc").mode("append").save(str(tmp_path))
    for size in (777, 20_000, 60_000, 150_000, 250_000, 1 << 26):
        read = spark.read.format("warc").option("partBytes", str(size)).load(str(tmp_path)).where("record_type = 'response'")
        assert sorted((r.record_id, r.payload) for r in read.collect()) == sorted((r[0], r[2]) for r in rows)
        assert (read.rdd.getNumPartitions() > 5) == (size < 200_000)


def test_files_without_listed_starts(spark, tmp_path, monkeypatch):
    """They are one range, and ranges once their starts are written; a list of another file's size counts for nothing."""
    rows = nested(random.Random(4))
    data = b"".join(warc.member(warc.page_record(r[0], r[1], bytes(r[2]))) for r in rows)
    (tmp_path / "x.warc.gz").write_bytes(data)
    parts = lambda size: warc.WarcReader({"path": str(tmp_path), "partbytes": str(size)}).partitions()
    assert len(parts(100_000)) == 1
    monkeypatch.setattr(warc, "PART_BYTES", 100_000)
    assert [r.starts for r in warc.index_starts(spark, str(tmp_path)).collect()] == [12] and len(parts(100_000)) > 3
    read = spark.read.format("warc").option("partBytes", "100000").load(str(tmp_path))
    assert sorted((r.record_id, r.payload) for r in read.collect()) == sorted((r[0], r[2]) for r in rows)
    (tmp_path / "x.warc.gz").write_bytes(data + warc.member(warc.page_record("urn:page:99", "u", b"more")))
    assert len(parts(100_000)) == 1
