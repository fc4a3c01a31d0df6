"""WARC bundles: exact round trips, revisits, seeks."""

import hashlib
import struct

import duckdb
import pytest
import zstandard

from tessera.llm import common, queries, warc


def test_bundle_is_plain_zstandard_with_a_seek_table():
    b = warc.Bundle()
    data = {f"r{i}": warc.record(i, f"http://x/{i}", bytes([i]) * 90_000, "d", None) for i in range(12)}
    for name, d in data.items():
        b.add(name, d)
    raw, index = b.finish()
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == b"".join(data.values())
    assert struct.unpack("<I", raw[-4:])[0] == warc.SEEKABLE
    a = warc.Archive(raw)
    assert len(a.sizes) > 1 and [f["WARC-Record-ID"] for f, _ in a.records(index)] == [warc._name(i) for i in range(12)]
    for i in (0, 5, 11):
        assert a.lookup(index, f"r{i}")[1] == bytes([i]) * 90_000


def test_pages_against_sql(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 5000)
    big, small = "é" * 600, "x" * 999
    rows = [(1, "u", big), (2, "u 2", big), (3, None, big), (4, "u", small), (5, "u", small), (6, "", None), (7, "u", ""), (8, "u", "a\r\n\r\nb" * 300), (9, "u", "a\r\n\r\nb" * 300), (10, "u", big + "!")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, digest string")
    df.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, queries.op8_warc(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted(con.sql(queries.OP8_SQL).fetchall())
    assert [(r[0], r[4]) for r in got if r[3] == "revisit"] == [(1, 3), (2, 3), (8, 9)]


def test_texts_come_back(spark):
    rows = [(1, "http://a b", "text"), (None, None, None), (None, None, "n" * 2000), (5, "u", "n" * 2000), (5, "u", "n" * 2000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = warc.read(spark, *warc.write(df)).collect()
    texts = sorted(((r.page_id, r.html, r.refers_to) for r in found), key=str)
    assert texts == sorted([(1, "text", None), (None, "", None), (None, None, 5), (5, "n" * 2000, None), (5, "n" * 2000, None)], key=str)
    assert all(r.payload_digest == hashlib.sha1(("n" * 2000).encode()).hexdigest() for r in found if r.payload_bytes == 2000)
    assert warc.read(spark, *warc.write(df.limit(0))).count() == 0


def test_bundles_that_no_manifest_names_are_not_read(spark):
    df = spark.range(20).selectExpr("id AS page_id", "'u' AS url", "repeat('x', 50 + int(id)) AS html")
    folder, manifest = warc.write(df)
    b = warc.Bundle()
    b.add("<urn:page:7>", warc.record(7, "u", b"left over", "d", None))
    data, index = b.finish()
    common.upload(f"{folder}/00000000-000000-old.warc.zst", data)
    common.upload(f"{folder}/index/00000000-000000-old.tsv", index)
    assert sorted(r.page_id for r in warc.read(spark, folder, manifest).collect()) == list(range(20))


@pytest.mark.parametrize("told", [warc.TOLD, 1, 0])
def test_hot_payloads(spark, monkeypatch, told):
    """A payload that half of all pages have, and one of empty pages; however many digests are told."""
    monkeypatch.setattr(warc, "TOLD", told or 10)
    html = "CASE WHEN id % 2 = 0 THEN repeat('hot', 500) WHEN id % 4 = 1 THEN '' ELSE repeat(string(id % 30), 1000) END"
    df = spark.range(400).repartition(4).selectExpr("id AS page_id", "'u' AS url", f"{html} AS html")
    found = {r.page_id: r for r in warc.read(spark, *warc.write(df)).collect()}
    pages = {r.page_id: r.html for r in df.collect()}
    largest = {}
    for p, h in pages.items():
        largest[h] = max(p, largest.get(h, -1))
    assert len(found) == 400
    for p, h in pages.items():
        other = largest[h] if len(h) >= 1000 and largest[h] != p else None
        assert (found[p].refers_to, found[p].payload_bytes) == (other, len(h))


def test_no_payload_is_shuffled(spark):
    df = spark.range(50).selectExpr("id AS page_id", "'u' AS url", "concat(repeat('x', 2000), id % 5) AS html")
    rows = df.selectExpr("page_id AS page", "url", "html", "sha1(html) AS digest", "length(html) AS size")
    plan = warc._linked(rows)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_a_record_larger_than_a_bundle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 1000)
    monkeypatch.setattr(warc, "FRAME_BYTES", 100)
    df = spark.createDataFrame([(1, "u", "a" * 200_000), (2, "u", "b"), (3, "u", "é" * 5000)], "page_id bigint, url string, html string")
    assert {r.page_id: r.html for r in warc.read(spark, *warc.write(df)).collect()} == {1: "a" * 200_000, 2: "b", 3: "é" * 5000}
