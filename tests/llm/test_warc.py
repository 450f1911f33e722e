"""The WARC writer and reader: exact round trips, ranges of any size, records inside records, damage and edge cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fathomline.llm import queries, warc

SCHEMA = "page_id long, url string, html string, payload binary, digest string, id long, size long, path string, n int"
DATA = "/root/testdata/sf0.001"


def pages():
    copy = "<p>" + "the same page " * 20
    made = [(i, f"http://h{i % 3}/p?{i}", copy) for i in range(40, 0, -3)]
    made += [(100, None, None), (101, "http://x/a b\r\nWARC-Type: forged", ""), (102, "http://x/ü", "short"), (103, "http://x/2", "short"), (104, "u", "x" * 99), (105, "u", "x" * 99), (106, "u", "x" * 100), (107, "u", "x" * 100)]
    made += [(108, "u", "é🙂\x00\r\n\r\n" * 50), (109, "u", "long " * 400_000), (None, "u", copy), (None, None, "only without an id " * 10), (200, "u", "twice " * 30), (200, "u", "twice " * 30)]
    return [(*x, b"z", "d", 1, 2, "p", 3) for x in made]


def expected(rows):
    first, out = {}, []
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        if i is not None and len(raw) >= 100:
            first[raw] = min(first.get(raw, i), i)
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        f = first.get(raw)
        refers = f if f is not None and (i is None or i > f) else None
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers, None if refers is not None else raw))
    return sorted(out, key=repr)


def read_back(manifest, **options):
    back = warc.read(manifest, **options)
    rows = back.select(warc.id_of("record_id"), "payload_bytes", "digest", "record_type", warc.id_of("refers_to"), "payload").collect()
    return sorted(((*r[:5], r[5] if r[5] is None else bytes(r[5])) for r in rows), key=repr)


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    manifest = warc.write(df, file_bytes=1500)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) and manifest.count() > 3
    for range_bytes in (37, 1 << 20):
        assert read_back(manifest, range_bytes=range_bytes) == expected(rows)
    fields = {r.record_id: r for r in warc.read(manifest).collect()}
    assert fields["<urn:x-id:100>"].target_uri is None and fields["<urn:x-id:101>"].target_uri == "http://x/a%20b%0D%0AWARC-Type:%20forged"
    assert fields["<urn:x-id:101>"].record_type == "response" and fields["<urn:x-id:40>"].headers["warc-profile"] == warc.PROFILE
    folder = manifest.first().path.rpartition("/")[0]
    assert read_back(warc.listing(spark, folder)) == expected(rows)


def test_empty_table(spark):
    manifest = warc.write(spark.createDataFrame([], SCHEMA))
    assert manifest.count() == 0 and warc.read(manifest).count() == 0


def foreign(tmp_path, members, name="a.warc.gz"):
    path = tmp_path / name
    path.write_bytes(b"".join(members))
    return f"file://{path}", path.stat().st_size


def member(kind, block, number=0, **fields):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{number}>\r\nContent-Length: {len(block)}\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    packed = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: the block's bytes stand in the file as they are
    return packed.compress(head.encode() + block + b"\r\n\r\n") + packed.flush()


def test_archives_inside_archives_are_no_records(spark, tmp_path):
    """A stored payload that is a whole archive itself has members that decode; only the chain from the file's start tells them apart."""
    inner = b"".join(member("resource", b"inner %d" % i * 20, 1000 + i) for i in range(40))
    outer = [member("warcinfo", b"software: x\r\n"), member("resource", inner, 1), member("resource", b"last", 2), member("response", b"HTTP/1.1 200 OK\r\n\r\n" + inner, 3), member("resource", b"end", 4)]
    path, size = foreign(tmp_path, outer)
    manifest = spark.createDataFrame([(path, size)], "path string, size long")
    for range_bytes in (300, 5000, 1 << 20):
        got = {r.record_id: bytes(r.payload) for r in warc.read(manifest, range_bytes).collect()}
        assert got == {"<urn:x:0>": b"software: x\r\n", "<urn:x:1>": inner, "<urn:x:2>": b"last", "<urn:x:3>": inner, "<urn:x:4>": b"end"}


def test_gzip_that_is_no_record_is_skipped(spark, tmp_path):
    import gzip

    path, size = foreign(tmp_path, [gzip.compress(b"WARC/1.0 without fields\r\n\r\n"), warc.MAGIC, member("resource", b"a" * 300, 1), b"\x1f\x8b" * 9, gzip.compress(b"other"), member("resource", b"b", 2)])
    manifest = spark.createDataFrame([(path, size)], "path string, size long")
    for range_bytes in (16, 1 << 20):
        assert sorted(r.record_id for r in warc.read(manifest, range_bytes).collect()) == ["<urn:x:1>", "<urn:x:2>"]


def test_damage_is_told(spark, tmp_path):
    good = [member("resource", b"a" * 300, 1), member("resource", b"b" * 300, 2)]
    torn = good[1][:150] + b"?" + good[1][151:]
    for k, members in enumerate(([good[0], torn, good[0]], [good[0], good[1][:-20]], [member("resource", b"x", 3, WARC_Payload_Digest="sha256:00")])):
        manifest = spark.createDataFrame([foreign(tmp_path, members, f"{k}.warc.gz")], "path string, size long")
        with pytest.raises(Exception, match="damaged|digest"):
            warc.read(manifest).collect()


def test_magic_across_blocks(tmp_path, monkeypatch):
    path, size = foreign(tmp_path, [b"\x1f\x1f\x8b" * 7 + b"."] + [member("resource", b"c" * 40, i) for i in range(5)])
    whole = [(at, f["warc-record-id"]) for at, _, f, _ in warc.records(warc.Source(path), 0, size, True)]
    assert len(whole) == 5
    for block in (1, 2, 3, 5, 64):
        monkeypatch.setattr(warc, "BLOCK", max(block, 3))
        monkeypatch.setattr(warc, "PIECE", block)
        assert [(at, f["warc-record-id"]) for at, _, f, _ in warc.records(warc.Source(path), 0, size, True)] == whole


def test_registered_query(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    want = con.sql(queries.oracle_sql()["op11_warc"]).fetchall()
    got = queries.op11_warc(spark, DATA).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(want)
