"""WARC archives: exact round trips, plan of records, damaged data."""

import gzip
import zlib

import pytest

from tidelog.llm import warc


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "é"), (2, None, "é"), (3, "http://b/ c\r\nX: y%41", None), (4, "u", ""), (None, "n", "é"), (7, "v", "z" * 100_000), (9, "w", "WARC/1.0\r\n\r\n\r\n\r\n"), (9, "w", "WARC/1.0\r\n\r\n\r\n\r\n"), (None, "m", "only null")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    warc.write(df, str(tmp_path / "w"), archive_records=2)
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert sorted((str(r.page_id), str(r.url), r.record_type, r.refers_to, r.payload_bytes) for r in got) == sorted([
        ("1", "http://a/", "revisit", 2, 2), ("2", "None", "response", None, 2), ("None", "n", "revisit", 2, 2), ("3", "http://b/ c\r\nX: y%41", "revisit", 4, 0), ("4", "u", "response", None, 0),
        ("7", "v", "response", None, 100_000), ("9", "w", "response", None, 16), ("9", "w", "response", None, 16), ("None", "m", "response", None, 9),
    ])
    want = {(r[0], r[1]): (r[2] or "").encode() for r in rows}
    for r in got:
        full = want[r.page_id, r.url]
        assert r.payload_digest == warc.digest(full) and r.payload == (None if r.record_type == "revisit" else full)
    for path in (tmp_path / "w").glob("*.warc.gz"):
        data = path.read_bytes()
        assert gzip.decompress(data).count(b"WARC-Record-ID") == len(list(warc.members(data))) <= 2


def test_least_bytes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "y"), (4, "d", "y")], "page_id long, url string, html string")
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in warc.plan_records(df, least_bytes=2).collect()}
    assert kinds == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None)}


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0
    assert warc.read(spark, str(tmp_path / "none")).count() == 0


def test_one_member_a_record():
    for n in (10, (1 << 24) - 1, 1 << 24, 3 << 24):
        data = warc.member(b"a" * n)
        assert list(warc.members(data * 2)) == [b"a" * n] * 2 and data.count(b"\x1f\x8b\x08") == 1 and bool(data[-1]) == (n >= 1 << 24)
    assert list(warc.members(gzip.compress(b"one") + gzip.compress(b"two"))) == [b"one", b"two"]


def test_long_records(spark, tmp_path):
    """Records of 16 MiB and more, alone and among others, as the last of an archive and not."""
    long = 17 << 20
    for name, sizes in (("alone", [long]), ("mixed", [5, long, 7, long + 1]), ("first", [long, 3])):
        df = spark.createDataFrame([(i, "u", n) for i, n in enumerate(sizes)], "page_id long, url string, n int").selectExpr("page_id", "url", "repeat('x', n) html").coalesce(1)
        warc.write(df, str(tmp_path / name))
        assert {r.page_id: r.payload_bytes for r in warc.read(spark, str(tmp_path / name), payloads=False).collect()} == dict(enumerate(sizes))
        for path in (tmp_path / name).glob("*.warc.gz"):
            found = list(warc.members(path.read_bytes()))
            assert all(x.startswith(b"WARC/1.0") for x in found) and len(found) in (len(sizes), len(sizes) + 1)
            assert gzip.decompress(path.read_bytes()) == b"".join(found)


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    df = spark.range(60).selectExpr("id page_id", "'u' url", "sha2(cast(id as string), 512) html").coalesce(1)
    warc.write(df, str(tmp_path / "b"), archive_bytes=3000)
    sizes = [p.stat().st_size for p in (tmp_path / "b").glob("*.warc.gz")]
    assert len(sizes) > 5 and max(sizes) < 4000 and warc.read(spark, str(tmp_path / "b")).count() == 60


def _foreign(kind, content, block, *more):
    head = [f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", f"Content-Type: {content}", f"Content-Length: {len(block)}", *more]
    return b"WARC/1.0\r\n" + "\r\n".join(head).encode("latin-1") + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_records():
    http = "application/http; msgtype=response"
    got = warc.parse(_foreign("response", http, b"HTTP/1.1 200 OK\r\nServer: caf\xe9\r\nContent-Length: 3\r\n\r\npayload", "WARC-Target-URI: http://x/\xe9", "WARC-Payload-Digest: sha256:abc", "WARC-Block-Digest: md5:1"))
    assert got["payload"] == b"payload" and got["payload_bytes"] == 7 and got["payload_digest"] == warc.digest(b"payload") and got["url"] == "http://x/\xe9"
    hexed = __import__("hashlib").sha1(b"payload").hexdigest()
    for value in (f"sha1:{warc.digest(b'payload')}", f"sha1:{warc.digest(b'payload').lower()}", f"SHA1:{hexed}"):
        assert warc.parse(_foreign("response", http, b"HTTP/1.0 200\nA: b\n\npayload", f"WARC-Payload-Digest: {value}"))["payload_digest"] == warc.digest(b"payload")
    with pytest.raises(warc.WarcError):
        warc.parse(_foreign("response", http, b"HTTP/1.0 200\r\n\r\npayload", f"WARC-Payload-Digest: sha1:{warc.digest(b'other')}"))
    got = warc.parse(_foreign("request", "application/http; msgtype=request", b"GET / HTTP/1.1"))
    assert got["payload"] == b"GET / HTTP/1.1" and got["record_type"] == "request"
    assert warc.parse(_foreign("response", http, b"HTTP/1.1 204 No Content"))["payload"] == b""
    for bad in (b"WARC/1.0\r\nContent-Length: x\r\n\r\n\r\n\r\n", b"WARC/1.0\r\nA: b\r\n\r\n\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


def test_damage_is_found():
    record = warc.record(5, "http://x/", b"payload", "response", None, "1970-01-01T00:00:00Z")
    assert warc.parse(record)["payload"] == b"payload"
    for bad in (record.replace(b"payload", b"pAyload"), record[:-1], record.replace(b"WARC/1.0", b"HTTP/1.0"), record + b"x"):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    data = warc.member(record)
    for bad in (data[:-5], b"\x00" * 20, data + b"junk"):
        with pytest.raises(warc.WarcError):
            list(warc.members(bad))


def test_plain_records_are_read():
    block = b"software: x\r\n"
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 13\r\n\r\n" + block + b"\r\n\r\n"
    got = warc.parse(zlib.decompress(gzip.compress(record), 31))
    assert got["record_type"] == "warcinfo" and got["payload"] == block and got["page_id"] is None and got["url"] is None
