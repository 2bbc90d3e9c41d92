import gzip
import hashlib

import pytest

from sessionlake.llm import warc

PAGES = "page_id bigint, url string, html string"


def record(kind, identifier, block=b"", *fields):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {identifier}", *fields, f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_round_trip(spark, tmp_path):
    long = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n" + "ü\n" * 200_000
    same = "x" * 1000
    rows = [(1, "http://h/a?b#c", "text"), (2, None, None), (3, "http://h/\r\nX: y", ""), (4, "u", same), (9, "u", same), (5, "u", same), (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "http://h", long)]
    path = f"{tmp_path}/archive"
    warc.write(spark.createDataFrame(rows, PAGES), path, "page_id", "url", "html")
    records = warc.read(spark, path)
    assert records.count() == 3 * len(rows) and records.filter("type = 'revisit'").count() == 2
    got = {int(warc_key(r)): r for r in warc.assemble(records).collect()}
    for i, url, text in rows:
        raw = (text or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_sha1) == (len(raw), hashlib.sha1(raw).hexdigest())
        if r.type == "response":
            assert bytes(r.payload) == raw
        else:
            assert i in (4, 5) and r.refers_to == "<urn:capture:9:response>" and bytes(r.payload) == b""
        assert len(r.requests) == len(r.metadata) == 1 and bytes(r.metadata[0].payload) == f"payload-bytes: {len(raw)}\r\n".encode()
    assert got[1].target_uri == "http://h/a?b#c" and got[3].target_uri == "http://h/%0D%0AX: y" and got[2].target_uri == "urn:capture:2"


def warc_key(r):
    return r.record_id.split(":")[2]


def test_payload_that_is_no_text(spark, tmp_path):
    raw = bytes(range(256)) * 8
    df = spark.createDataFrame([(1, "http://h/", bytearray(raw))], "k bigint, u string, p binary")
    warc.write(df, f"{tmp_path}/a", "k", "u", "p")
    assert bytes(warc.read(spark, f"{tmp_path}/a").filter("type = 'response'").first().payload) == raw


def test_members_and_plain_files(spark, tmp_path):
    (tmp_path / "w").mkdir()
    parts = [record("warcinfo", "<i>", b"software: x"), record("response", "<a>", b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi", "Content-Type: application/http; msgtype=response")]
    (tmp_path / "w/one.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "w/two.warc").write_bytes(b"".join(parts).replace(b"<a>", b"<b>"))
    (tmp_path / "w/empty.warc").write_bytes(b"")
    got = sorted((r.record_id, r.type, bytes(r.payload)) for r in warc.read(spark, f"{tmp_path}/w").collect())
    assert got == [("<a>", "response", b"hi"), ("<b>", "response", b"hi"), ("<i>", "warcinfo", b"software: x"), ("<i>", "warcinfo", b"software: x")]


@pytest.mark.parametrize("data", [b"HTTP/1.1 200 OK\r\n\r\n", record("response", "<a>", b"abc")[:-6], b"WARC/1.1\r\nWARC-Type: x"])
def test_broken_archives(data):
    with pytest.raises(ValueError):
        list(warc.parse([data]))


def test_parse_in_pieces():
    data = record("response", "<a>", b"x" * 50) + record("metadata", "<m>", b"", "WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <b>")
    for n in (1, 7, 1000):
        found = list(warc.parse(data[i : i + n] for i in range(0, len(data), n)))
        assert [b for _, b in found] == [b"x" * 50, b""] and [v for k, v in found[1][0] if k == "warc-concurrent-to"] == ["<a>", "<b>"]


def test_transactions(spark):
    rows = [("<r>", "response", []), ("<q>", "request", ["<r>"]), ("<m>", "metadata", ["<q>"]), ("<v>", "revisit", ["<q2>"]), ("<q2>", "request", []), ("<m2>", "metadata", ["<q2>"]), ("<x>", "metadata", ["<gone>"]), ("<n>", "metadata", ["<r>", "<r>"])]
    got = warc.transactions(spark.createDataFrame(rows, "record_id string, type string, concurrent_to array<string>"))
    assert sorted(map(tuple, got.collect())) == [("<m2>", "<v>"), ("<m>", "<r>"), ("<n>", "<r>"), ("<q2>", "<v>"), ("<q>", "<r>")]


def test_files_are_bounded_however_sizes_vary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 400_000)
    monkeypatch.setattr(warc, "SIZES", (2_000, 20_000, 100_000, 400_000))
    rows = [(i, f"http://h/{i}", "s" * 50) for i in range(3000)] + [(5000 + i, "http://h/", f"{i}" * 9_000) for i in range(300)] + [(9000, "http://h/", "x" * 900_000)]
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), f"{tmp_path}/a", "page_id", "url", "html")
    files = list((tmp_path / "a").rglob("*.gz"))
    sizes = sorted(len(b"".join(warc._inflated(f.read_bytes()))) for f in files)
    assert sizes[-1] > 900_000 and sizes[-2] <= 400_000 and len(sizes) > 10
    assert warc.read(spark, f"{tmp_path}/a").filter("type = 'response'").count() == len(rows)


def test_edge_cases(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGES), f"{tmp_path}/none", "page_id", "url", "html")
    assert warc.assemble(warc.read(spark, f"{tmp_path}/none")).count() == 0
    df = spark.createDataFrame([(None, "u", "t", "a", "b"), (1, "u", "t", "a", "b"), (1, "u", "t", "a", "b")], PAGES + ", id string, HTML string")
    warc.write(df, f"{tmp_path}/some", "page_id", "url", "html")
    got = warc.assemble(warc.read(spark, f"{tmp_path}/some"))
    assert sorted((str(r.k), r.type) for r in got.select(warc.capture_key(got.record_id, "bigint").alias("k"), "type").collect()) == [("1", "response"), ("1", "response"), ("None", "response")]
