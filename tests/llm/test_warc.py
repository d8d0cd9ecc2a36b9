import gzip
import hashlib

import pytest
from leadgrid.llm import warc
from leadgrid.sources.storage import scratch_path

RECORD = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
COLUMNS = "page_id long, url string, html string, payload string, digest string, id string"


def pages():
    rows = [
        (1, "u1", "x" * 2000), (2, None, "x" * 2000), (3, "u3\r\nEvil: 1", None), (4, "u", "a" + RECORD * 3 + "é" * 700),
        (5, "u", "x" * 2000), (6, "v", "y" * 999), (7, "v", "y" * 999), (None, "n", "z" * 1500), (None, "n", "x" * 2000), (8, "w", RECORD),
        (9, "q", RECORD * 50), (10, "q", warc.MAGIC * 300), (11, "q", "big" * 20000 + RECORD), (12, "q", "big" * 20000 + RECORD),
        (12, "q", "big" * 20000 + RECORD), (13, "", ""), (-4, "neg", "\r\n\r\n" * 400),
    ]
    return rows + [(100 + i, "u", f"p{i} " * (i % 400)) for i in range(300)]


def expected(rows):
    best = {}
    for i, _, html in rows:
        if html and len(html.encode()) >= 1000 and i is not None:
            best[html] = max(best.get(html, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        keep = best.get(html, i) if len(data) >= 1000 else i
        same = i == keep
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if same else "revisit", None if same else keep))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "d", "i") for r in rows], COLUMNS).repartition(3)


@pytest.fixture(params=["128m", "3000", "700"])
def split_size(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], request.param)
    spark.conf.set(names[1], "1")
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def test_roundtrip_over_splits(spark, split_size):
    got = warc.roundtrip(frame(spark, pages())).collect()
    assert sorted(map(tuple, got), key=repr) == expected(pages())


def test_payloads_come_back(spark, split_size):
    path = scratch_path(spark, "warc-test")
    warc.write(frame(spark, pages()), path)
    got = {(r.id, r.type): r for r in warc.read(spark, path).collect() if r.id is not None}
    for i, url, html in pages():
        if (row := got.get((i, "response"))) is not None:
            assert bytes(row.payload) == (html or "").encode()
            assert row.url == (url.replace("\r", "%0D").replace("\n", "%0A") if url else url if url is None else "")
    assert got[(1, "revisit")].payload is None


def test_foreign_archives(spark, tmp_path):
    """Other letter case, text before the first record, a cut-off header, a cut-off end, and a compressed file."""
    block = "HTTP/1.1 200 OK\r\n\r\npayload"
    record = f"WARC/1.0\r\nWARC-Type: response\r\nCONTENT-LENGTH:  {len(block)}\r\nX: y\r\n\r\n{block}\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record * 3 + record[: -len("load\r\n\r\n")]).encode())
    (tmp_path / "b.warc").write_bytes(("junk" + record).encode())
    (tmp_path / "c.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 7\r\n")
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress((record * 2).encode()))
    rows = warc.read(spark, f"file://{tmp_path}").collect()
    assert sorted(bytes(r.payload) for r in rows) == [b"pay"] + [b"payload"] * 5


def test_records_of_other_kinds(spark, tmp_path):
    """Blocks that are no HTTP, requests, and revisits that tell nothing of their payload."""

    def record(kind, block, *headers):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", *headers, f"Content-Length: {len(block)}"]
        return "\r\n".join(lines) + "\r\n\r\n" + block + "\r\n\r\n"

    info = "software: x\r\n\r\nformat: y"
    request = "GET / HTTP/1.1\r\nHost: x\r\n\r\nbody"
    text = (
        record("warcinfo", info, "Content-Type: application/warc-fields")
        + record("resource", "a\r\n\r\nb", "Content-Type: text/plain", "WARC-Target-URI: file:///x")
        + record("request", request, "Content-Type: application/http; msgtype=request")
        + record("revisit", "HTTP/1.1 200 OK\r\nContent-Length: 12\r\n\r\n")
        + record("revisit", "", "WARC-Payload-Digest: sha1:ABC")
        + record("response", "HTTP/1.1 200 OK\r\n\r\nlast")
    )
    (tmp_path / "a.warc").write_bytes(text.encode())
    got = [(r.type, r.payload and bytes(r.payload).decode(), r.payload_bytes, r.url) for r in warc.read(spark, f"file://{tmp_path}").collect()]
    want = [
        ("warcinfo", info, len(info), None), ("resource", "a\r\n\r\nb", 6, "file:///x"), ("request", "body", 4, None),
        ("revisit", None, 12, None), ("revisit", None, None, None), ("response", "last", 4, None),
    ]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    digests = {r.payload_digest for r in warc.read(spark, f"file://{tmp_path}").collect() if r.type == "revisit"}
    assert digests == {None, "ABC"}


def test_empty(spark):
    assert warc.roundtrip(frame(spark, pages()).limit(0)).collect() == []
