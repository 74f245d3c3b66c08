"""Web archives that are written here byte by byte, read back and resolved."""

import gzip

from docloom.llm import revisits, warc


def record(kind, ident, url, date, block, **more):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Target-URI: {url}", f"WARC-Date: {date}"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in more.items()]
    return "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def http(status, headers, body=b""):
    return (f"HTTP/1.1 {status} X\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode() + body


BODY = "<p>héllo\r\n\r\nworld</p>".encode()
TRICKY = b"before WARC/1.0 is no record\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nxyz WARC/1. end"


def archive():
    return [
        record("warcinfo", "i", "", "2024-01-01T00:00:00Z", b"software: test\r\n"),
        record("response", "r1", "http://x.org/a", "2024-01-01T00:00:10Z", http(200, [("ETag", '"e1"'), ("Content-Type", "text/html")], BODY), WARC_Payload_Digest="sha1:P1"),
        record("request", "q", "http://x.org/a", "2024-01-01T00:00:10Z", b"GET /a HTTP/1.1\r\n\r\n"),
        record("revisit", "v1", "http://www.x.org/a?utm_source=z", "2024-01-02T00:00:00Z", http(304, [("Etag", 'W/"e1"'), ("Date", "d")]), WARC_Payload_Digest="sha1:P1"),
        record("response", "r2", "http://x.org/b", "2024-01-01T00:00:00Z", http(200, [("Last-Modified", "m")], b"")),
        record("revisit", "v2", "http://x.org/c", "2024-01-03T00:00:00Z", b""),
    ]


def test_reads_plain_and_gzipped_files(spark, tmp_path):
    records = archive()
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(b"".join(records[:4]))
    (tmp_path / "w" / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[4:]))
    got = {r.record_id: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert set(got) == {"<r1>", "<v1>", "<r2>", "<v2>"}
    r = got["<r1>"]
    assert (r.kind, r.url, r.ts, r.status, r.etag, r.digest) == ("response", "http://x.org/a", 1704067210, 200, '"e1"', "sha1:P1")
    assert bytes(r.payload) == BODY and r.headers == {"etag": '"e1"', "content-type": "text/html"}
    assert got["<v1>"].payload is None and got["<v1>"].status == 304 and bytes(got["<r2>"].payload) == b"" and got["<r2>"].last_modified == "m"
    assert got["<v2>"].status is None and got["<v2>"].headers == {}
    out = {r.record_id: r for r in revisits.resolve(warc.read(spark, str(tmp_path / "w"))).collect()}
    assert (out["<v1>"].outcome, out["<v1>"].ref_id, out["<v1>"].status) == ("resolved", "<r1>", 200) and out["<v2>"].outcome == "missing"
    assert out["<v1>"].headers == {"etag": 'W/"e1"', "date": "d", "content-type": "text/html"}
    payloads = warc.read(spark, str(tmp_path / "w")).where("payload is not null").select("record_id", "payload")
    assert {r.record_id: bytes(r.payload) for r in revisits.attach(revisits.resolve(warc.read(spark, str(tmp_path / "w"))), payloads).collect() if r.payload} == {"<v1>": BODY}


def test_payloads_that_hold_records(spark, tmp_path):
    """The mark of a record inside a payload, whole records inside it, and a file that ends early."""
    inner = b"".join(archive())
    bodies = {"t": TRICKY, "u": inner, "w": b"WARC/1." * 3, "z": b"plain"}
    data = b"".join(record("response", k, f"http://x.org/{k}", "2024-01-01T00:00:00Z", http(200, [("A", "b")], v)) for k, v in bodies.items())
    (tmp_path / "c.warc").write_bytes(data)
    got = {r.record_id: bytes(r.payload) for r in warc.read(spark, str(tmp_path / "c.warc")).collect()}
    assert got == {f"<{k}>": v for k, v in bodies.items()}
    (tmp_path / "d.warc").write_bytes(data[:-6])
    got = {r.record_id: bytes(r.payload) for r in warc.read(spark, str(tmp_path / "d.warc")).collect()}
    assert set(got) == {f"<{k}>" for k in bodies} and bodies["z"].startswith(got["<z>"])
    (tmp_path / "e.warc").write_bytes(b"")
    assert warc.read(spark, str(tmp_path / "e.warc")).count() == 0
