import base64
import gzip
import hashlib
import io

import pytest

from signet.llm import warc as W
from signet.llm.common import shared_dir

KINDS = "page_id long, url string, html string, first int"


def brute(rows):
    seen = {}
    for page, _, html, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        seen.setdefault(html or "", page)
    for page, _, html, _ in rows:
        data = (html or "").encode()
        again = len(data) >= 100 and seen[html or ""] != page
        yield (page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", seen[html or ""] if again else None, b"" if again else data)


def test_round_trip_equals_brute_force(spark):
    long = "é\r\n\r\n<p>" * 200_000
    rows = [(i, f"http://h/{i} a\r\nX: y", f"<p>{'copy ' * 40}{i % 7}", 1) for i in range(60)]
    rows += [(100, None, None, 1), (101, "u", "", 1), (102, "u", "short", 1), (103, "u", "short", 1), (104, "u", "é" * 49, 1), (105, "u", "é" * 49, 1), (106, "u", "é" * 50, 1), (107, "u", "é" * 50, 1), (108, "u", long, 1), (-3, "u", long, 1), (None, "u", long, 1)]
    got = W.read(W.write(spark.createDataFrame(rows, KINDS), shared_dir(spark), archive_bytes=2000), keep=True).collect()
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got]
    assert sorted(map(repr, found)) == sorted(map(repr, brute(rows)))


def test_repeats_are_alike_and_no_rows(spark):
    html = "x" * 200
    rows = [(1, "u", html, 0), (1, "u", html, 0), (2, "u", html, 0), (2, "u", html, 0)]
    got = W.read(W.write(spark.createDataFrame(rows, KINDS), shared_dir(spark))).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "response", None)] * 2 + [(2, "revisit", 1)] * 2
    assert W.read(W.write(spark.createDataFrame([], KINDS), shared_dir(spark))).count() == 0


def test_archives_are_members_and_damage_is_found():
    digest = lambda x: hashlib.sha256(x).hexdigest()
    a, b = W.record(1, "u", b"one" * 50, digest(b"one" * 50), None), W.record(2, "u", b"two", digest(b"two"), None)
    assert gzip.decompress(a).startswith(b"WARC/1.1\r\n")
    assert [x["payload"] for x in W.records(io.BytesIO(a + b), True)] == [b"one" * 50, b"two"]
    wrong = [a[:-20], gzip.compress(gzip.decompress(a).replace(b"oneone", b"onetwo", 1)), gzip.compress(gzip.decompress(a)[:-9]), gzip.compress(gzip.decompress(a) + b"more"), gzip.compress(b"no record\r\n\r\n"), W.record(1, "u", b"x", digest(b"y"), None)]
    for data in wrong:
        with pytest.raises(ValueError):
            list(W.records(io.BytesIO(b + data)))


def test_a_revisit_of_another_payload_is_found(spark, tmp_path):
    digest = hashlib.sha256(b"x" * 200).hexdigest()
    for first, good in ((digest, True), ("0" * 64, False)):
        path = tmp_path / f"{first[:4]}.warc.gz"
        path.write_bytes(W.record(1, "u", b"x" * 200, digest, None) + W.record(2, "u", b"x" * 200, digest, W._name(1, first)))
        found = W.read(spark.createDataFrame([(f"file://{path}",)], "archive string"))
        if good:
            assert sorted((r.page_id, r.refers_to) for r in found.collect()) == [(1, None), (2, 1)]
        else:
            with pytest.raises(Exception, match="record 2: a name"):
                found.collect()


def member(kind, block, fields, name="<urn:uuid:1>"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", "WARC-Date: 2026-01-01T00:00:00Z", f"Content-Length: {len(block)}", *fields]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_other_writers(spark, tmp_path):
    body = b"<html>text</html>"
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n" + body
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    kind = "Content-Type: application/http; msgtype=response"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    made = [
        member("warcinfo", b"software: other\r\n", ["Content-Type: application/warc-fields"], "<urn:uuid:0>"),
        member("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", ["Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://a/"]),
        member("response", http, [kind, "WARC-Target-URI: http://a/", f"WARC-Block-Digest: {sha1(http)}", f"WARC-Payload-Digest: {sha1(body)}"], "<urn:uuid:2>"),
        member("response", http, [kind, "WARC-Target-URI: http://b/", "WARC-Block-Digest: SHA-256:" + hashlib.sha256(http).hexdigest().upper(), "WARC-Payload-Digest: blake9:zz"]),
        member("response", chunked, [kind, f"WARC-Payload-Digest: {sha1(b'hello')}"]),
        member("revisit", b"HTTP/1.0 200 OK\r\n\r\n", [kind, f"WARC-Payload-Digest: {sha1(body)}", "WARC-Refers-To:", "  <urn:uuid:2>"]),
        member("resource", body, ["Content-Type: text/html"]),
        member("metadata", b"", []),
    ]
    path = tmp_path / "other.warc.gz"
    path.write_bytes(b"".join(made))
    got = W.read(spark.createDataFrame([(f"file://{path}",)], "archive string"), keep=True).collect()
    assert [r.record_type for r in got] == ["warcinfo", "request", "response", "response", "response", "revisit", "resource", "metadata"]
    assert [r.payload_bytes for r in got] == [17, 0, len(body), len(body), 15, None, len(body), 0]
    assert [bytes(got[i].payload) for i in (2, 3, 6)] == [body] * 3
    assert got[2].payload_digest == got[6].payload_digest == hashlib.sha256(body).hexdigest() and got[5].payload_digest == "sha1:" + hashlib.sha1(body).hexdigest()
    assert {r.page_id for r in got} == {None} and got[2].record_id == got[5].refers_to_id == "<urn:uuid:2>" and got[0].url is None and got[1].url == "http://a/"
    for wrong in (f"WARC-Block-Digest: {sha1(b'no')}", f"WARC-Payload-Digest: {sha1(b'no')}", "WARC-Payload-Digest: sha1:not base32!"):
        with pytest.raises(ValueError):
            list(W.records(io.BytesIO(member("response", http, [kind, wrong]))))
