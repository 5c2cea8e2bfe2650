"""WARC archives, written and read back sequentially (operator 4).

Writing: payloads that repeat are found by digest with a map-side minimum; the rows
to revisit are joined to the pages by id (Spark broadcasts them if they are few,
else both sides are shuffled), and each task writes archives of one gzip member per
record into the folder that driver and executors share.  A task names its archives
afresh in every attempt and hands over their names, so what a lost attempt has left
is never read.

Reading: one archive after the other, one member after the other, with incremental
decompression, framing by Content-Length and verification of both digests as the
bytes pass; nothing but a header is held whole unless the payload is asked for.
Archives of other writers are read too: records of any type, whose payload is what
follows an HTTP header or else the whole block; digests by MD5, SHA-1, SHA-256 or
SHA-512, in hex or base32.  A digest that is absent or of another kind isn't checked,
nor a payload's where HTTP sent it in chunks.  Names that aren't this writer's stand as
they are in record_id and refers_to_id, without a page.

Null html is an empty payload.  Rows that repeat a page_id and a payload are written
alike (all as response, or all as revisit); a null page_id comes after all others.
A revisit's digest is held against the name of the record that it refers to.
Truncated, wrongly framed or altered records raise ValueError with archive and record.
Only page_id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

LEAST_BYTES, ARCHIVE_BYTES, LEVEL, READ = 100, 256 << 20, 6, 1 << 16
#: Digests that are checked, with their bytes.
KINDS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}
#: Pages carry no fetch time; archives of the same pages are the same bytes.
DATE = "1970-01-01T00:00:00Z"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def _name(page_id: int | None, digest: str) -> str:
    """A record's name: pages of one id with other payloads have other names; equal rows are one record, written as often."""
    return f"<urn:page:{'none' if page_id is None else page_id}:{digest[:16]}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit of ``refers_to`` without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    target = re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {_name(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"] if refers_to else []
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n") + squeeze.compress(block) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()


def _member(file, rest: bytes) -> Iterator[bytes]:
    """Decompressed pieces of the member that starts with ``rest``; the generator returns the bytes after it."""
    inflate = zlib.decompressobj(31)
    data = rest
    while not inflate.eof:
        data = data or file.read(READ)
        if not data:
            raise ValueError("the archive ends within a record")
        piece = inflate.decompress(data, READ)
        data = inflate.unconsumed_tail
        if piece:
            yield piece
    return inflate.unused_data


class _Pieces:
    """A member's bytes, taken by length or up to a mark."""

    def __init__(self, file, rest: bytes):
        self.source, self.held, self.after = _member(file, rest), b"", b""

    def more(self) -> bool:
        try:
            self.held += next(self.source)
        except StopIteration as end:
            self.after = end.value
            return False
        return True

    def head(self) -> list[str]:
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            if len(self.held) > 1 << 20 or not self.more():
                raise ValueError("a header without an end")
        found, self.held = self.held[:at].decode("utf-8", "replace").split("\r\n"), self.held[at + 4 :]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("a record shorter than its Content-Length")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece

    def end(self) -> bytes:
        while self.more():
            if len(self.held) > 4:
                break
        if self.held != b"\r\n\r\n":
            raise ValueError("a record longer than its Content-Length")
        return self.after


def _fields(lines: list[str]) -> dict[str, str]:
    """Fields by lower-case name; a line that begins with space goes on with the one before, and of repeated fields the first counts."""
    found: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] = f"{found[name]} {line.strip()}".strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        found.setdefault(name, value.strip())
    return found


def _stated(digest: str | None) -> tuple[str, bytes] | None:
    """(algorithm, bytes) of a labelled digest in hex or base32; None if there is none of a known kind."""
    kind, _, text = (digest or "").partition(":")
    kind, text = kind.strip().lower().replace("-", ""), text.strip()
    if kind not in KINDS:
        return None
    if re.fullmatch(f"[0-9a-fA-F]{{{2 * KINDS[kind]}}}", text):
        return kind, bytes.fromhex(text)
    try:
        return kind, base64.b32decode(text.upper() + "=" * (-len(text) % 8))
    except ValueError:
        raise ValueError(f"a digest that can't be read: {digest}") from None


def records(file, keep: bool = False) -> Iterator[dict]:
    """Every record of an open archive, in order: its fields, and payload_bytes, payload_digest, payload (if ``keep``).

    The digest is the payload's SHA-256; of a revisit, which has none, what its header says
    (SHA-256 in hex, others with their name before; null if nothing).
    """
    rest = file.read(READ)
    while rest:
        pieces = _Pieces(file, rest)
        lines = pieces.head()
        fields = _fields(lines)
        if not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdigit():
            raise ValueError("not a WARC record")
        said = {k: _stated(fields.get(f"warc-{k}-digest")) for k in ("block", "payload")}
        block, payload = (hashlib.new(said[k][0]) if said[k] else None for k in ("block", "payload"))
        own = hashlib.sha256() if payload is None or payload.name != "sha256" else payload
        http: dict[str, str] | None = None if fields.get("content-type", "").lower().startswith("application/http") else {}
        head, size, kept = b"", 0, []
        for piece in pieces.take(int(fields["content-length"])):
            if block is not None:
                block.update(piece)
            if http is None:
                head += piece
                if (at := head.find(b"\r\n\r\n")) < 0:
                    continue
                http, piece = _fields(head[:at].decode("latin-1").split("\r\n")), head[at + 4 :]
            size += len(piece)
            for digest in {id(d): d for d in (payload, own) if d is not None}.values():
                digest.update(piece)
            if keep:
                kept.append(piece)
        rest = pieces.end() or file.read(READ)
        http, revisit = http or {}, fields.get("warc-type") == "revisit"
        if block is not None and block.digest() != said["block"][1]:
            raise ValueError("a block that doesn't match its digest")
        if payload is not None and not revisit and http.get("transfer-encoding", "").lower() in ("", "identity") and payload.digest() != said["payload"][1]:
            raise ValueError("a payload that doesn't match its digest")
        if revisit:  # the payload is elsewhere; what is said of it stands
            sent, known = http.get("content-length", ""), said["payload"]
            size = int(sent) if sent.isdigit() else None
            digest = None if known is None else ("" if known[0] == "sha256" else f"{known[0]}:") + known[1].hex()
        else:
            digest = own.hexdigest()
        yield fields | {"payload_bytes": size, "payload_digest": digest} | ({"payload": b"".join(kept)} if keep else {})


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, revisit (boolean), first (the page that a revisit refers to)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    slim = rows.select("page_id", F.sha2("html", 256).alias("digest"), (F.octet_length("html") >= LEAST_BYTES).alias("large")).filter("large")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id")
    firsts = slim.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first.page_id").withColumnRenamed("page_id", "first")
    again = slim.join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()
    rows = rows.withColumn("digest", F.sha2("html", 256))
    same = F.col("r.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("r.digest") == F.col("a.digest"))
    return rows.alias("r").join(again.alias("a"), same, "left").select("r.*", F.col("a.digest").isNotNull().alias("revisit"), "a.first")


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` as archives below ``folder``; returns (archive, n_records, bytes), which names all that was written."""
    name = uuid.uuid4().hex
    place = f"{folder}/warc-{name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(place)
        out = path = None
        n = size = 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [path], "n_records": [n], "bytes": [size]})

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "revisit", "first")), strict=True):
                page_id, url, html, digest, revisit, first = (x.as_py() for x in row)
                if out is None:
                    store.create_dir(root, recursive=True)
                    path, n, size = f"{place}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{path.rpartition('/')[2]}", compression=None)
                data = record(page_id, url, html.encode(), digest, _name(first, digest) if revisit else None)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return cut(planned(pages).mapInArrow(run, "archive string, n_records long, bytes long"))


def read(archives: DataFrame, keep: bool = False) -> DataFrame:
    """Every record of ``archives`` (archive): page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_id, and payload if ``keep``."""

    def page(name: str | None, digest: str | None) -> int | None:
        """The page that a record of this writer names, which must be one of this payload: of a revisit, what it refers to too."""
        found = re.fullmatch(r"<urn:page:(-?[0-9]+|none):([0-9a-f]{16})>", name or "")
        if found and found[2] != (digest or "")[:16]:
            raise ValueError("a name that isn't that of its payload")
        return int(found[1]) if found and found[1] != "none" else None

    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "record_id": pa.string(), "refers_to_id": pa.string()} | ({"payload": pa.binary()} if keep else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                store, path = _place(archive)
                rows, held = [], 0
                made = lambda rows: pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(kinds.items())})
                with store.open_input_stream(path, compression=None) as file:
                    n = 0
                    try:
                        for x in records(file, keep):
                            digest = x["payload_digest"]
                            name, first = x["warc-record-id"], x.get("warc-refers-to")
                            rows.append((page(name, digest), x.get("warc-target-uri"), x["payload_bytes"], digest, x["warc-type"], page(first, digest), name, first, x.get("payload")))
                            n += 1
                            held += len(x.get("payload", ""))
                            if len(rows) >= 2000 or held > 32 << 20:
                                yield made(rows)
                                rows, held = [], 0
                    except (ValueError, KeyError, zlib.error) as wrong:
                        raise ValueError(f"{archive}, record {n + 1}: {wrong}") from wrong
                if rows:
                    yield made(rows)

    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return archives.select("archive").mapInArrow(run, ", ".join(f"{c} {names[t]}" for c, t in kinds.items()))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(write(table(spark, sf_dir, "pages"), shared_dir(spark)))
    return found.drop("record_id", "refers_to_id")
