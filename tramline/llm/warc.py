"""WARC records, and derivatives of responses: linked metadata and plain-text conversion records.

Each response gives two records. The conversion holds the page's plain text, the metadata a JSON envelope of the source's
WARC and HTTP headers, title, links and digests. Both refer to the response's id (WARC-Refers-To) and carry its target, date,
warcinfo id and payload digest; the metadata names the conversion as concurrent. Ids are derived from the source's, so that
a task that runs again writes the same records. Everything is a map over single records: nothing is shuffled.

Damage stays with its record. A payload whose coding is damaged or unknown (Brotli, for one) is read as it came, bytes that
don't fit the charset are replaced, an unknown charset counts as UTF-8. Where a record's own frame is damaged, so that its
headers or length can't be read, it gives one row of the type ``damaged`` with the reason, and what follows it in the same
gzip member or plain file is not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, put_file, tidy
from .site_style import blocks

VERSION = "WARC/1.1"
#: The date of records whose source has none.
DATE = "1970-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of name-based ids
#: A file of a sink is closed at so many bytes before compression.
FILE_BYTES = 64 << 20

_TITLE = re.compile(r"<title[^>]*+>(.*?)</title", re.I | re.S)
_LINK = re.compile(r"""<(a|area|link|img|script|iframe)\s[^>]*?(href|src)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_META = re.compile(r"<meta\s[^>]*+>", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def sha1(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(31).join(parts))}>"


def _line(value: str) -> str:
    """A header value can't hold line ends."""
    return re.sub(r"[\r\n]+", " ", value).strip()


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record's bytes; Content-Length is set here."""
    lines = [VERSION, *(f"{k}: {_line(v)}" for k, v in headers if k.lower() != "content-length"), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> tuple[str, list[tuple[str, str]]]:
    """First line and fields; a line that begins with white space goes on with the last field."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    fields: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and fields:
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            fields.append((k.strip(), v.strip()))
    return lines[0], fields


def get(fields: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in fields if k.lower() == name.lower()), None)


def _members(raw: bytes) -> Iterator[bytes]:
    """A plain file whole; of a compressed one each gzip member, one in memory at a time. A damaged member is an error."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    rest = memoryview(raw)
    while rest[:2] == b"\x1f\x8b":
        stream = zlib.decompressobj(31)
        try:
            out = stream.decompress(rest) + stream.flush()
        except zlib.error as e:
            raise ValueError(f"gzip member: {e}") from e
        if not stream.eof:
            raise ValueError("gzip member ends early")
        rest = rest[len(rest) - len(stream.unused_data) :]
        yield out


def _records(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    at = 0
    while at < len(raw):
        while raw[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(raw):
            break
        if not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("headers end early")
        _, fields = _headers(raw[at:end])
        size = get(fields, "Content-Length") or ""
        if not re.fullmatch("[0-9]{1,18}", size):
            raise ValueError(f"Content-Length is no number: {size[:40]!r}")
        at = end + 4
        if at + int(size) > len(raw):
            raise ValueError("block ends early")
        yield fields, raw[at : at + int(size)]
        at += int(size)


def parse(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """The records of a file, plain or with gzip members: (headers, block). A damaged frame raises ValueError."""
    for member in _members(raw):
        yield from _records(member)


def parse_or_tell(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes] | str]:
    """As ``parse``, but damage ends the member with its reason as text; whole members after it are read."""
    members = _members(raw)
    while True:
        try:
            member = next(members, None)
        except ValueError as e:
            yield str(e)
            return
        if member is None:
            return
        try:
            yield from _records(member)
        except ValueError as e:
            yield str(e)


def response(page_id: int | None, url: str | None, html: str | None, date: str = DATE) -> bytes:
    """A page as the response record that a crawler would have written."""
    payload = (html or "").encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    digest = sha1(payload)
    return build(
        [
            ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(page_id), url or "", digest)),
            ("WARC-Warcinfo-ID", record_id("warcinfo", "pages")), ("WARC-Target-URI", url or "urn:none"), ("WARC-Date", date),
            ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", sha1(block)), ("Content-Type", "application/http; msgtype=response"),
        ],
        block,
    )


def dechunk(body: bytes) -> bytes:
    """A body without chunked transfer coding; from the first damaged chunk on as it came."""
    out, at = [], 0
    while at < len(body):
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(b"[0-9A-Fa-f]{1,12}", size):
            out.append(body[at:])
            break
        n = int(size, 16)
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out)


def inflate(body: bytes, coding: str) -> bytes:
    """A body without its content coding; as it came if that is unknown or damaged. A body that ends early gives what it has."""
    kinds = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ())
    for bits in kinds:
        out, rest = [], body
        try:
            while rest:
                stream = zlib.decompressobj(bits)
                out.append(stream.decompress(rest) + stream.flush())
                rest = stream.unused_data if stream.eof and bits == 31 and stream.unused_data[:2] == b"\x1f\x8b" else b""
            return b"".join(out)
        except zlib.error:
            continue
    return body


def split_http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes, bytes]:
    """(status, headers, body without transfer coding, payload without content coding) of an HTTP response; a block that is
    none is all payload."""
    if not block.startswith(b"HTTP/"):
        return None, [], block, block
    head, _, body = block.partition(b"\r\n\r\n")
    first, fields = _headers(head)
    status = first.split(" ")[1] if " " in first else ""
    codings = lambda name: [c.strip().lower() for k, v in fields if k.lower() == name for c in v.split(",") if c.strip()]
    if "chunked" in codings("transfer-encoding"):
        body = dechunk(body)
    payload = body
    for coding in reversed([*codings("content-encoding"), *(c for c in codings("transfer-encoding") if c != "chunked")]):
        payload = inflate(payload, coding)
    return (int(status) if re.fullmatch("[0-9]{1,9}", status) else None), fields, body, payload


def decode_payload(payload: bytes, http: list[tuple[str, str]]) -> str:
    """By the charset of the header, else of a meta element, else UTF-8; bytes that don't fit are replaced."""
    m = _CHARSET.search(get(http, "Content-Type") or "") or _CHARSET.search(payload[:2048].decode("ascii", "replace"))
    try:
        return payload.decode(m[1] if m else "utf-8", "replace")
    except (LookupError, ValueError):  # no text coding, or one that takes no replacement
        return payload.decode("utf-8", "replace")


def derive(fields: list[tuple[str, str]], block: bytes) -> list[tuple[str, list[tuple[str, str]], bytes]]:
    """A response's derivatives: (type, headers, block) of its metadata and its conversion; none for other records."""
    if (get(fields, "WARC-Type") or "").lower() != "response":
        return []
    source = get(fields, "WARC-Record-ID") or record_id("source", sha1(block))
    status, http, body, payload = split_http(block)
    page = decode_payload(payload, http)
    sent = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
    stated, found = get(fields, "WARC-Payload-Digest"), sha1(body)
    text = "\n".join(b.whole for b in blocks(page)).encode("utf-8", "replace")
    shared = [(k, v) for k, v in fields if k.lower() in ("warc-target-uri", "warc-date", "warc-warcinfo-id")]
    if get(shared, "WARC-Date") is None:
        shared.append(("WARC-Date", DATE))
    shared += [("WARC-Refers-To", source), ("WARC-Source-Payload-Digest", stated or found)]
    text_id, meta_id = record_id("conversion", source), record_id("metadata", source)
    title = _TITLE.search(page)
    envelope = {
        "source": {"record_id": source, "warc_headers": [list(h) for h in fields], "http_status": status, "http_headers": [list(h) for h in http]},
        "payload": {"length": len(body), "digest": found, "digest_matches": stated in (None, found) or stated == sha1(sent)},
        "html": {
            "title": " ".join(unescape(title[1]).split()) if title else None,
            "metas": [m[0] for m in _META.finditer(page)],
            "links": [{"element": m[1].lower(), "url": unescape(m[3] or m[4] or m[5] or "")} for m in _LINK.finditer(page)],
        },
        "conversion": {"record_id": text_id, "length": len(text), "digest": sha1(text)},
    }
    meta = json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")
    return [
        ("metadata", [("WARC-Type", "metadata"), ("WARC-Record-ID", meta_id), *shared, ("WARC-Concurrent-To", text_id), ("WARC-Block-Digest", sha1(meta)), ("Content-Type", "application/json")], meta),
        ("conversion", [("WARC-Type", "conversion"), ("WARC-Record-ID", text_id), *shared, ("WARC-Block-Digest", sha1(text)), ("Content-Type", "text/plain; charset=utf-8")], text),
    ]


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record binary): each page as a response record. Null urls and html count as empty; rows repeat as they do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [response(*x) for x in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["page_id", "record"])

    bound_batches(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(tidy(run), "page_id long, record binary")


DERIVED = (
    "page_id long, record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, "
    "content_type string, content_length long, block_digest string, source_digest string, block string"
)


def derivatives(records: DataFrame) -> DataFrame:
    """(page_id, record) -> two rows for each response record in it, with the headers that link them and the block as text.

    Null records and records of other types give no rows; one whose frame is damaged gives a row of the type ``damaged``
    with the reason as its block, and nulls for what links records.
    """
    names = [x.split(" ")[0] for x in DERIVED.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in DERIVED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for record in parse_or_tell(raw or b""):
                    if isinstance(record, str):
                        rows.append((page_id, "damaged", *[None] * 6, len(raw), None, None, record))
                        continue
                    fields, block = record
                    for kind, head, out in derive(fields, block):
                        h = {k: v for k, v in head}
                        rows.append((
                            page_id, kind, h["WARC-Record-ID"], h["WARC-Refers-To"], h.get("WARC-Concurrent-To"), h.get("WARC-Target-URI"), h["WARC-Date"],
                            h["Content-Type"], len(out), h["WARC-Block-Digest"], h["WARC-Source-Payload-Digest"], out.decode(),
                        ))
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    bound_batches(records.sparkSession)
    return records.select(F.col("page_id").cast("long"), "record").mapInArrow(tidy(run), DERIVED)


def write_files(records: DataFrame, to: str, prefix: str = "part") -> DataFrame:
    """Write (record binary) rows as .warc.gz files under ``to``, a gzip member each; returns (file, records), materialized."""
    from .common import materialize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, file, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            name = f"{prefix}-{part:06d}-{file:06d}.warc.gz"
            put_file(to, name, b"".join(gzip.compress(r, 6, mtime=0) for r in held))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], names=["file", "records"])

        for b in batches:
            for raw in b.column(0).to_pylist():
                if raw is None:
                    continue
                held.append(raw)
                size += len(raw)
                if size >= FILE_BYTES:
                    yield close()
                    file, held, size = file + 1, [], 0
        if held:
            yield close()

    bound_batches(records.sparkSession)
    return materialize(records.select("record").mapInArrow(tidy(run), "file string, records long"), "warc-files")


def read_files(spark: SparkSession, at: str) -> DataFrame:
    """(file, place, record): the records of all .warc and .warc.gz files under ``at``, each with its headers.

    A file is one row of Spark's reader, which bounds it to 2 GB; its members are inflated one at a time. Where a frame is
    damaged, the record is the reason as text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for i, record in enumerate(parse_or_tell(raw)):
                    whole = record.encode() if isinstance(record, str) else build(*record)
                    yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[1]]), pa.array([i], pa.int64()), pa.array([whole], pa.binary())], names=["file", "place", "record"])

    bound_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(at).select("path", "content")
    return files.mapInArrow(tidy(run), "file string, place long, record binary")
