"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A record is a row: its type, identifiers, all headers in order, and its block. Both derivatives name their source by
WARC-Refers-To (with its target and date), and the metadata record carries the source's own headers and digests, so nothing known of
a response is lost. ``read_warc`` and ``write_warc`` go through Spark's readers and pyarrow's file systems.
"""

from __future__ import annotations

import base64
import gzip
import itertools
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_tree import tokens, visible_text

VERSION = "WARC/1.1"
#: Name space of record identifiers, so that a rerun makes the same ones.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lakequill:warc")
DEFAULT_DATE = "1970-01-01T00:00:00Z"

RECORD = "warc_type string, record_id string, target_uri string, warc_date string, refers_to string, block_digest string, payload_digest string, headers array<struct<name:string,value:string>>, block binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(31).join(map(str, parts)))}>"


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes, payload: bytes | None = None) -> dict:
    """A row of RECORD; length, type, id and digests are set here, the other headers keep their order."""
    given = {k.lower(): v for k, v in headers}
    full = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *headers, ("WARC-Block-Digest", digest(block))]
    if payload is not None:
        full.append(("WARC-Payload-Digest", digest(payload)))
    full.append(("Content-Length", str(len(block))))
    return {
        "warc_type": kind, "record_id": record_id, "target_uri": given.get("warc-target-uri"), "warc_date": given.get("warc-date"),
        "refers_to": given.get("warc-refers-to"), "block_digest": digest(block), "payload_digest": None if payload is None else digest(payload),
        "headers": [{"name": k, "value": v} for k, v in full], "block": block,
    }


# --- HTTP and WARC bytes -------------------------------------------------------------------------------------------


def header_lines(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """First line, headers (continuation lines joined) and body of an HTTP message or a record."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, _, body = block.partition(b"\n\n")
    first, *rest = re.split(r"\r?\n", head.decode("utf-8", "replace"))
    headers: list[tuple[str, str]] = []
    for line in rest:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    return first, headers, body


def http_payload(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The entity: transfer and content codings undone; a body that does not decode is left as it is."""
    known = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in known.get("transfer-encoding", ""):
        out, at = [], 0
        while (end := body.find(b"\r\n", at)) >= 0:
            try:
                size = int(body[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if not size:
                break
            out.append(body[end + 2 : end + 2 + size])
            at = end + 4 + size
        body = b"".join(out) or body
    coding = known.get("content-encoding", "")
    try:
        if coding in ("gzip", "x-gzip"):
            body = gzip.decompress(body)
        elif coding == "deflate":
            try:
                body = zlib.decompress(body)
            except zlib.error:
                body = zlib.decompress(body, -15)
    except (OSError, zlib.error, EOFError):
        pass
    return body


_META = re.compile(rb"<meta[^>]+charset=[\"']?([\w.:-]+)|</head|<body", re.I)


def decode_html(headers: list[tuple[str, str]], payload: bytes) -> tuple[str, str]:
    """(text, charset): the charset of the HTTP header, of the page, or UTF-8; bad bytes are replaced."""
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    m = re.search(r"charset=[\"']?([\w.:-]+)", kind)
    if m is None and (found := _META.search(payload)) and found[1]:  # not beyond the head
        m = re.match("(.*)", found[1].decode("latin-1"))
    charset = m[1].lower() if m else "utf-8"
    try:
        return payload.decode(charset, "replace"), charset
    except LookupError:
        return payload.decode("utf-8", "replace"), "utf-8"


def to_bytes(row: dict, compress: bool = True) -> bytes:
    head = VERSION + "\r\n" + "".join(f"{h['name']}: {h['value']}\r\n" for h in row["headers"]) + "\r\n"
    data = head.encode() + row["block"] + b"\r\n\r\n"
    return gzip.compress(data, mtime=0) if compress else data


def _members(data: bytes) -> Iterator[bytes]:
    """Gzip members one after the other; what follows the last is left out."""
    at, view = 0, memoryview(data)
    while view[at : at + 2] == b"\x1f\x8b":
        member, parts = zlib.decompressobj(31), []
        while not member.eof and at < len(view):
            part = view[at : at + (1 << 16)]
            parts.append(member.decompress(part))
            at += len(part)
        at -= len(member.unused_data)
        yield b"".join(parts) + member.flush()


def parse(data: bytes) -> Iterator[dict]:
    """Records of a WARC file, plain or as gzip members, of which one is held at a time."""
    if data[:2] != b"\x1f\x8b":
        yield from _records(data)
        return
    rest = b""
    for member in _members(data):
        rest += member
        if _whole(rest):
            yield from _records(rest)
            rest = b""
    yield from _records(rest)


def _whole(data: bytes) -> bool:
    """Does the first record of ``data`` end in it."""
    at = data.find(b"WARC/")
    end = data.find(b"\r\n\r\n", at)
    if at < 0 or end < 0:
        return False
    _, headers, _ = header_lines(data[at : end + 4])
    return len(data) >= end + 4 + int({k.lower(): v for k, v in headers}.get("content-length", 0))


def _records(data: bytes) -> Iterator[dict]:
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        _, headers, _ = header_lines(data[at : end + 4])
        known = {k.lower(): v for k, v in headers}
        size = int(known.get("content-length", 0))
        block = data[end + 4 : end + 4 + size]
        yield {
            "warc_type": known.get("warc-type"), "record_id": known.get("warc-record-id"), "target_uri": known.get("warc-target-uri"),
            "warc_date": known.get("warc-date"), "refers_to": known.get("warc-refers-to"), "block_digest": known.get("warc-block-digest"),
            "payload_digest": known.get("warc-payload-digest"), "headers": [{"name": k, "value": v} for k, v in headers], "block": block,
        }
        at = end + 4 + size


# --- tables --------------------------------------------------------------------------------------------------------

_ARROW = pa.schema([
    *((n, pa.string()) for n in ("warc_type", "record_id", "target_uri", "warc_date", "refers_to", "block_digest", "payload_digest")),
    ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary()),
])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files; one file is one task's work, as gzip members cannot be entered midway."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for rows in itertools.batched(parse(content.as_py() or b""), 64):
                    yield pa.RecordBatch.from_pylist(list(rows), _ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def write_warc(records: DataFrame, uri: str) -> None:
    """One .warc.gz file per partition under ``uri``, in any file system pyarrow knows.

    A task writes under a name of its own and renames when it is whole, so a repeated task leaves no part behind.
    """

    def save(rows) -> None:
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        system, base = fs.FileSystem.from_uri(uri)
        system.create_dir(base, recursive=True)
        name = f"{base}/part-{context.partitionId():05d}.warc.gz"
        with system.open_output_stream(f"{name}.{context.taskAttemptId()}", compression=None) as out:
            for row in rows:
                out.write(to_bytes(row.asDict(recursive=True)))
        system.move(f"{name}.{context.taskAttemptId()}", name)

    records.foreachPartition(save)


def responses_from_pages(pages: DataFrame, date: str = DEFAULT_DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``source_id`` and a response record for every page: an HTTP answer with its html in UTF-8; null html is empty."""
    pages = pages.select(F.col(f"`{id_col}`").cast("string").alias("source_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                rows = []
                for source, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    body = (page or "").encode("utf-8", "replace")
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                    headers = [("WARC-Date", date), ("WARC-Target-URI", url or "about:blank"), ("Content-Type", "application/http; msgtype=response")]
                    rows.append({"source_id": source} | record("response", identifier("response", source, url), headers, block, body))
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("source_id", pa.string()), *_ARROW]))

    return pages.mapInArrow(run, f"source_id string, {RECORD}")


def derive(response: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    status, http, body = header_lines(response["block"] or b"")
    if not status.startswith("HTTP/"):
        status, http, body = "", [], response["block"] or b""
    payload = http_payload(http, body)
    page, charset = decode_html(http, payload)
    source_id = response["record_id"] or identifier("unnamed", digest(response["block"] or b""))
    link = [("WARC-Refers-To", source_id)]
    if response["target_uri"]:
        link.append(("WARC-Refers-To-Target-URI", response["target_uri"]))
    if response["warc_date"]:
        link.append(("WARC-Refers-To-Date", response["warc_date"]))
    common = [("WARC-Date", response["warc_date"] or DEFAULT_DATE)]
    if response["target_uri"]:
        common.append(("WARC-Target-URI", response["target_uri"]))

    flow = tokens(page)
    title, links, within = [], [], False
    for token in flow:
        if token.kind == "text" and within:
            title.append(token.value)
        elif token.name == "title":
            within = token.kind == "open" and not title
        elif token.kind == "open" and token.name == "a" and token.value.get("href"):
            links.append(token.value["href"])
    lang = next((t.value.get("lang") for t in flow if t.kind == "open" and t.name == "html"), None)
    clean = lambda v: " ".join(str(v).split())
    text = visible_text(page).encode()
    conversion_id = identifier("conversion", source_id)
    fields = [("source-" + h["name"], h["value"]) for h in response["headers"] or []]
    fields += [("http-status-line", status)] if status else []
    fields += [("http-" + k, v) for k, v in http]
    fields += [("charset-detected", charset), ("title", clean("".join(title)))]
    fields += [("language", lang)] if lang else []
    fields += [("source-payload-digest-computed", digest(payload)), ("conversion", conversion_id)]
    fields += [("outlink", clean(v)) for v in links]
    block = "".join(f"{k}: {clean(v)}\r\n" for k, v in fields).encode()
    return [
        record("metadata", identifier("metadata", source_id), [*common, *link, ("Content-Type", "application/warc-fields")], block),
        record("conversion", conversion_id, [*common, *link, ("Content-Type", "text/plain; charset=utf-8")], text, text),
    ]


def build_derivatives(records: DataFrame, keep: str | None = None) -> DataFrame:
    """A metadata and a conversion record for each response of ``records``; other records give none.

    ``keep`` names one column to carry along. Null blocks count as empty ones, a response without an id
    gets one from its block, repeated rows give repeated records, an empty table an empty one.
    """
    carried = [keep] if keep else []
    wanted = ["record_id", "target_uri", "warc_date", "headers", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                rows = []
                for row in whole.slice(start, 256).to_pylist():
                    extra = {k: row[k] for k in carried}
                    rows += [extra | made for made in derive(row)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([*((k, pa.string()) for k in carried), *_ARROW]))

    source = records.where("warc_type = 'response'").select(*(F.col(k).cast("string") for k in carried), *wanted)
    return source.mapInArrow(run, ", ".join([*(f"{k} string" for k in carried), RECORD]))
