"""WARC archives with revisit records.

Only headers are shuffled: payload digests with page identifiers are aggregated to the smallest page of
each digest, and joined back to say which record is the response and which revisit it. Archives are then
written with fresh headers, one file a task and one gzip member a record, and read back; a revisit carries no payload, so its payload's
size and digest come from the response it refers to.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import SLICE_ROWS, cut, remove_folder, shared_folder

LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:page:"
NO_RECORD = "urn:no-page"
#: Repeated digests are broadcast up to this many (about 100 bytes each), else joined by shuffle.
BROADCAST_DIGESTS = 500_000


def resolve_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, html, digest, refers_to`` for every row; refers_to is null for responses.

    Null payloads count as empty; payloads below ``least`` bytes are never revisits. A digest's response is
    its smallest identifier; rows that repeat it are responses too. A group all of whose identifiers are
    null has only responses.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html")).withColumn("digest", F.sha2("html", 256))
    large = F.octet_length("html") >= least
    # one row a digest and task leaves the map side, so a page that many hosts serve stays small
    firsts = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # only headers have met so far; payloads do not move either while the repeated digests are few
    firsts = cut(firsts)
    if firsts.count() <= BROADCAST_DIGESTS:
        firsts = F.broadcast(firsts)
    marked = rows.join(firsts, "digest", "left")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return marked.withColumn("refers_to", F.when(large & F.col("first").isNotNull() & other, F.col("first"))).select("page_id", "url", "html", "digest", "refers_to")


def clean(value: object) -> str:
    """A header value: line breaks would end it."""
    return str(value).replace("\r", "%0D").replace("\n", "%0A")


def urn(page_id: object) -> str:
    """A record identifier that gives the page's back; a null one has a name of its own."""
    return f"<{NO_RECORD}>" if page_id is None else f"<{RECORD}{quote(str(page_id), safe='')}>"


def page_of(value: str) -> str | None:
    return unquote(value[len(RECORD) + 1 : -1]) if value.startswith(f"<{RECORD}") else None


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object) -> bytes:
    if refers_to is None:
        kind, block = "response", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        kind, block = "revisit", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {clean(url)}"] if url else []
    head += [f"WARC-Payload-Digest: sha256:{digest}"]
    head += [f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(resolved: DataFrame, folder: str) -> DataFrame:
    """Writes one archive a task; returns the manifest ``path, records``, materialised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, opened, uri = 0, None, ""
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, len(b), SLICE_ROWS)):
            for r in batch.to_pylist():
                if opened is None:
                    opened = files.new_file(folder, "pages", ".warc.gz")
                    out, uri = opened.__enter__()
                out.write(gzip.compress(record(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["refers_to"]), 6, mtime=0))
                n += 1
        if opened is not None:
            opened.__exit__(None, None, None)
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n])], ["path", "records"])

    return cut(resolved.mapInArrow(run, "path string, records long"))


def read_records(f: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive."""
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record here")
        headers = {}
        while (line := f.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, f.read(int(headers["content-length"]))


def read_archives(manifest: DataFrame, id_type: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record in the archives.

    A response's size and digest are those of the payload read. A revisit is joined to the response that its header
    names, by page and digest, as several responses may be of one page; its size and digest are that response's.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                got: list[tuple] = []
                with files.open_file(path) as stored, gzip.open(stored) as f:
                    for head, block in read_records(f):
                        kind, payload = head["warc-type"], block.partition(b"\r\n\r\n")[2]
                        full = kind == "response"
                        digest = hashlib.sha256(payload).hexdigest() if full else head["warc-payload-digest"].removeprefix("sha256:")
                        got.append((page_of(head["warc-record-id"]), len(payload) if full else None, digest, kind, page_of(head["warc-refers-to"]) if not full else None))
                        if len(got) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names)
                            got = []
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), kinds, strict=True)], names)

    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    read = manifest.select("path").mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    read = cut(read.select(F.col("page_id").cast(id_type), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type)))
    # only responses that are referred to; a hot one is a small row on this side and its revisits are split on theirs
    names = [F.col("refers_to").alias("page_id"), "payload_digest"]
    asked = read.where("record_type = 'revisit'").select(*names).distinct()
    full = read.where("record_type = 'response'")
    originals = full.join(asked, ["page_id", "payload_digest"]).groupBy("page_id", "payload_digest").agg(F.first("payload_bytes").alias("n"))
    revisits = read.where("record_type = 'revisit'").join(originals.withColumnRenamed("page_id", "refers_to"), ["refers_to", "payload_digest"], "left")
    # a digest that no payload has is not passed on
    known = F.when(F.col("n").isNotNull(), F.col("payload_digest")).alias("payload_digest")
    return full.unionByName(revisits.select("page_id", F.col("n").alias("payload_bytes"), known, "record_type", "refers_to"))


def deduplicate(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` as archives with revisits and returns what they hold when read back, a row a record.

    Identifiers of any type come back as they were, percent-encoded in the records; null ones come back null. An
    empty table writes no file and gives an empty result. Without a ``folder`` the archives are removed once read.
    """
    own = folder or shared_folder(pages.sparkSession, "warc")
    manifest = write_archives(resolve_revisits(pages, id_col, url_col, html_col, least), own)
    read = read_archives(manifest, pages.schema[id_col].dataType.simpleString())
    if folder is None:
        remove_folder(pages.sparkSession, own)
    return read
