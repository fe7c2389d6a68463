"""WARC archives: one gzip member per record, revisit records for repeated payloads, and a sequential reader that checks them.

Archives go to a fresh folder below `spark.checkpoint.dir`, each under a name of its own; a table of the archives whose task
ended well says which count, so a retried or doubled task leaves at most an unread file. The reader takes an archive in blocks,
inflates member by member, frames each record by its Content-Length and compares both digests; it never holds a whole archive.

Defined cases: a null html is an empty payload; a null url is an empty target; of records with equal payloads the one with the
largest page_id is the response (all rows that share that id and payload, if it is repeated); where all ids are null they
are responses. Null ids are written without the id field and read as null.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmap.llm.graph import stored
from siftmap.session import new_path

#: An archive is closed once it has this many bytes.
ARCHIVE_BYTES = 64 << 20
BLOCK = 1 << 16
LEVEL = 4


class BadRecord(ValueError):
    """A record that breaks the format or fails a digest."""


def sha1_base32(*parts: bytes) -> str:
    h = hashlib.sha1()
    for p in parts:
        h.update(p)
    return base64.b32encode(h.digest()).decode()


def filesystem(path: str):
    """The store of a path and the path within it, by pyarrow: local files, HDFS, S3 and what else it knows."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def record(page_id, url: str, payload: bytes, digest: str, refers_to, level: int = LEVEL) -> bytes:
    """One gzip member: a response, or a revisit of page `refers_to` with headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(c for c in url if c not in "\r\n")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
    ]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        head.append(("X-Refers-To-Page-ID", str(refers_to)))
    head.append(("Content-Length", str(len(block))))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gz.compress(text.encode()) + gz.compress(block) + gz.compress(b"\r\n\r\n") + gz.flush()


def _members(source, block: int = BLOCK) -> Iterator[Iterator[bytes]]:
    """The inflated pieces of each gzip member of a stream, at most `block` bytes at a time."""
    rest = source.read(block)
    while rest:
        inflate = zlib.decompressobj(31)

        def pieces():
            nonlocal rest
            while not inflate.eof:
                if not rest:
                    rest = source.read(block)
                    if not rest:
                        raise BadRecord("the archive ends within a member")
                out = inflate.decompress(rest, block)
                rest = inflate.unconsumed_tail or (inflate.unused_data if inflate.eof else b"")
                if out:
                    yield out

        own = pieces()
        yield own
        for _ in own:  # what the caller has left
            pass
        rest = rest or source.read(block)


class _Framed:
    """Reads lines and counted bytes from pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes:
        while mark not in self.held:
            if len(self.held) > most:
                raise BadRecord("a header without an end")
            more = next(self.pieces, None)
            if more is None:
                raise BadRecord("the record ends within its header")
            self.held += more
        head, _, self.held = self.held.partition(mark)
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held:
                self.held = next(self.pieces, None) or b""
                if not self.held:
                    raise BadRecord("the record is shorter than its Content-Length")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part

    def rest(self) -> bytes:
        return self.held + b"".join(self.pieces)


def _fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if colon:
            out[k.decode().strip().lower()] = v.decode("utf-8", "replace").strip()
    return out


def read(source, block: int = BLOCK) -> Iterator[dict]:
    """page_id, record_type, payload_bytes, payload_digest, refers_to of each record, in order; digests are checked."""
    for member in _members(source, block):
        r = _Framed(member)
        start, _, head = r.until(b"\r\n\r\n").partition(b"\r\n")
        if not start.startswith(b"WARC/1."):
            raise BadRecord(f"no WARC version: {start[:20]!r}")
        h = _fields(head)
        size = int(h["content-length"])
        whole, body, held, http = hashlib.sha1(), hashlib.sha1(), b"", None
        n = 0
        for part in r.take(size):
            whole.update(part)
            if http is None:
                held += part
                if b"\r\n\r\n" not in held:
                    continue
                http, _, part = held.partition(b"\r\n\r\n")
            n += len(part)
            body.update(part)
        if r.rest() != b"\r\n\r\n":
            raise BadRecord("the record does not end after its Content-Length")
        if http is None:
            raise BadRecord("no HTTP header")
        if h["warc-block-digest"] != "sha1:" + base64.b32encode(whole.digest()).decode():
            raise BadRecord("block digest")
        digest = base64.b32encode(body.digest()).decode()
        revisit = h["warc-type"] == "revisit"
        if not revisit and h["warc-payload-digest"] != f"sha1:{digest}":
            raise BadRecord("payload digest")
        declared = int(_fields(http)["content-length"])
        if not revisit and declared != n:
            raise BadRecord("payload length")
        yield {
            "page_id": int(h["x-page-id"]) if "x-page-id" in h else None,
            "payload_bytes": declared,
            "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"),
            "record_type": h["warc-type"],
            "refers_to": int(h["x-refers-to-page-id"]) if revisit else None,
        }


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all pages (page_id, url, html) in `folder`; returns the stored table of their paths, bytes and records."""
    page = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    digests = page.select("page_id", F.unhex(F.sha1("html")).alias("digest")).distinct()
    newest = digests.groupBy("digest").agg(F.max("page_id").alias("last"))
    repeats = digests.join(newest, "digest").where("page_id < last OR (page_id IS NULL AND last IS NOT NULL)").select(
        F.col("page_id").alias("p"), F.col("digest").alias("d"), "last")
    digest = F.unhex(F.sha1("html"))
    marked = page.withColumn("digest", digest).join(repeats, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    rows = marked.select("page_id", "url", F.when(F.col("last").isNull(), F.col("html")).alias("html"), F.octet_length("html").alias("n"), "digest", "last")

    def run(batches):
        out, path, n, count = None, "", 0, 0
        for row in _rows(batches):
            for page_id, url, html, size, digest, last in row:
                if out is None:
                    path, n, count = f"{folder}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    store, local = filesystem(path)
                    store.create_dir(local.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(local)
                payload = (html or "").encode()
                gz = record(page_id, url, payload, base64.b32encode(digest).decode(), last) if last is None else revisit(page_id, url, size, base64.b32encode(digest).decode(), last)
                out.write(gz)
                n, count = n + len(gz), count + 1
                if n >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [n], "records": [count]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [n], "records": [count]})

    return stored(rows.mapInArrow(run, "path string, bytes bigint, records bigint"), "archives")


def _rows(batches, step: int = 64) -> Iterator[Iterator[tuple]]:
    """The rows of Arrow batches, a few at a time as Python values."""
    for batch in batches:
        for i in range(0, len(batch), step):
            yield zip(*(c.to_pylist() for c in batch.slice(i, step).columns))


def revisit(page_id, url: str, size: int, digest: str, refers_to) -> bytes:
    """A revisit record of a payload that isn't at hand: its length is declared, its bytes are the response's."""
    return record(page_id, url, _Sized(size), digest, refers_to)


class _Sized:
    def __init__(self, n: int):
        self.n = n

    def __len__(self) -> int:
        return self.n


def read_back(archives: DataFrame) -> DataFrame:
    """One row per record of the archives in `path`; archives are read by as many tasks as there are cores."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, local = filesystem(path)
                rows: list[dict] = []
                with store.open_input_stream(local) as source:
                    for r in read(source):
                        rows.append(r)
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    spark = archives.sparkSession
    some = archives.select("path").repartition(max(2, spark.sparkContext.defaultParallelism))
    return some.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    return pa.RecordBatch.from_pylist(rows, kinds)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages' archives and reads them again."""
    folder = folder or new_path(pages.sparkSession, "warc")
    return read_back(write(pages, folder))
