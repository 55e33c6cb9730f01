"""WARC archives through a chunked record table.

A record is rows of (record, chunk number, bytes, digest so far): payloads of more than
``chunk_bytes`` become several rows, and no stage holds more than a chunk of a payload
beside the input row. The writer appends chunks to gzip members, one member a record; the
reader parses the members as they are decompressed and gives the same rows again. The
SHA-256 is carried along the chunks on both sides and checked against the record's own.

Of records with equal payloads of at least ``least_bytes``, the one with the smallest page
number is the response, and the others are revisits of it.

Defined results: a null payload is empty. A null URL has no target header; line breaks in
one are percent-coded. Rows without a page number are revisits if an equal payload has
one, else responses. Rows that repeat a page with its payload are of the same type. An
empty table writes no file. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm import storage
from pageloom.llm.common import written

CHUNK_BYTES = 1 << 20
FILE_BYTES = 256 << 20  # compressed; a file is closed after the record that reaches it
BATCH_BYTES = 4 << 20
LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
CHUNK = f"{RECORD}, chunk int, last boolean, data binary, digest_so_far string"
CHUNK_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    + [("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("digest_so_far", pa.string())]
)
FILE_ARROW = pa.schema([("uri", pa.string()), ("records", pa.int64())])


def typed_records(pages: DataFrame, key: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """Record columns and payload; what repeats is found on digests alone."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), body.alias("body"), F.octet_length(body).cast("bigint").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))
    large = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    repeats = written(large.where("n > 1 AND first IS NOT NULL").select("payload_digest", "first"), "repeated_payloads")
    typed = rows.join(repeats, "payload_digest", "left")
    other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return typed.select("page_id", "url", F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("first")).alias("refers_to"), "payload_bytes", "payload_digest", "body")


def batched(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["data"] or b"") + 200
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=CHUNK_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=CHUNK_ARROW)


def chunk_rows(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Records as chunk rows, in order within their partition; revisits have one empty chunk."""
    names = CHUNK_ARROW.names[:6]

    def chunks(batches):
        for batch in batches:
            columns = [batch.column(n) for n in names]
            for i, body in enumerate(batch.column("body")):
                record = {n: c[i].as_py() for n, c in zip(names, columns)}
                data = body.as_buffer() if record["record_type"] == "response" else pa.py_buffer(b"")
                digest = hashlib.sha256()
                for nr, start in enumerate(range(0, max(1, data.size), chunk_bytes)):
                    part = data.slice(start, min(chunk_bytes, data.size - start)).to_pybytes()
                    digest.update(part)
                    yield record | {"chunk": nr, "last": start + chunk_bytes >= data.size, "data": part, "digest_so_far": digest.hexdigest()}

    return records.mapInArrow(lambda batches: batched(chunks(batches)), CHUNK)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}' if page_id is not None else f'payload {digest}')}>"


def heads(r: dict) -> bytes:
    """WARC header and the HTTP header that begins the block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n".encode()
    revisit = r["record_type"] == "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: {record_id(r['page_id'], r['payload_digest'])}", f"WARC-Date: {DATE}"]
    if r["url"] is not None:
        lines.append("WARC-Target-URI: " + r["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if r["page_id"] is not None:
        lines.append(f"X-Page-ID: {r['page_id']}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(r['refers_to'], '')}", f"X-Refers-To-Page-ID: {r['refers_to']}"]
    lines += [f"WARC-Payload-Digest: sha256:{r['payload_digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if revisit else r['payload_bytes'])}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http


def write(chunks: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write chunk rows to .warc.gz files in a new shared folder; returns their list: uri, records."""
    folder = storage.new_folder(chunks.sparkSession, "warc")

    def run(batches):
        part, nr, uri, out, written_, n, gz = TaskContext.get().partitionId(), 0, None, None, 0, 0, None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    uri, out = storage.create(folder, f"part-{part:06d}-{nr:04d}", ".warc.gz")
                    written_, n, nr = 0, 0, nr + 1
                if row["chunk"] == 0:
                    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
                    written_ += out.write(gz.compress(heads(row)))
                written_ += out.write(gz.compress(row["data"]))
                if row["last"]:
                    if row["record_type"] == "response" and row["digest_so_far"] != row["payload_digest"]:
                        raise ValueError(f"payload of page {row['page_id']} does not have its digest")
                    written_ += out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                    n += 1
                    if written_ >= file_bytes:
                        out.close()
                        yield pa.RecordBatch.from_pylist([{"uri": uri, "records": n}], schema=FILE_ARROW)
                        out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"uri": uri, "records": n}], schema=FILE_ARROW)

    return written(chunks.mapInArrow(run, "uri string, records bigint"), "warc_files")


class Reader:
    """Bytes of an archive, decompressed as they are asked for."""

    def __init__(self, source, block: int = 1 << 20):
        self.source, self.block, self.buffer, self.gz, self.raw = source, block, bytearray(), None, b""

    def fill(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.source.read(self.block)
                if not self.raw:
                    return False
            if self.gz is None:
                self.gz = zlib.decompressobj(31)
            got = self.gz.decompress(self.raw, self.block)
            self.raw = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
            if self.gz.eof:
                self.gz = None
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark) + 1)
            if not self.fill():
                return None
        out = bytes(self.buffer[:found])
        del self.buffer[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.fill():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        if len(out) < n:
            raise EOFError("archive ends within a record")
        return out


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}


def parsed(source, chunk_bytes: int, with_data: bool) -> Iterator[dict]:
    """Chunk rows of an open archive."""
    reader = Reader(source)
    while (head := reader.until(b"\r\n\r\n")) is not None:
        h = fields(head)
        http = reader.until(b"\r\n\r\n")
        left = int(h["content-length"]) - len(http) - 4
        row = {
            "page_id": int(h["x-page-id"]) if "x-page-id" in h else None,
            "url": h.get("warc-target-uri"),
            "record_type": h["warc-type"],
            "refers_to": int(h["x-refers-to-page-id"]) if "x-refers-to-page-id" in h else None,
            "payload_bytes": int(fields(http)["content-length"]),
            "payload_digest": h["warc-payload-digest"].removeprefix("sha256:"),
        }
        digest, nr = hashlib.sha256(), 0
        while True:
            part = reader.take(min(left, chunk_bytes))
            left -= len(part)
            digest.update(part)
            if not left and row["record_type"] == "response" and digest.hexdigest() != row["payload_digest"]:
                raise ValueError(f"payload of page {row['page_id']} does not have its digest")
            yield row | {"chunk": nr, "last": not left, "data": part if with_data else None, "digest_so_far": digest.hexdigest()}
            nr += 1
            if not left:
                break
        reader.take(4)


def read(files: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """Chunk rows of the archives in a list of files (column uri)."""

    def run(batches):
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                with storage.stream(uri) as source:
                    yield from batched(parsed(source, chunk_bytes, with_data))

    return files.select("uri").repartition(max(1, files.count())).mapInArrow(run, CHUNK)


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write a record per row; returns the list of files."""
    return write(chunk_rows(typed_records(pages, key, url, payload, least_bytes), chunk_bytes))


def records(files: DataFrame) -> DataFrame:
    """One row per record in the archives, digests checked against the payloads."""
    return read(files, with_data=False).where("last").drop("chunk", "last", "data", "digest_so_far")
