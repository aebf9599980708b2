"""WARC archives from and to a chunked record table.

A record's payload travels as rows (record, chunk number, bytes) of at most
``CHUNK`` bytes, cut right after the scan and joined only inside archives, so no
shuffle, join or Python step holds an oversized payload whole; digests grow chunk
by chunk.  (The scan itself reads an html cell as one value.)

Archives are gzip members, one a record, in the shared folder.  A task writes
files of its own under a fresh name and returns (file, offset, length) rows; a
repeated attempt writes other files, and only what the attempts that count have
returned is ever read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

CHUNK = 1 << 20
#: Bytes of an archive after which a task begins another.
ARCHIVE_BYTES = 1 << 30
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The upper half of record ids; the lower half is the page id, or any number for a page without one.
_RECORDS, _UNNAMED = 0x7F3A5C8E21B44D60, 0x7F3A5C8E21B44D61


def record_id(page: int | None) -> str:
    whole = (_UNNAMED << 64) | (uuid.uuid4().int >> 64) if page is None else (_RECORDS << 64) | (page & (1 << 64) - 1)
    return f"<urn:uuid:{uuid.UUID(int=whole)}>"


def page_of(record: str) -> int | None:
    whole = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = whole & (1 << 64) - 1
    if whole >> 64 == _UNNAMED:
        return None
    return low - (1 << 64) if low >= 1 << 63 else low


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunk_table(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``pages`` (with a binary column payload) as chunk rows: its other columns, chunk_no, chunks and chunk, in order."""
    keep = [c for c in pages.columns if c != "payload"]
    many = F.greatest(F.ceil(F.length("payload") / F.lit(chunk)), F.lit(1)).cast("int")
    wide = pages.withColumn("chunks", many).select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk_no"))
    return wide.select(*keep, "chunk_no", "chunks", F.substring("payload", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("chunk"))


def digests(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes and sha1 (hexadecimal), of chunk rows that lie record by record, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, total = hashlib.sha1(), 0
        for batch in batches:
            pages, sizes, found = [], [], []
            for page, no, many, part in zip(*(batch[c].to_pylist() for c in ("page_id", "chunk_no", "chunks", "chunk")), strict=True):
                if no == 0:
                    sha, total = hashlib.sha1(), 0
                sha.update(part)
                total += len(part)
                if no == many - 1:
                    pages.append(page)
                    sizes.append(total)
                    found.append(sha.digest())
            yield pa.RecordBatch.from_pydict({"page_id": pa.array(pages, pa.int64()), "payload_bytes": pa.array(sizes, pa.int64()), "sha1": pa.array([x.hex() for x in found], pa.string())})

    return frames.mapped(chunks.select("page_id", "chunk_no", "chunks", "chunk"), run, "page_id long, payload_bytes long, sha1 string")


def revisits(found: DataFrame, least: int = 0) -> DataFrame:
    """page_id, sha1 and refers_to of each page whose payload, of ``least`` bytes or more, a page with a smaller id has: the smallest such page."""
    some = found.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    first = some.groupBy("sha1", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to < last").drop("last")
    return some.join(first, ["sha1", "payload_bytes"]).filter("refers_to < page_id").select("page_id", "sha1", "refers_to").distinct()


def header(page: int | None, url: str | None, size: int, digest: str, refers_to: int | None, date: str) -> tuple[bytes, bytes]:
    """The WARC header and the HTTP header of a record."""
    http = _HTTP % size
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (size if refers_to is None else 0)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode(), http


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, chunk: int = CHUNK, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each page and returns where: page_id, path, offset, length, root.

    A page whose payload an earlier page (a smaller id) has is written as a
    revisit without payload; a page without an id is always a response.  A null
    html is an empty payload, a null url ``about:blank``; rows that repeat an id
    are each written, under one record id; other columns are ignored; an empty
    table writes nothing.  Pages that revisit are counted: up to
    ``frames.BROADCAST_ROWS`` of them are broadcast, so payloads stay where they
    are; beyond, their chunks go through a shuffle.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    found = frames.written(digests(chunk_table(rows.select("page_id", "payload"), chunk)), "digests")
    again = frames.written(revisits(found, least), "revisits")
    rows = rows.select("*", F.monotonically_increasing_id().alias("uid"), F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("payload_bytes"))
    parts = chunk_table(rows, chunk).withColumn("url", F.when(F.col("chunk_no") == 0, F.col("url")))
    if again.count() <= frames.BROADCAST_ROWS:
        parts = parts.join(F.broadcast(again), ["page_id", "sha1"], "left")
    else:  # pages without an id, which may be many, take no part in the join
        named = parts.filter("page_id is not null").join(again, ["page_id", "sha1"], "left")
        parts = named.unionByName(parts.filter("page_id is null"), allowMissingColumns=True).sortWithinPartitions("page_id", "sha1", "uid", "chunk_no")
    parts = parts.filter("refers_to is null or chunk_no = 0").withColumn("chunks", F.expr("if(refers_to is null, chunks, 1)"))
    parts = parts.withColumn("chunk", F.when(F.col("refers_to").isNull(), F.col("chunk")).otherwise(F.lit(b"")))
    parts = parts.select("page_id", "url", "payload_bytes", "sha1", "refers_to", "chunk_no", "chunks", "chunk")
    root = f"{frames.shared_dir(spark)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(root)
        out = path = pack = None
        at = begun = 0
        try:
            for batch in batches:
                done = []
                for page, url, size, sha1, refers_to, no, many, part in zip(*(batch[c].to_pylist() for c in batch.schema.names), strict=True):
                    if no == 0:
                        if out is None or at >= archive_bytes:
                            if out is not None:
                                out.close()
                            store.create_dir(base, recursive=True)
                            path, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                            out = store.open_output_stream(path, compression=None)
                        pack, begun = zlib.compressobj(1, zlib.DEFLATED, 31), at
                        for piece in header(page, url, size, base32_sha1(bytes.fromhex(sha1)), refers_to, date):
                            at += out.write(pack.compress(piece))
                    at += out.write(pack.compress(part))
                    if no == many - 1:
                        at += out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                        done.append((page, path, begun, at - begun))
                pages_, paths, offsets, lengths = zip(*done, strict=True) if done else ((), (), (), ())
                yield pa.RecordBatch.from_pydict({"page_id": pa.array(pages_, pa.int64()), "path": pa.array(paths, pa.string()), "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int64())})
        finally:
            if out is not None:
                out.close()

    index = frames.mapped(parts, run, "page_id long, path string, offset long, length long")
    index = frames.written(index.withColumn("root", F.lit(root)), "warc-index")
    frames.forget_later(spark, root)
    return index


def read(index: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of archives that ``write`` made: page_id, record_type, refers_to, payload_bytes and payload_digest as the header has them, chunk_no, chunks and chunk.

    Streams each record; what is held is a few chunks.  A header that is cut
    short raises; an empty index gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no", "chunks", "chunk")
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary())
        held, total = [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*held, strict=True), strict=True)})

        stream = name = store = None
        for batch in batches:
            for root, path, offset, length in zip(*(batch[c].to_pylist() for c in ("root", "path", "offset", "length")), strict=True):
                if path != name:
                    if stream is not None:
                        stream.close()
                    store, _ = pyarrow.fs.FileSystem.from_uri(root)
                    stream, name = store.open_input_file(path), path
                for row in record_chunks(stream, offset, length, chunk):
                    held.append(row)
                    total += len(row[-1])
                    if total >= 8 * chunk or len(held) >= 5000:
                        yield batch_of()
                        held, total = [], 0
        if held:
            yield batch_of()
        if stream is not None:
            stream.close()

    return frames.mapped(index, run, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no int, chunks int, chunk binary")


def record_chunks(stream, offset: int, length: int, chunk: int) -> Iterator[tuple]:
    """The chunk rows of one record (a gzip member of ``length`` bytes at ``offset``)."""
    stream.seek(offset)
    unpack, left, buffer = zlib.decompressobj(31), length, b""

    def more() -> bytes:
        """Up to ``chunk`` bytes more of the record; empty at its end."""
        nonlocal left
        waiting = unpack.unconsumed_tail
        while True:
            if not waiting:
                if not left:
                    return unpack.flush()
                waiting = stream.read(min(left, 1 << 16))
                left -= len(waiting)
            got = unpack.decompress(waiting, chunk)
            if got:
                return got
            waiting = unpack.unconsumed_tail

    def until(mark: bytes) -> bytes:
        nonlocal buffer
        while mark not in buffer:
            got = more()
            if not got:
                raise ValueError("a record ends inside its header")
            buffer += got
        head, _, buffer = buffer.partition(mark)
        return head

    lines = until(b"\r\n\r\n").decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    http = dict(line.split(": ", 1) for line in until(b"\r\n\r\n").decode().split("\r\n")[1:])
    size = int(http["Content-Length"])
    kind = fields["WARC-Type"]
    refers_to = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
    known = (page_of(fields["WARC-Record-ID"]), kind, refers_to, size, fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    stored = size if kind == "response" else 0
    many = max(1, -(-stored // chunk))
    for no in range(many):
        need = min(chunk, stored - no * chunk)
        while len(buffer) < need:
            got = more()
            if not got:
                raise ValueError("a record ends inside its payload")
            buffer += got
        part, buffer = buffer[:need], buffer[need:]
        yield (*known, no, many, part)


def records(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the chunk table that ``read`` gives.

    A response's size and digest are those of the payload as read; it raises
    where they differ from its header.  A revisit has those of its header.  A
    page written without an id comes back without one; no chunks give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, total = hashlib.sha1(), 0
        for batch in batches:
            done = []
            for page, kind, refers_to, size, digest, no, many, part in zip(*(batch[c].to_pylist() for c in batch.schema.names), strict=True):
                if no == 0:
                    sha, total = hashlib.sha1(), 0
                sha.update(part)
                total += len(part)
                if no == many - 1:
                    if kind == "response" and (total, base32_sha1(sha.digest())) != (size, digest):
                        raise ValueError(f"the payload of page {page} differs from its header")
                    done.append((page, size, digest, kind, refers_to))
            cols = list(zip(*done, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)})

    return frames.mapped(chunks, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
