"""WARC archives written and read as streams, with a chunked record table.

Writing: every task writes one ``.warc.gz`` file, a gzip member for each record, and returns the segments of its file
(offset, length) as manifest rows. The manifest is committed as a table, so files of lost or repeated attempts are in no
manifest and are never read. Of records with equal payloads of at least ``LEAST`` bytes, that with the smallest id is a
``response``; the others are ``revisit`` records, which carry the digest and refer to it. Groups of equal payloads are
found from digests; payloads are not shuffled while the repeated digests are few enough to broadcast.

Reading: a task opens a segment, inflates it block by block, and gives rows (record, chunk number, bytes) of at most
``CHUNK`` bytes with the digest and size so far, so no record is ever held whole. The last chunk of a record carries the
digest and size of its full payload. A payload that does not have its stated digest or length, and a segment with another
number of records than the manifest says, are refused.

Defined cases: a null payload is empty; all rows that bear the smallest id of a group are responses; a null id refers to
nothing and sorts after others; control characters in addresses are percent-encoded; an empty table gives no files and
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import prepare, work_dir, write

LEAST = 100
CHUNK = 1 << 20
#: Compressed bytes after which a segment of the manifest ends, and bytes read or inflated at once.
SEGMENT, BLOCK = 4 << 20, 1 << 16
BROADCAST_ROWS = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DIGEST = hashlib.sha256(b"").hexdigest()


def _filesystem(uri: str):
    """File system and path of a URI, as executors see them."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def record_head(record_id: str, url: str | None, size: int, digest: str, refers_to: str | None) -> bytes:
    """Headers of a record up to its payload: WARC, then HTTP."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:record:{record_id}>",
        f"WARC-Target-URI: {clean}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:record:{refers_to}>"]),
        f"Content-Length: {len(http) + (size if refers_to is None else 0)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http


def marked(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = LEAST) -> DataFrame:
    """id, url, payload (null for revisits), size, digest, refers_to."""
    data = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), data.alias("payload"), F.length(data).cast("long").alias("size"), F.sha2(data, 256).alias("digest"))
    again = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = write(again, work_dir(pages.sparkSession) + "/again")
    joined = rows.join(F.broadcast(again) if again.count() <= BROADCAST_ROWS else again, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.withColumn("refers_to", refers).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload"))).select("id", "url", "payload", "size", "digest", "refers_to")


def write_archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """Write one record for each row; returns the folder: ``*.warc.gz`` files and their ``manifest``."""
    spark = prepare(pages.sparkSession)
    folder = folder or work_dir(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, segments = None, f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", []
        at = start = records = 0
        for batch in batches:
            for i in range(batch.num_rows):
                key, url, payload, size, digest, refers = (batch.column(k)[i] for k in range(6))
                if out is None:
                    fs, path = _filesystem(folder)
                    fs.create_dir(path, recursive=True)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                at += out.write(pack.compress(record_head(str(key.as_py()), url.as_py(), size.as_py(), digest.as_py(), None if refers.as_py() is None else str(refers.as_py()))))
                data = payload.as_buffer() if payload.is_valid else b""
                view = memoryview(data)
                for lo in range(0, len(view), BLOCK):
                    at += out.write(pack.compress(view[lo : lo + BLOCK]))
                at += out.write(pack.compress(b"\r\n\r\n") + pack.flush())
                records += 1
                if at - start >= SEGMENT:
                    segments.append((name, start, at - start, records))
                    start, records = at, 0
        if records:
            segments.append((name, start, at - start, records))
        if out is not None:
            out.close()
            cols = zip(*segments)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["file", "start", "length", "records"])

    rows = marked(pages, id_col, url_col, payload_col)
    write(rows.mapInArrow(run, "file string, start long, length long, records long"), f"{folder}/manifest")
    return folder


def inflate(source, length: int) -> Iterator[bytes | None]:
    """Inflated blocks of the gzip members in the next ``length`` bytes of a stream; None after each member."""
    left, data, member = length, b"", None
    while left or data:
        if not data:
            data = source.read(min(BLOCK, left))
            if not data:
                raise EOFError("the segment ends early")
            left -= len(data)
        member = member or zlib.decompressobj(31)
        block = member.decompress(data, BLOCK)
        if block:
            yield block
        if member.eof:
            data, member = member.unused_data, None
            yield None
        else:
            data = member.unconsumed_tail
    if member is not None:
        raise EOFError("the last record ends early")


def parse_head(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}


def chunks_of(blocks: Iterator[bytes | None], chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bytes, str, int, bool]]:
    """(headers, chunk number, bytes, digest so far, size so far, whether it is the last) of every record in turn."""
    held, heads, sha, size, number, want = b"", [], hashlib.sha256(), 0, 0, 0
    for block in blocks:
        if block is None:
            data = held[:-4]
            if len(heads) < 2 or size + len(data) != want:
                raise ValueError("a record is not as long as it says")
            sha.update(data)
            yield {**heads[1], **heads[0]}, number, data, sha.hexdigest(), want, True
            held, heads, sha, size, number, want = b"", [], hashlib.sha256(), 0, 0, 0
            continue
        held += block
        while len(heads) < 2 and (at := held.find(b"\r\n\r\n")) >= 0:
            heads.append({("http " if heads else "") + k: v for k, v in parse_head(held[:at]).items()})
            if len(heads) == 2:
                want = int(heads[0]["content-length"]) - at - 4
            held = held[at + 4 :]
        while len(heads) == 2 and len(held) > chunk + 4:  # the end mark stays behind
            data, held = held[:chunk], held[chunk:]
            sha.update(data)
            size += len(data)
            yield {**heads[1], **heads[0]}, number, data, sha.hexdigest(), size, False
            number += 1


def read_chunks(spark: SparkSession, folder: str, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """record_id, record_type, refers_to, stated_digest, stated_bytes, chunk_no, payload, digest, bytes, last.

    ``digest`` and ``bytes`` run over the record's payload up to and with this chunk. Without ``payloads`` the bytes
    themselves stay in the task.
    """
    prepare(spark)
    manifest = spark.read.schema("file string, start long, length long, records long").parquet(f"{folder}/manifest")
    names = ["record_id", "record_type", "refers_to", "stated_digest", "stated_bytes", "chunk_no", "payload", "digest", "bytes", "last"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.bool_()]
    schema = "record_id string, record_type string, refers_to string, stated_digest string, stated_bytes long, chunk_no long, payload binary, digest string, bytes long, last boolean"
    bare = lambda x: x and x[len("<urn:record:") : -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        for batch in batches:
            for name, start, length, stated in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = _filesystem(folder)
                with fs.open_input_file(f"{path}/{name}") as f:
                    f.seek(start)
                    seen = 0
                    for head, number, data, digest, size, last in chunks_of(inflate(f, length), chunk):
                        seen += last
                        if last and head["warc-type"] == "response" and f"sha256:{digest}" != head["warc-payload-digest"]:
                            raise ValueError("a payload is not what its record says")
                        rows.append((bare(head["warc-record-id"]), head["warc-type"], bare(head.get("warc-refers-to")), head["warc-payload-digest"].removeprefix("sha256:"), int(head["http content-length"]), number, data if payloads else None, digest, size, last))
                        held += 200 + len(data)
                        if held > 4 * CHUNK:
                            yield give()
                            rows, held = [], 0
                    if seen != stated:
                        raise ValueError("a segment has other records than its manifest says")
        if rows:
            yield give()

    segments = manifest.count()
    return manifest.repartition(max(1, min(segments, 20_000))).mapInArrow(run, schema)


def records(chunks: DataFrame) -> DataFrame:
    """A row for each record: record_id, payload_bytes, payload_digest (of the full payload), record_type, refers_to.

    A response's digest and size are those of the bytes read; a revisit's are what it states of the response's payload.
    """
    own = F.col("record_type") == "response"
    return chunks.where("last").select("record_id", F.when(own, F.col("bytes")).otherwise(F.col("stated_bytes")).alias("payload_bytes"), F.when(own, F.col("digest")).otherwise(F.col("stated_digest")).alias("payload_digest"), "record_type", "refers_to")
