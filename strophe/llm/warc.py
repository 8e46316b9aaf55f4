"""WARC archives, written from pages and read back as a table of chunks."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import passing, redealt, scratch, stored

#: Bytes of a payload that are held at once, in reading and writing.
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_PAGE = "<urn:strophe:page:{}>"

CHUNKS = "record_id string, page_id long, record_type string, refers_to long, declared_digest string, declared_bytes long, chunk_no int, data binary, bytes_so_far long, digest_so_far string, last boolean"


def _header(value: str | None) -> str:
    """A value that fits on a header line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m.group()):02X}", value or "")


def plan(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages as page_id, url, payload (bytes of the html; null: none), sha1 (hex) and refers_to.

    Of pages with equal payloads of at least min_bytes bytes, the one with the largest page_id is the response and the others refer to it; all other pages have refers_to null. Equal payloads are those with the same SHA-1 and length. The largest page_id of each payload is found by an aggregate over digests alone, summed up before the shuffle; for the join that brings it to the pages it is dealt anew, so that Spark may split a payload that has very many copies. Repeated rows of the largest page_id are all responses; a null page_id never is one while another page has the payload.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest = pages.select("page_id", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n"))
    last = digest.where(F.col("n") >= min_bytes).groupBy("sha1", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select(F.col("sha1").alias("_sha1"), F.col("n").alias("_n"), "first")
    p = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    p = p.join(redealt(last, "_sha1", "_n"), (F.col("sha1") == F.col("_sha1")) & (F.octet_length("payload") == F.col("_n")), "left")
    return p.select("page_id", "url", "payload", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _record(page_id, url, payload: memoryview, sha1: str, refers_to) -> Iterator[bytes]:
    """The bytes of a record, the payload in chunks."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_PAGE.format('null' if page_id is None else page_id)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_header(url)}"] if url is not None else []), f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_PAGE.format(refers_to)}"] if revisit else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (0 if revisit else len(payload))}", "", "",
    ]
    yield "\r\n".join(lines).encode("utf-8", "replace")
    yield http
    if not revisit:
        for at in range(0, len(payload), CHUNK):
            yield bytes(payload[at : at + CHUNK])
    yield b"\r\n\r\n"


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of plan() to gzipped archives in folder (a URI that driver and executors share), one for each task, a gzip member for each record; gives the list of archives (path, n_records).

    The list is written as a table when this returns, so each archive is written once. An archive's name holds its task attempt: what a lost or repeated attempt has left is on no list and does not matter. A task without rows writes no archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, out, n = TaskContext.get(), None, 0
        for b in batches:
            payloads = b.column("payload")
            for k in range(b.num_rows):
                if out is None:
                    store, path = pafs.FileSystem.from_uri(folder)
                    store.create_dir(path, recursive=True)
                    path = f"{path}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
                    out = store.open_output_stream(path)
                row = [b.column(c)[k].as_py() for c in ("page_id", "url", "sha1", "refers_to")]
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                for part in _record(row[0], row[1], memoryview(payloads[k].as_buffer() or b""), row[2], row[3]):
                    out.write(pack.compress(part))
                out.write(pack.flush())
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64())})

    return stored(planned.mapInArrow(run, "path string, n_records long"), "archives")


def _headers(f: io.BufferedReader) -> dict[str, str]:
    out = {}
    while (line := f.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _page(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:strophe:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def chunks(f: io.BufferedReader, chunk: int = CHUNK) -> Iterator[tuple]:
    """The rows of CHUNKS for every record of an unpacked archive. A payload is held a chunk at a time; the digest goes on from chunk to chunk. An empty payload has one empty chunk, and so has a revisit, whose digest and length are declared only."""
    while version := f.readline():
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        h = _headers(f)
        left, kind = int(h["content-length"]), h["warc-type"]
        declared_bytes = None
        if h.get("content-type", "").startswith("application/http"):
            while (line := f.readline()) not in (b"\r\n", b""):
                left -= len(line)
                if line.lower().startswith(b"content-length:"):
                    declared_bytes = int(line.split(b":")[1])
            left -= 2
        fixed = (h["warc-record-id"], _page(h["warc-record-id"]), kind, _page(h.get("warc-refers-to")), h.get("warc-payload-digest", "").removeprefix("sha1:"), declared_bytes)
        so_far, n, number = hashlib.sha1(), 0, 0
        while True:
            data = f.read(min(chunk, left))
            if len(data) < min(chunk, left):
                raise ValueError("an archive ends within a record")
            left -= len(data)
            n += len(data)
            so_far.update(data)
            yield *fixed, number, data, n, base64.b32encode(so_far.digest()).decode(), left == 0
            number += 1
            if not left:
                break


def read(archives: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of archives (path): a row for each record and chunk number, with the record's headers, the chunk's bytes, and the length and digest of the payload up to its end. Archives are dealt to as many tasks as there are, in turn; no archive, no rows."""
    n = archives.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("chunk_no", pa.int32()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_())])
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path) as raw, gzip.GzipFile(fileobj=raw) as unpacked:
                    for row in chunks(io.BufferedReader(unpacked, 1 << 18), chunk):
                        rows.append(row)
                        held += len(row[7])
                        if held >= 4 * chunk or len(rows) >= 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return archives.select("path").repartition(max(1, n)).mapInArrow(run, CHUNKS)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and gives the chunk table that is read back from them.

    A null html is an empty payload, a null url has no target line. Very long pages are written and read a chunk at a time. Repeated rows are records of their own; an empty table gives no archive and no rows. Other columns do not matter. The archives go when the driver ends.
    """
    folder = scratch(pages.sparkSession, "warc")
    archives = write(plan(pages, min_bytes), folder)
    if archives.isEmpty():
        return pages.sparkSession.createDataFrame([], CHUNKS)
    passing(pages.sparkSession, folder)
    return read(archives, folder)


def records(table: DataFrame) -> DataFrame:
    """From a chunk table, for each record: page_id, payload_bytes, payload_digest, record_type, refers_to, and verified: whether a response's bytes have the digest and length that its headers say, or a revisit's headers say what the bytes of a response, whose page it refers to, have.

    The payloads are read once; what is joined is a narrow table of the records' ends.
    """
    revisit = F.col("record_type") == "revisit"
    ends = stored(table.where("last").drop("data", "chunk_no", "record_id", "last"), "records")
    of = ends.where(~revisit).select(F.col("page_id").alias("_page"), F.col("digest_so_far").alias("_digest"), F.col("bytes_so_far").alias("_bytes")).distinct().withColumn("_there", F.lit(True))
    told = (F.col("refers_to") == F.col("_page")) & (F.col("declared_digest") == F.col("_digest")) & (F.col("declared_bytes") == F.col("_bytes"))
    return ends.join(redealt(of, "_page", "_digest", "_bytes"), told, "left").select(
        "page_id",
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes_so_far")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        "record_type",
        "refers_to",
        F.when(revisit, F.coalesce("_there", F.lit(False))).otherwise((F.col("digest_so_far") == F.col("declared_digest")) & (F.col("bytes_so_far") == F.col("declared_bytes"))).alias("verified"),
    )
