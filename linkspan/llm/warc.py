"""WARC archives, index first.

Writing makes one archive for each task and an index row (path, offset, length, url, digest)
for each record, kept as a table. Reading starts from the index: the selected records are
sorted by archive and offset, ranges that lie close together are read at once, and the
records are parsed from them. Records are gzip members of their own, so any can be read alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import cut, fresh_path

#: Payloads of fewer bytes than this are always written as responses.
MIN_DEDUP_BYTES = 0
#: A read covers at most so many bytes, and skips at most so many that are not wanted.
RANGE_BYTES, GAP_BYTES = 8 << 20, 64 << 10
#: A task reads about so many bytes of archives.
READ_BYTES = 4 << 20
#: Payloads that occur more than once are broadcast if there are at most so many, each of about 60 bytes.
BROADCAST_ROWS = 200_000
INDEX = "page_id long, path string, offset long, length long, url string, digest string, payload_bytes long, record_type string"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"urn:linkspan:page:{'' if page_id is None else page_id}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member; a revisit has no payload."""
    block = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_uri(page_id)}>", f"WARC-Date: {datetime(2024, 1, 1, tzinfo=UTC):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_uri(refers_to)}>"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def write(pages: DataFrame, path: str, min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """Write a record for each row of ``pages`` below ``path``; returns the index, kept as a table.

    The payload is ``html`` in UTF-8, a null one is empty. Of equal payloads of at least
    ``min_bytes`` bytes the rows with the smallest page_id are responses, the others revisit
    it. Rows without page_id are never referred to if another has one. A null url is
    written as ``urn:none``. Other columns are ignored. Files of failed or repeated attempts
    are in no index.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    # a payload that occurs once needs no look-up, so only the others' digests are joined
    first = cut(rows.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "first-pages")
    dealt = rows.join(F.broadcast(first) if first.count() <= BROADCAST_ROWS else first, "sha", "left").select("page_id", "url", "payload", "first_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, folder = pyarrow.fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        name = f"part-{context.partitionId() if context else 0}-{uuid.uuid4().hex}.warc.gz"
        offset, out = 0, None
        for batch in batches:
            found = []
            for page_id, url, body, first_id in zip(*(c.to_pylist() for c in batch.columns)):
                revisit = len(body) >= min_bytes and first_id is not None and page_id != first_id
                digest = sha1_base32(body)
                packed = record(page_id, url, body, digest, first_id, revisit)
                out = out or store.open_output_stream(f"{folder}/{name}", compression=None)
                out.write(packed)
                found.append((page_id, f"{path}/{name}", offset, len(packed), url, digest, len(body), "revisit" if revisit else "response"))
                offset += len(packed)
            if found:
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out:
            out.close()

    return cut(dealt.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """Read the records that the rows of ``index`` name, in coalesced ranges.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, all from the
    records. A response whose payload does not have its digest raises an error.
    """

    def parsed(member: bytes) -> tuple:
        headers, http, payload = parse(member)
        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(http.rpartition(b"Content-Length: ")[2])
        if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
        number = lambda x: int(x) if (x := headers.get(x, "").strip("<>").rpartition(":")[2]) else None
        return number("WARC-Record-ID"), size, digest, kind, number("WARC-Refers-To")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = list(zip(*(c.to_pylist() for c in batch.columns)))
            out, k = [], 0
            while k < len(wanted):
                path, start, length = wanted[k]
                end, stop = start + length, k + 1
                while stop < len(wanted) and wanted[stop][0] == path and wanted[stop][1] - end <= GAP_BYTES and wanted[stop][1] + wanted[stop][2] - start <= RANGE_BYTES:
                    end, stop = max(end, wanted[stop][1] + wanted[stop][2]), stop + 1
                store, at = pyarrow.fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as file:
                    data = file.read_at(end - start, start)
                out += [parsed(data[a - start : a - start + n]) for _, a, n in wanted[k:stop]]
                k = stop
            if out:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[x.split()[0] for x in RESULT.split(", ")])

    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    ranges = index.select("path", "offset", "length").repartition(max(1, -(-total // READ_BYTES)), "path", F.expr(f"offset div {READ_BYTES}")).sortWithinPartitions("path", "offset")
    return ranges.mapInArrow(run, RESULT)


def archive(pages: DataFrame, min_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """Write all of ``pages`` into archives in the shared folder and read every record back.

    What null, repeated and other odd rows give is said at ``write``. Payloads of any length are
    written and read as wholes; an empty table gives an empty result.
    """
    return read(write(pages, fresh_path(pages.sparkSession, "warc"), min_bytes))
