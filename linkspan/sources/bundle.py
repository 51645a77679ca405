"""Bundles of text files: one long text in ordered parts, with a manifest and an index.

Files are dealt into ranges of their paths and sorted there. Each task writes its range as one
part, a header before each file. The manifest has the parts in order, with the offset, size and
digest of each; the index has the place of each file. A part that a lost task has left behind is
in neither.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WRITTEN = "part int, name string, path string, start long, length long, sha256 string"


def header(path: str) -> str:
    return f"===== {path} =====\n"


def write_bundle(files: DataFrame, out: str, parts: int | None = None) -> None:
    """Write rows (path, text) as a bundle in the folder ``out``, in ascending order of path, then text.

    Each file is its header, its text and a line feed; a null text is empty, a row without path
    has an empty one. Rows that repeat are files each. ``parts`` is how many ranges there are,
    or as many as Spark finds fit.
    """
    rows = files.select(F.coalesce("path", F.lit("")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    # a range's bounds hold a path and a number, not texts; rows of one path are in order of their texts within a part
    tie = F.pmod(F.xxhash64("text"), F.lit(1 << 16))
    ordered = rows.withColumn("tie", tie)
    ordered = ordered.repartitionByRange(parts, "path", "tie") if parts else ordered.repartitionByRange("path", "tie")
    ordered = ordered.sortWithinPartitions("path", "tie", "text").select("path", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name = TaskContext.get().partitionId(), f"part-{uuid.uuid4().hex}.txt"
        whole, at, stream = hashlib.sha256(), 0, None
        store, folder = fs.FileSystem.from_uri(out)
        try:
            for batch in batches:
                found: tuple[list, list, list] = ([], [], [])
                for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                    if stream is None:
                        store.create_dir(folder, recursive=True)
                        stream = store.open_output_stream(f"{folder}/{name}")
                    raw = f"{header(path)}{text}\n".encode()
                    stream.write(raw)
                    whole.update(raw)
                    for column, value in zip(found, (path, at, len(raw))):
                        column.append(value)
                    at += len(raw)
                n = len(found[0])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(([part] * n, [name] * n, *found, [None] * n), (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=[x.split()[0] for x in _WRITTEN.split(", ")])
        finally:
            if stream is not None:
                stream.close()
        if at:
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "path": None, "start": 0, "length": at, "sha256": whole.hexdigest()}], pa.schema([("part", pa.int32()), ("name", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())]))

    # one job writes parts and their rows, so the rows name the parts of the tasks that counted
    ordered.mapInArrow(run, _WRITTEN).write.parquet(f"{out}/_index")


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """(part, name, start, length, sha256) of a bundle's parts: as many rows as parts, with their places in the whole text."""
    parts = spark.read.parquet(f"{out}/_index").where("path is null").drop("path", "start")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))


def index(spark: SparkSession, out: str) -> DataFrame:
    """(path, start, length, name, at): each file's place in the whole text, and in its part."""
    files = spark.read.parquet(f"{out}/_index").where("path is not null").select("name", "path", F.col("start").alias("at"), "length")
    places = manifest(spark, out).select("name", F.col("start").alias("from"))
    return files.join(F.broadcast(places), "name").select("path", (F.col("from") + F.col("at")).alias("start"), "length", "name", "at")


def read_pieces(pieces: DataFrame, out: str, near: int = 1 << 16) -> DataFrame:
    """The pieces (name, at, length and more) with their ``content``, read by byte ranges.

    A part's pieces are read in order and by one task for each stretch of 16 MB; ranges with
    gaps of up to ``near`` bytes are read at once.
    """
    columns = [c for c in pieces.columns if c != "content"]
    schema = pieces.select(columns).schema.add("content", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(out)
        name, file, base, held = None, None, 0, b""
        for batch in batches:
            found = []
            ranges = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("name", "at", "length"))))
            for k, (of, at, length) in enumerate(ranges):
                if of != name:
                    if file:
                        file.close()
                    name, file, base, held = of, store.open_input_file(f"{folder}/{of}"), 0, b""
                if not base <= at <= at + length <= base + len(held):
                    end = at + length
                    for later, start, size in ranges[k + 1 :]:
                        if later != of or not end <= start <= end + near or start + size - at > 4 << 20:
                            break
                        end = start + size
                    base, held = at, file.read_at(end - at, at)
                found.append(held[at - base : at - base + length])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "content"])
        if file:
            file.close()

    ordered = pieces.select(columns).repartition("name", F.expr(f"at div {16 << 20}")).sortWithinPartitions("name", "at")
    return ordered.mapInArrow(run, schema)


def text_of(spark: SparkSession, out: str) -> Iterator[bytes]:
    """The whole text, part after part: for a caller that copies it, as no task or list holds it."""
    store, folder = fs.FileSystem.from_uri(out)
    for row in manifest(spark, out).orderBy("part").toLocalIterator():
        with store.open_input_stream(f"{folder}/{row.name}") as part:
            while data := part.read(1 << 20):
                yield data
