"""Frame logs as a Spark data source: batch, stream and sink of length-prefixed frames.

A log is read in blocks of ``splitBytes``, each a task of its own. Where the frames of a block
begin is found from the bytes before it: any 1,562 bytes hold a frame's beginning, so from each
place of such a stretch, some way ahead of the block, lengths are followed to the block. Lengths
that cannot be end a wrong trail, and others run into the right one. If one trail is left, the
last frame's beginning on it is the boundary, whatever the frames hold, as the log's own trail is
among those followed. If more are left, the stretch is taken from further ahead. Both blocks at a
boundary find it from the same bytes, and the one before checks that its frames end there.

What a block yields so depends on the log and on ``splitBytes``, not on tasks. A frame that cannot
be ends its block with a row that says why, and the next block finds its own beginning;
``whole_logs`` ends the whole log there instead, as a live reader does.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from linkspan.functions import wire

NAME = "frame_log"
SCHEMA = "path string, offset long, body binary, error string"
#: Bytes of a block, and how far ahead of a block its beginning is looked for at first.
SPLIT_BYTES, AHEAD_BYTES = 64 << 20, 16 << 10
#: Bytes read at once, and rows of a batch.
READ_BYTES, BATCH_ROWS = 4 << 20, 8192
#: A length and the longest frame.
LONGEST = 4 + wire.MAX_STREAM_FRAME


def trail_ends(data: bytes, starts: int) -> list[int]:
    """Where the trails of frames from each of the first ``starts`` places have the beginning of a frame that the data cuts.

    Trails that meet are one; one that comes to a length that cannot be has no end.
    """
    alive, ends = bytearray(len(data) + 1), []
    alive[:starts] = b"\x01" * min(starts, len(alive))
    at = 0
    while at >= 0:
        size = int.from_bytes(data[at : at + 4], "big")
        if len(data) - at < 4 or len(data) - at - 4 < size <= wire.MAX_STREAM_FRAME:
            ends.append(at)
        elif 0 < size <= wire.MAX_STREAM_FRAME:
            alive[at + 4 + size] = 1
        at = alive.find(1, at + 1)
    return ends


def last_boundary(read: Callable[[int, int], bytes], at: int, most: int, ahead: int = AHEAD_BYTES) -> int | None:
    """The last place up to ``at`` where a frame begins, from the bytes before ``at`` alone; None if it cannot be told.

    If no trail leads to ``at``, the log is damaged before it, and a nearer beginning is tried;
    if several do, one further away, up to ``most`` bytes. A log's first byte begins a frame.
    """
    nearer = False
    while True:
        begin = max(at - ahead, 0)
        ends = trail_ends(read(begin, at), LONGEST if begin else 1)
        if len(ends) == 1:
            return begin + ends[0]
        if ends and (nearer or not begin or ahead >= most) or ahead < 4 * LONGEST:
            return None
        nearer = not ends
        ahead = ahead // 2 if nearer else min(4 * ahead, most)


@dataclass
class Block(InputPartition):
    """The frames of a log that begin from the last boundary up to ``start`` on, and end by ``end``; ``closed``: none comes after."""

    path: str
    start: int
    end: int
    closed: bool


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def logs(path: str) -> dict[str, int]:
    """The size of each log: a file, or the files of a folder; names that begin with a dot or underscore are left out."""
    store, at = _opened(path)
    info = store.get_file_info(at)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
    prefix = path.removesuffix("/") if info.is_file else path.rstrip("/")
    named = {prefix + x.path.removeprefix(at.rstrip("/")): x.size for x in found if x.is_file}
    hidden = lambda p: any(part[:1] in "._" for part in p.removeprefix(prefix).strip("/").split("/") if part)
    return {p: size for p, size in sorted(named.items()) if not hidden(p)}


def blocks(path: str, start: int, end: int, split: int, closed: bool) -> list[Block]:
    """The bytes from ``start`` to ``end`` in blocks that begin at multiples of ``split``."""
    edges = [start, *range((start // split + 1) * split, end, split), end] if end > start else []
    return [Block(path, a, b, closed and b == end) for a, b in zip(edges, edges[1:])]


def block_frames(block: Block, split: int) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, body, error) of a block's frames."""
    store, at = _opened(block.path)
    with store.open_input_file(at) as file:
        read = lambda a, b: file.read_at(b - a, a)
        begin = last_boundary(read, block.start, split) if block.start else 0
        end = block.end if block.closed else last_boundary(read, block.end, split)
        if begin is None:
            yield block.start, None, "no_boundary"
            return
        stop = block.end if end is None else end
        data, base = b"", begin
        now = begin
        while now < stop:
            if len(data) - (now - base) < LONGEST and base + len(data) < block.end:
                data = data[now - base :]
                base = now
                data += read(base + len(data), min(base + len(data) + READ_BYTES, block.end))
            place = now - base
            size = int.from_bytes(data[place : place + 4], "big")
            if len(data) - place < 4 or len(data) - place - 4 < size <= wire.MAX_STREAM_FRAME:
                # the next block's boundary is this frame's, unless none comes
                if block.closed:
                    yield now, None, "cut"
                elif end is not None:
                    yield now, None, "unaligned"
                return
            if not 0 < size <= wire.MAX_STREAM_FRAME:
                yield now, None, "bad_length"
                return
            yield now, data[place + 4 : place + 4 + size], None
            now += 4 + size
        if now > stop:
            yield now, None, "unaligned"


def _batches(block: Block, split: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, bytes | None, str | None]] = []

    def out() -> pa.RecordBatch:
        offsets, bodies, errors = zip(*held)
        columns = [pa.array([block.path] * len(held), pa.string()), pa.array(offsets, pa.int64()), pa.array(bodies, pa.binary()), pa.array(errors, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["path", "offset", "body", "error"])

    for row in block_frames(block, split):
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield out()
            held.clear()
    if held:
        yield out()


class FrameLogReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[Block]:
        found = [b for path, size in logs(self.path).items() for b in blocks(path, 0, size, self.split, True)]
        return found or [Block(self.path, 0, 0, False)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.split) if partition.end else iter(())


class FrameLogStream(DataSourceStreamReader):
    """Logs that grow and new ones: an offset is the size of each log so far. A frame comes when its last byte has come."""

    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def initialOffset(self) -> dict:
        return {"sizes": "{}"}

    def latestOffset(self) -> dict:
        return {"sizes": json.dumps(logs(self.path), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Block]:
        before, after = json.loads(start["sizes"]), json.loads(end["sizes"])
        found = [b for path, size in after.items() for b in blocks(path, before.get(path, 0), size, self.split, False)]
        return found or [Block(self.path, 0, 0, False)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.split) if partition.end else iter(())


@dataclass
class Written(WriterCommitMessage):
    name: str
    temporary: str


class FrameLogWriter(DataSourceArrowWriter):
    """One log for each task, moved to its place when all are written."""

    def __init__(self, path: str, column: int, overwrite: bool) -> None:
        self.path, self.column, self.overwrite, self.job = path.rstrip("/"), column, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, at = _opened(self.path)
        folder, number = f"{at}/_temporary-{self.job}", TaskContext.get().partitionId()
        name = f"part-{number:05d}-{self.job[:8]}.frames"
        store.create_dir(folder, recursive=True)
        temporary = f"{folder}/{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as out:
            for batch in iterator:
                parts = []
                for body in batch.column(self.column).to_pylist():
                    if not body or len(body) > wire.MAX_STREAM_FRAME:
                        raise ValueError(f"a frame has 1 to {wire.MAX_STREAM_FRAME} bytes, not {len(body or b'')}")
                    parts += (len(body).to_bytes(4, "big"), body)
                out.write(b"".join(parts))
        return Written(name, temporary)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _opened(self.path)
        if self.overwrite:
            for old in logs(self.path):
                store.delete_file(_opened(old)[1])
        for x in messages:
            if x:
                store.move(x.temporary, f"{at}/{x.name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, at = _opened(self.path)
        if store.get_file_info(f"{at}/_temporary-{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{at}/_temporary-{self.job}")


class FrameLog(DataSource):
    """``spark.read.format("frame_log").load(path)``, ``readStream`` likewise, and ``write``, which takes a binary column ``body``.

    Options: ``path``, a log or a folder of logs in a store that Arrow can open, and ``splitBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[str, int]:
        split = int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT_BYTES)))
        if "path" not in self.options or split < LONGEST:
            raise ValueError(f"frame_log needs a path and splitBytes of at least {LONGEST}")
        return self.options["path"], split

    def reader(self, schema: StructType) -> FrameLogReader:
        return FrameLogReader(*self._options())

    def streamReader(self, schema: StructType) -> FrameLogStream:
        return FrameLogStream(*self._options())

    def writer(self, schema: StructType, overwrite: bool) -> FrameLogWriter:
        return FrameLogWriter(self._options()[0], schema.fieldNames().index("body"), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameLog)


def read_log(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """(path, offset, body, error) of all frames of the logs, in no order; see the module for errors."""
    register(spark)
    return spark.read.format(NAME).option("splitBytes", split).load(path)


def stream_log(spark: SparkSession, path: str, split: int = SPLIT_BYTES) -> DataFrame:
    """The frames of growing logs as a stream, with the rows of ``read_log`` but for a last cut frame, which has not come yet."""
    register(spark)
    return spark.readStream.format(NAME).option("splitBytes", split).load(path)


def write_log(frames: DataFrame, path: str, mode: str = "append") -> None:
    """Write the binary column ``body`` as a log for each partition; other columns are left out."""
    register(frames.sparkSession)
    frames.select(F.col("body").cast("binary").alias("body")).write.format(NAME).mode(mode).save(path)


def whole_logs(frames: DataFrame) -> DataFrame:
    """The rows up to each log's first error, with it: what a reader that gives up there has read.

    Reads the frames twice; logs with errors alone are joined.
    """
    ends = frames.where("error is not null").groupBy("path").agg(F.min("offset").alias("last"))
    return frames.join(ends, "path", "left").where(F.col("last").isNull() | (F.col("offset") <= F.col("last"))).drop("last")
