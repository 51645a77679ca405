"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that are learned from, at most, beside each operator's bound of rows.
SAMPLE_BYTES = 128 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Where that is unset, a local
    master, as in tests, gets a temporary folder of this machine; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='linkspan-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/linkspan/{name}-{uuid.uuid4().hex}"


#: Where the tables that ``cut`` has returned are.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Lineage ends there, so a lost executor costs one table's tasks and not the whole job,
    and nothing upstream runs twice.
    """
    at = fresh_path(df.sparkSession, name)
    df.write.parquet(at)
    table = df.sparkSession.read.schema(df.schema).parquet(at)
    _PATHS[table] = at
    return table


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder by Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more."""
    for table in tables:
        at = _PATHS.pop(table, None)
        if at:
            delete(table.sparkSession, at)


def bucket3(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 3; remainder 1 is held out of learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0))


def held_out(doc_id: object) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def bounded_sample(rows: DataFrame, bound: int, most_bytes: int = SAMPLE_BYTES, text: str | None = "text") -> DataFrame:
    """About ``bound`` distinct rows with doc_id, of at most about ``most_bytes`` bytes of text if they have one.

    They are chosen by a hash of id and text, so they are the same however the table is
    partitioned. Repeated rows count once. All rows if there are fewer.
    """
    size = F.sum(F.octet_length(text)) if text else F.lit(0)
    total, size = rows.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    share = min(1.0, bound / max(total, 1), most_bytes / max(size, 1))
    drawn = F.pmod(F.xxhash64("doc_id", *([text] if text else []), F.lit(7)), F.lit(2**40)) < int(2**40 * share)
    return (rows.where(drawn) if share < 1 else rows).dropDuplicates()


#: A task works on about so many bytes of a batch at once.
SLICE_BYTES = 1 << 20
#: What a worker keeps between tasks: the class and arguments of one object, and it.
_KEPT: dict[tuple, object] = {}


def kept(make: type, *args: object) -> object:
    """The worker's object ``make(*args)``, made once. A worker keeps one: all others are dropped."""
    if (make, *args) not in _KEPT:
        _KEPT.clear()
        _KEPT[make, *args] = make(*args)
    return _KEPT[make, *args]


def slices(batches: Iterable[pa.RecordBatch], most: int = SLICE_BYTES, keeping: type | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in views of about ``most`` bytes and at least one row each.

    A task's memory so does not follow the batch's size. What another operator has kept in
    the worker is dropped: only an object of the class ``keeping`` stays.
    """
    if any(key[0] is not keeping for key in _KEPT):
        _KEPT.clear()
    for batch in batches:
        rows = max(1, min(batch.num_rows, batch.num_rows * most // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if part.nbytes > 4 * most and part.num_rows > 1:  # a few long rows among short ones
                yield from slices([part], most, keeping)
            else:
                yield part


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """Apply ``fn`` to ``df`` in slices of Arrow batches; rows keep their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield fn(batch)

    return df.mapInArrow(run, schema)


class Memo(dict):
    """A dict by texts or bytes that computes what it lacks.

    It forgets all when its keys would hold about ``most`` bytes with what a dict needs for them.
    """

    def __init__(self, compute: Callable, most: int = 48 << 20, value_bytes: int = 32) -> None:
        super().__init__()
        self.compute, self.most, self.value_bytes, self.size = compute, most, value_bytes, 0

    def __missing__(self, key: str | bytes) -> object:
        if self.size > self.most:
            self.clear()
            self.size = 0
        value = self[key] = self.compute(key)
        self.size += 150 + self.value_bytes + len(key)
        return value


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Where a public tokenizer's file is: in ``folder``, else where the installed package keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
