"""Exact top-k inner products by a vector-approximation file.

Vectors are quantised into cells of equal width per dimension, one byte each, and stored in
blocks that stay where they are. Blocks of queries, of which a wave of bounded size is broadcast
at a time, meet them: one product with the cells' lower corners bounds all scores of a block of
vectors from below and above. What can still be among the best k is read
exactly in the order of its bound: first the k best-bounded, then, as the k-th exact score is
known, only those whose upper bound reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspan.llm.common import cut, delete, discard, fresh_path

K = 5
BITS = 7
#: Vectors in a block of the file, queries in a block of queries, at most.
BLOCK, QUERY_BLOCK = 4096, 512
#: Vectors whose cells one task holds against a wave of queries.
TASK_VECTORS = 8192
#: Bytes of queries that are broadcast at a time, but one block at least.
WAVE_BYTES = 16 << 20
#: Scores that may be larger are computed as decimals.
LONG_SCORE = 2.0**62

_BLOCKS = "dim int, rows binary, ids binary, low binary, step binary, cells binary"


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): components floor(scale * x) as longs.

    A null id, a null vector, or one with null or non-finite components takes no part. A component
    that is no long after scaling is an overflow error.
    """
    sound = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _matrix(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, ids and vectors of a batch (row, vec_id, v), by dimension."""
    rows, ids, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy()
    starts = vectors.offsets.to_numpy()[:-1] - vectors.offsets.to_numpy()[0]
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield rows[at], ids[at], flat[starts[at][:, None] + np.arange(dim)]


def approximate(batches: Iterator[pa.RecordBatch], bits: int = BITS) -> Iterator[pa.RecordBatch]:
    """Blocks of the approximation file: rows, ids, each dimension's least value and cell width, and cells."""
    names = ("rows", "ids", "low", "step", "cells")
    for batch in batches:
        if not batch.num_rows:
            continue
        for rows, ids, v in _matrix(batch):
            for a in range(0, len(ids), BLOCK):
                part = v[a : a + BLOCK]
                low = part.min(0)
                # differences of longs are unsigned
                step = (part.max(0).view(np.uint64) - low.view(np.uint64)) // np.uint64(1 << bits) + np.uint64(1)
                cells = ((part.view(np.uint64) - low.view(np.uint64)) // step).astype(np.uint8)
                values = [rows[a : a + BLOCK], ids[a : a + BLOCK], low, step, cells]
                yield pa.RecordBatch.from_arrays([pa.array([v.shape[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in values)], names=["dim", *names])


def bounded_pairs(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, lower, upper) of what may be among a query's k best of this block."""
    dim = row["dim"]
    get = lambda n, t: np.frombuffer(row[n], t)
    rows, ids, low, step, q_ids = get("rows", np.int64), get("ids", np.int64), get("low", np.int64).astype(np.float64), get("step", np.uint64).astype(np.float64), row["q_ids"]
    corners = low + step * get("cells", np.uint8).reshape(len(ids), dim)
    q = row["q"].reshape(len(q_ids), dim).astype(np.float64)
    base = q @ corners.T
    lower = base + (np.minimum(q, 0) @ (step - 1))[:, None]
    upper = base + (np.maximum(q, 0) @ (step - 1))[:, None]
    # products beyond 2**53 are rounded; the bounds give way by as much
    slack = 1e-12 * (np.abs(q) @ (np.abs(low) + 256.0 * step))[:, None]
    own = q_ids[:, None] == ids[None, :]
    lower = np.where(own, -np.inf, lower - slack * (slack > 1))
    upper = np.where(own, -np.inf, upper + slack * (slack > 1))
    if len(ids) > k:
        least = -np.partition(-lower, k - 1, axis=1)[:, k - 1 : k]
        maybe = (upper >= least) & ~own
    else:
        maybe = ~own
    i, j = np.nonzero(maybe)
    return row["queries"][i], rows[j], lower[i, j], upper[i, j]


def _first(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark limits each task's rows before the shuffle."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def _exact(pairs: DataFrame, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    wide = "decimal(38,0)"
    product = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x).cast(wide)
    # components up to 2**63: a product has 38 digits at most
    exact = F.aggregate(F.zip_with("qv", "v", lambda a, b: (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast(wide)), F.lit(0).cast(wide), lambda s, x: (s + x).cast(wide))
    largest = lambda v: F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    product = F.when(F.size("v") * largest("v") * largest("qv") < LONG_SCORE, product).otherwise(exact)
    both = pairs.select("query", "row").join(candidates, "row").join(queries, "query")
    return both.select("query", "query_id", "vec_id", product.alias("score"), (F.col("times") * F.col("asked")).alias("times"))


def _query_blocks(queries: DataFrame) -> tuple[DataFrame, int, int]:
    """Queries in blocks, the number of blocks, and how many of them make a wave."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = queries.groupBy(F.pmod(F.hash("query"), F.lit(blocks)).alias("block"), F.size("qv").alias("dim")).agg(F.collect_list(F.struct("query", "query_id", "qv")).alias("x"))
    asked = cut(dealt.select("block", "dim", F.col("x.query").alias("queries"), F.col("x.query_id").alias("q_ids"), F.flatten("x.qv").alias("q")), "query-blocks")
    largest = asked.groupBy("block").agg(F.sum(8 * (F.size("q") + 2 * F.size("queries"))).alias("bytes")).agg(F.max("bytes")).first()[0]
    return asked, blocks, max(1, WAVE_BYTES // max(largest or 1, 1))


def search(vectors: DataFrame, every: int = 50, k: int = K, bits: int = BITS) -> DataFrame:
    """Each query's k best vectors by integer inner product, ties to the smaller vec_id.

    Queries are the rows whose vec_id ``every`` divides; candidates are all rows of other ids
    and equal dimension. Fewer than k candidates give as many rows. Rows that take no part (see
    ``integer_vectors``) neither ask nor answer. Scores are exact; one of the result that is no long is an overflow error. Rows that repeat
    a candidate's vec_id answer as often as they are there; of a query id that repeats, all rows
    ask, and the k best of all their answers are the id's. An empty table gives an empty result.
    Columns beyond vec_id and embedding are ignored.

    Returns query_id, rank, vec_id, score.
    """
    counted = integer_vectors(vectors).groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    rows = cut(counted.withColumn("row", F.monotonically_increasing_id()), "integer-vectors")
    # of equal vectors no query can need more than the k + 1 smallest ids (one may be its own)
    candidates = cut(_first(rows, "v", [F.col("vec_id")], k + 1).drop("place"), "candidates")
    queries = cut(rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("times").alias("asked")), "queries")
    asked, blocks, wave = _query_blocks(queries)
    tasks = max(1, -(-candidates.count() // TASK_VECTORS))
    file = cut(candidates.select("row", "vec_id", "v").repartition(tasks, "row").mapInArrow(lambda batches: approximate(batches, bits), _BLOCKS), "approximations")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("dim", "rows", "ids", "low", "step", "cells")}
                row |= {n: batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("queries", "q_ids", "q")}
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in bounded_pairs(row, k)], names=["query", "row", "lower", "upper"])

    # the stated queries against all rows, a wave of blocks at a time
    at, schema = fresh_path(rows.sparkSession, "bounded"), "query long, row long, lower double, upper double"
    for first in range(0, blocks, wave):
        now = asked.where(F.col("block").between(first, first + wave - 1))
        file.repartition(tasks).join(F.broadcast(now), "dim").mapInArrow(scan, schema).write.mode("append").parquet(at)
    maybe = rows.sparkSession.read.schema(schema).parquet(at)
    least = _first(maybe, "query", [F.desc("lower")], k).groupBy("query").agg(F.min("lower").alias("least"), F.count("*").alias("n"))
    left = maybe.join(least, "query").where((F.col("n") < k) | (F.col("upper") >= F.col("least"))).select("query", "row", "upper")
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("upper"), "row"))
    ranked = cut(left.withColumn("place", order), "ranked")
    first = cut(_exact(ranked.where(F.col("place") <= k), candidates, queries), "exact-first")
    known = first.groupBy("query").agg(F.min("score").alias("least"))
    rest = ranked.where(F.col("place") > k).join(known, "query").where("upper >= least")
    scored = cut(first.union(_exact(rest, candidates, queries)), "exact")
    discard(rows, candidates, queries, asked, file, ranked, first)
    delete(rows.sparkSession, at)
    each = scored.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))))
    best = _first(each, "query_id", [F.desc("score"), F.col("vec_id")], k)
    return best.select("query_id", F.col("place").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))
