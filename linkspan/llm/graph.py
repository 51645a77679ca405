"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import cut, discard

#: A task replaces about so many links at a time by as many stars as they have components.
RUN_LINKS = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links that is not the smallest it reaches over them, and that smallest node."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, least = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(least[x], least[y]), np.maximum(least[x], least[y])
        open_ = low < high
        x, y = x[open_], y[open_]
        np.minimum.at(least, high[open_], low[open_])
        while (least[least] != least).any():
            least = least[least]
    leaf = least != np.arange(len(nodes))
    return nodes[leaf], nodes[least[leaf]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task with the same components and no more rows than nodes, run by run."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = stars(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays(list(map(pa.array, found)), names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= RUN_LINKS:
            yield out(held)
            held = []
    if held:
        yield out(held)


def _large_star(edges: DataFrame) -> DataFrame:
    """Both sides of the join are scans, so AQE can split the key of a hub."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star-min")
    out = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")), "large-star")
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    least = cut(edges.groupBy("a").agg(F.min("b").alias("m")), "small-star-min")
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = cut(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
    discard(least)
    return out


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or the leaf of one root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root"))
    ends = ends.union(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return not roles.where((F.col("up") > 1) | (F.col("up") > 0) & (F.col("root") > 0)).count()


def components(edges: DataFrame) -> DataFrame:
    """From links (a, b), both long, to (node, root): each linked node and the smallest node it reaches.

    Self links and nulls take no part, repeated links count once, no links give an empty
    table. Roots have a row of their own. Only a yes or no comes to the driver.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = cut(clean.mapInArrow(_contracted, "a long, b long").distinct(), "edges")
    while not _are_stars(now):
        large = _large_star(now)
        discard(now)
        now = _small_star(large)
        discard(large)
    linked = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = cut(linked.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
    discard(now)
    return roots
