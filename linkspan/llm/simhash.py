"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits, cut into three segments of 23, 23 and 18 bits. Each segment is
covered by the perfect binary Golay code (covering radius 3; the short segment is padded
with zeros), and an anchor is a pair of code words for two of the segments.

If two fingerprints differ in at most t bits, some two segments hold at most 2t/3 of them.
Over these two segments there is a midpoint within half of that, t/3 bits, of both, so the
anchor that covers the midpoint is within the covering radius plus that share of the
threshold of both. Each fingerprint is replicated to the anchors that cover the words in
that reach, and fingerprints are compared only where they share an anchor. No link is lost.

Anchors with more than ``HOT`` fingerprints go to the finest covering code instead, the one
with every word as an anchor and radius 0: each fingerprint is replicated to all words
within t/2, rounded up. Those that meet at a word are linked without a comparison where t is
even, and compared where it is odd. At most as many fingerprints can meet there as there are
words within t/2, so no group is unbounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import cut, discard, over_batches
from linkspan.llm.graph import components

#: An anchor with more fingerprints than this is dealt to the finest code.
HOT = 4096
#: Fingerprints that one task replicates to anchors.
REPLICATE_ROWS = 8192
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fixed value: a generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, width: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 for a null text or one without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64))


def majority(found: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 if there are none."""
    at = found.view(np.uint8).reshape(-1, 8) + np.arange(0, 2048, 256)
    ones = np.einsum("ib,bj->ij", np.bincount(at.ravel(), minlength=2048).reshape(8, 256), _BITS).ravel()
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(x) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def _remainders(n_bits: int) -> np.ndarray:
    out = np.arange(1 << n_bits, dtype=np.int64)
    for bit in range(n_bits - 1, 10, -1):
        out ^= np.where(out >> bit & 1, GOLAY << (bit - 11), 0)
    return out


class Golay:
    """Nearest code word of 23-bit words, as its 12 leading bits."""

    def __init__(self) -> None:
        self.rest = _remainders(23).astype(np.int16)
        self.error = np.zeros(2048, np.int64)
        for n in (1, 2, 3):
            for bits in combinations(range(23), n):
                word = sum(1 << b for b in bits)
                self.error[self.rest[word]] = word

    def __call__(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.rest[words]]) >> 11


def _flips(bits: list[int], most: int) -> np.ndarray:
    """All masks of at most ``most`` of the given bits."""
    masks = [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(bits, n)]
    return np.array(masks, np.uint64)


def anchors(fps: np.ndarray, code: Golay, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint) pairs: each fingerprint at every anchor in its reach, once."""
    reach = -(-(2 * distance // 3) // 2)
    keys, owners = [], []
    for number, (p, q) in enumerate(combinations(SEGMENTS, 2)):
        bits = [*range(p[0], p[0] + p[1]), *range(q[0], q[0] + q[1])]
        words = fps[:, None] ^ _flips(bits, reach)[None, :]
        parts = [code((words >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64)) for s, n in (p, q)]
        found = np.sort(number << 24 | parts[0] << 12 | parts[1], axis=1)
        first = np.ones(found.shape, bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        keys.append(found[first])
        owners.append(np.repeat(fps, first.sum(1)))
    return np.concatenate(keys), np.concatenate(owners)


def _forest(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is within ``distance``: each newly reached fingerprint to its root."""
    left, links = fps, []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for part in np.array_split(front, -(-len(front) // 256)):
                near |= (np.bitwise_count(part[:, None] ^ left[None, :]) <= distance).any(0)
            front, left = left[near], left[~near]
            if len(front):
                links.append((front, np.full(len(front), root)))
    return links


def links_of_runs(batches: Iterator[pa.RecordBatch], distance: int | None) -> Iterator[pa.RecordBatch]:
    """Links among fingerprints that share an anchor, from batches sorted by anchor.

    Without a distance, all that share an anchor are linked to the first of them.
    """

    def link(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        a, b = [fps[:0]], [fps[:0]]
        if distance is None:
            a, b = [fps], [np.repeat(fps[starts], sizes)]
        else:
            small = np.repeat(sizes <= 16, sizes)
            for lag in range(1, min(16, int(sizes.max()))):
                close = small[lag:] & (keys[lag:] == keys[:-lag]) & (np.bitwise_count(fps[lag:] ^ fps[:-lag]) <= distance)
                a.append(fps[lag:][close])
                b.append(fps[:-lag][close])
            for start, size in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist()):
                for x, y in _forest(fps[start : start + size], distance):
                    a.append(x)
                    b.append(y)
        pairs = np.stack((np.concatenate(a), np.concatenate(b)), 1).view(np.int64)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
        if held[0][0][0] == held[-1][0][-1]:
            continue  # one run so far, and it may go on
        keys, fps = (np.concatenate(x) for x in zip(*held))
        last = int(np.searchsorted(keys, keys[-1]))
        held = [(keys[last:], fps[last:])]
        yield link(keys[:last], fps[:last])
    if held:
        yield link(*(np.concatenate(x) for x in zip(*held)))


def _linked(at: DataFrame, distance: int | None) -> DataFrame:
    dealt = at.repartition("anchor").sortWithinPartitions("anchor", "fp")
    return dealt.mapInArrow(lambda batches: links_of_runs(batches, distance), "a long, b long")


def links(fps: DataFrame, distance: int = 4, hot: int = HOT) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within ``distance`` bits."""

    def replicate(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, owners = anchors(batch.column(0).to_numpy().view(np.uint64), Golay(), distance)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners.view(np.int64))], names=["anchor", "fp"])

    def to_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _flips([*range(64)], -(-distance // 2))
        for batch in batches:
            for part in np.array_split(batch.column(0).to_numpy().view(np.uint64), -(-batch.num_rows // 256)):
                words = (part[:, None] ^ masks[None, :]).ravel().view(np.int64)
                owners = np.repeat(part, len(masks)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(owners)], names=["anchor", "fp"])

    tasks = max(1, -(-fps.count() // REPLICATE_ROWS))
    at = cut(over_batches(fps.select("fp").repartition(tasks, "fp"), replicate, "anchor long, fp long"), "anchors")
    heavy = cut(at.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"), "hot-anchors")
    if heavy.isEmpty():
        found = cut(_linked(at, distance), "links")
    else:
        crowd = at.join(heavy, "anchor", "left_semi").select("fp").distinct().mapInArrow(to_words, "anchor long, fp long")
        # two that meet at a word differ in at most twice the radius, which is the distance where that is even
        found = cut(_linked(at.join(heavy, "anchor", "left_anti"), distance).union(_linked(crowd, distance if distance % 2 else None)), "links")
    discard(at, heavy)
    return found


def near_duplicates(docs: DataFrame, distance: int = 4, hot: int = HOT) -> DataFrame:
    """Each row's fingerprint and the smallest doc_id it reaches over links.

    Takes doc_id and text; other columns are ignored whatever their names. Rows with equal
    fingerprints are linked. A null or wordless text has fingerprint 0. Repeated rows stay,
    with equal results. A null doc_id takes part by its text but is never a component_id
    unless all ids reached are null. An empty table gives an empty result.

    Returns doc_id long, fp long, component_id long.
    """
    rows = cut(fingerprints(docs), "fingerprints")
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fps")
    found = links(distinct, distance, hot)
    roots = components(found)
    discard(found)
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    placed = cut(placed, "placed")
    smallest = cut(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    by_fp = cut(placed.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "by-fp")
    discard(distinct, roots, placed, smallest)
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def digest_rows(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``near_duplicates``."""
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return near_duplicates(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")
