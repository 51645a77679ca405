"""Near-duplicates of word shingles: by SimHash, checked by exact Jaccard similarity, and exactly by prefix filtering for what SimHash leaves.

Each shingle set has a fingerprint of 64 bits, and fingerprints that differ in few bits are linked over the anchors of
``simhash``. The sets of a link are near-duplicates if their similarity is at least 4/5. Edits that turn more
bits leave similar sets without such a link; those are found by prefix filtering, in which sets that
fingerprints have joined already need no comparison.

Of two shingle sets whose similarity is at least 4/5, under any one order of all shingles,
the first n - ceil(4n/5) + 1 of each share one. So sets meet at these prefix shingles only,
and each pair that meets is verified on whole sets. No pair is lost, whatever the order; an
order that puts common shingles last keeps groups small. How common they are is estimated on
a bounded sample of texts, which changes the work and not the result.

Before that, pairs are held against bitmaps of 2,048 bits, in which each shingle turns one bit:
two sets differ in at least as many shingles as their bitmaps in bits, and similar ones differ
in a ninth of their sizes' sum at most. Of what is left, one pair of each set is verified first,
and then those pairs that this has not joined.

In a group of more than ``SMALL`` sets, each is first compared with a few others only. Sets
that these links join need no comparison any more; all other pairs of the group follow, dealt over
tasks as pairs of parts of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspan.llm import simhash
from linkspan.llm.common import cut, discard, over_batches, slices
from linkspan.llm.graph import components

WIDTH = 5
#: All pairs of a group of at most so many sets are compared at once.
SMALL = 16
#: Sets of a larger group that are compared with each other in one task, and how many times as many are read at once.
MEMBERS, RUN_GROUPS = 512, 512
#: The order of shingles is taken from about so many texts, and at most so many shingles count as common.
ORDER_ROWS, MOST_COMMON = 10_000, 200_000
_FLUSH = 1 << 18
#: Longs of a bitmap.
BITMAP = 32
#: Bits in which the fingerprints of linked sets may differ, as in ``op1_simhash``.
DISTANCE = 4
#: Tables of row numbers with at most so many rows, of about 24 bytes each, are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000

Common = tuple[np.ndarray, np.ndarray]


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted hashes of a text's distinct word shingles; fewer words than ``width`` are one shingle, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(len(words) - width + 1, 1)
    spans = zip(starts[:last].tolist(), ends[min(width, len(words)) - 1 :].tolist())
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans], np.uint64))


def bitmap(own: np.ndarray) -> np.ndarray:
    """A bit for each remainder of shingles: whether their number is odd."""
    odd = np.bincount((own % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def prefix(own: np.ndarray, common: Common) -> np.ndarray:
    """The shingles of a set, the rarest first, that any similar set must share one of with its own."""
    if not len(own):
        return own
    weight = np.zeros(len(own), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], own), len(common[0]) - 1)
        weight = np.where(common[0][at] == own, common[1][at], 0)
    return own[np.lexsort((own, weight))][: len(own) - -(-4 * len(own) // 5) + 1]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least 4/5."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate((a, b)))
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * (len(a) + len(b))


def common_shingles(docs: DataFrame, rows: int = ORDER_ROWS) -> Common:
    """Shingles that occur in several of about ``rows`` distinct texts, sorted, and in how many."""
    total = docs.count()
    edge = int(2**40 * min(1, rows / max(total, 1)))
    sample = docs.select("text").where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(2**40)) < edge).distinct()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(x) for x in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["key"])

    counted = over_batches(sample, run, "key long").groupBy("key").count().where("count > 2")
    top = counted.orderBy(F.desc("count"), "key").limit(MOST_COMMON).collect()
    keys, counts = np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order]


def _keyed(docs: DataFrame, common: Common) -> DataFrame:
    """The rows with a key of their own, their set's hash, size, fingerprint and bitmap, and its prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    at = docs.columns.index("text")
    added = [("_set", pa.int64(), T.LongType()), ("_size", pa.int32(), T.IntegerType()), ("_fp", pa.int64(), T.LongType()), ("_bits", pa.list_(pa.int64()), T.ArrayType(T.LongType())), ("_prefix", pa.list_(pa.int64()), T.ArrayType(T.LongType()))]
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x) for x in batch.column(at).to_pylist()]
        ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
        fps = np.fromiter(map(simhash.majority, sets), np.uint64, len(sets)).view(np.int64)
        values = (ids, [len(s) for s in sets], fps, list(map(bitmap, sets)), [prefix(s, shared.value).view(np.int64) for s in sets])
        for (name, kind, _), column in zip(added, values):
            batch = batch.append_column(name, pa.array(column, kind))
        return batch

    return cut(over_batches(numbered, run, T.StructType([*numbered.schema.fields, *(T.StructField(n, t) for n, _, t in added)])), "shingled")


def _long_enough(n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y])


def _may_be_first(n: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether what follows the places of a shared shingle can be enough, were it the first shared one."""
    return _long_enough(n, x, y) & (9 * (np.minimum(n[x] - at[x], n[y] - at[y])) >= 4 * (n[x] + n[y]))


def runs(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[list[np.ndarray], bool]]:
    """The columns of batches sorted by the first column, cut between its values, and whether they are a slice of one value's rows.

    A value with more than about ``most`` rows comes in slices, so that a task holds no more.
    """
    held: list[list[np.ndarray]] = []
    size, open_key = 0, None

    def cut(columns: list[np.ndarray], whole: bool) -> Iterator[tuple[list[np.ndarray], bool]]:
        """What can be told of the columns; the rows of the last value are held back unless ``whole``."""
        nonlocal held, size, open_key
        if open_key is not None and columns[0][0] == open_key:
            others = np.flatnonzero(columns[0] != open_key)
            end = int(others[0]) if len(others) else len(columns[0])
            yield [c[:end] for c in columns], True
            columns = [c[end:] for c in columns]
        held, size = [], 0
        if not len(columns[0]):
            return
        open_key = None
        others = np.flatnonzero(columns[0] != columns[0][-1])
        last = len(columns[0]) if whole else int(others[-1]) + 1 if len(others) else 0
        if last:
            yield [c[:last] for c in columns], False
        if last < len(columns[0]):
            held, size = [[c[last:] for c in columns]], len(columns[0]) - last

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if held[0][0][0] != held[-1][0][-1]:
            yield from cut([np.concatenate(c) for c in zip(*held)], False)
        if most and size >= most and held:  # one value, and it may go on
            open_key = held[0][0][0]
            yield [np.concatenate(c) for c in zip(*held)], True
            held, size = [], 0
    if held:
        yield from cut([np.concatenate(c) for c in zip(*held)], True)


_MET = "a long, b long, key long, n int, place int"


def meetings(batches: Iterator[pa.RecordBatch], small: int, most: int) -> Iterator[pa.RecordBatch]:
    """From prefix rows by key: pairs (a, b) to verify, and the rows of larger groups, which have no b."""
    for (key, own, n, at), part_of_group in runs(batches, most):
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        few = np.repeat((sizes <= small) & (not part_of_group), sizes)
        xs, ys = [starts[:0]], [starts[:0]]
        for lag in range(1, min(small, int(sizes.max()))):
            y = np.flatnonzero(few[lag:] & (key[lag:] == key[:-lag])) + lag
            good = _may_be_first(n, at, y - lag, y)
            xs.append(y[good] - lag)
            ys.append(y[good])
        large = (sizes > small) | part_of_group
        for start, size in zip(starts[large].tolist(), sizes[large].tolist()):
            order = start + np.random.default_rng(abs(int(key[start]))).permutation(size)  # other partners under each key
            x, y = np.concatenate((np.repeat(order[:1], size - 1), order[:-1])), np.concatenate((order[1:], order[1:]))
            good = _long_enough(n, x, y)
            xs.append(x[good])
            ys.append(y[good])
        x, y, many = np.concatenate(xs), np.concatenate(ys), np.flatnonzero(~few)
        pairs = np.unique(np.sort(np.stack((own[x], own[y]), 1), axis=1), axis=0)
        none = pa.nulls(len(pairs), pa.int64())
        out = [
            [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none.cast(pa.int32()), none.cast(pa.int32())],
            [pa.array(own[many]), pa.nulls(len(many), pa.int64()), pa.array(key[many]), pa.array(n[many], pa.int32()), pa.array(at[many], pa.int32())],
        ]
        for columns in out:
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "key", "n", "place"])


def unjoined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows of larger groups by key, with roots: the pairs with other roots that may be similar.

    A group holds two parts of a key's sets, whose pairs across these are asked for, or one, all of whose pairs are.
    """

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for (key, own, n, at, root, part, within), _ in runs(batches):
        found: list[np.ndarray] = []
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
            for x in range(start, end - 1):
                y = np.flatnonzero((root[x + 1 : end] != root[x]) & (within[x + 1 : end] | (part[x + 1 : end] != part[x]))) + x + 1
                y = y[_may_be_first(n, at, np.full(len(y), x), y)] if len(y) else y
                if len(y):
                    found.append(np.sort(np.stack((np.full(len(y), own[x]), own[y]), 1), axis=1))
                if sum(map(len, found[-1:])) and sum(map(len, found)) >= _FLUSH:
                    yield out(found)
                    found = []
        if found:
            yield out(found)


def _narrow(rows: DataFrame) -> DataFrame:
    """Row numbers, to be broadcast if there are few enough."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _cards(keyed: DataFrame) -> DataFrame:
    """Of each set: its first row, its size, its fingerprint and its bitmap."""
    return cut(keyed.groupBy("_set").agg(F.min("_row").alias("_row"), F.min("_size").alias("n"), F.min("_fp").alias("fp"), F.min("_bits").alias("bits")), "cards")


def _near_fingerprints(cards: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): a pair of sets for each link of SimHash, and for each set whose fingerprint a smaller set has too."""
    first = cut(cards.groupBy("fp").agg(F.min("_set").alias("first")), "distinct-fps")
    linked = simhash.links(first, distance)
    of = lambda fp, name: first.select(F.col("fp").alias(fp), F.col("first").alias(name))
    near = linked.join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    equal = cards.select("fp", F.col("_set").alias("b")).join(first, "fp").where("b <> first").select(F.col("first").alias("a"), "b")
    found = cut(near.union(equal).distinct(), "near-fps")
    discard(first, linked)
    return found


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that no links join yet."""
    root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    return pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def _verified(pairs: DataFrame, keyed: DataFrame, cards: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are similar."""
    of = lambda side: cards.select(F.col("_set").alias(side), F.struct("n", "bits").alias(f"{side}_card"))
    differing = sum((F.bit_count(F.col("a_card.bits")[k].bitwiseXOR(F.col("b_card.bits")[k])) for k in range(BITMAP)), F.lit(0))
    near = pairs.distinct().join(of("a"), "a").join(of("b"), "b").where(9 * differing <= F.col("a_card.n") + F.col("b_card.n"))
    pairs = cut(near.select("a", "b"), "pairs")
    ids = cut(pairs.select(F.col("a").alias("_set")).union(pairs.select(F.col("b").alias("_set"))).distinct(), "pair-sets")
    wanted = cut(cards.join(ids, "_set", "left_semi").select("_row"), "pair-rows")
    texts = keyed.select("_row", "_set", "text").join(_narrow(wanted), "_row", "left_semi").select("_set", "text")

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([shingles(x).tobytes() for x in batch.column(1).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), sets], names=["id", "hashes"])

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (batch.column(k).to_pylist() for k in (2, 3))
        good = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x, y)]
        return batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def checked(some: DataFrame) -> DataFrame:
        left = some.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
        both = left.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
        return cut(over_batches(both, check, "a long, b long"), "similar")

    sets = cut(over_batches(texts, hashes, "id long, hashes binary"), "sets")
    first = checked(pairs.groupBy("b").agg(F.min("a").alias("a")))
    joined = components(first)
    found = cut(first.union(checked(_apart(pairs, joined))), "similar")
    discard(pairs, ids, wanted, sets, joined)
    return found


def _dealt(rows: DataFrame, members: int) -> DataFrame:
    """Rows of groups (key, a, n, place, root) in groups of two parts of a key, or one, with part and within, so that all pairs meet once."""
    # a row for each key of a large group, so that rows need not meet by key to learn their number
    counts = cut(rows.groupBy("key").agg(F.ceil(F.count("*") / members).alias("parts")), "group-sizes")
    parted = rows.join(_narrow(counts), "key").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    other = parted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    # keys that should be equal by chance only add pairs to verify
    key = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", low, high))
    return other.select(key.alias("key"), "a", "n", "place", "root", "part", (low == high).alias("within"))


def _roots(keyed: DataFrame, small: int, members: int) -> DataFrame:
    """(node, root) of all sets that are linked to another."""
    cards = _cards(keyed)
    once = keyed.select("_row", "_set", "_size", "_prefix").join(_narrow(cards.select("_row")), "_row", "left_semi")
    rows = once.select(F.col("_set").alias("a"), F.col("_size").alias("n"), F.posexplode("_prefix").alias("place", "key")).select("key", "a", "n", "place")
    near = _near_fingerprints(cards)
    by_print = _verified(near, keyed, cards)
    printed = components(by_print)
    discard(near)
    met = cut(rows.repartition("key").sortWithinPartitions("key", "a").mapInArrow(lambda x: meetings(x, small, RUN_GROUPS * members), _MET), "meetings")
    links = cut(by_print.union(_verified(_apart(met.where("b is not null").select("a", "b"), printed), keyed, cards)), "links")
    roots = components(links)
    discard(by_print, printed)
    large = met.where("b is null")
    if not large.isEmpty():
        placed = large.join(roots.withColumnRenamed("node", "a"), "a", "left").select("key", "a", "n", "place", F.coalesce("root", "a").alias("root"))
        more = _dealt(placed, members).repartition("key").sortWithinPartitions("key", "a").mapInArrow(unjoined, "a long, b long")
        found = _verified(more, keyed, cards)
        before, roots = roots, components(links.union(found))
        discard(before, found)
    discard(cards, met, links)
    return roots


def keep_one(docs: DataFrame, small: int = SMALL, members: int = MEMBERS) -> DataFrame:
    """The documents less near-duplicates: of each group that links of similar texts connect, one row.

    It is the row with the smallest doc_id; rows without doc_id come last, and of rows with
    the same one any may stay. Null and wordless texts are similar to each other only. Rows that repeat
    are similar. Texts of any length are taken as wholes; other columns may have any names. An empty
    table gives an empty result.
    """
    names = docs.columns
    docs = docs.toDF(*(n if n in ("doc_id", "text") else f"column{k}" for k, n in enumerate(names)))
    keyed = _keyed(docs, common_shingles(docs))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    of_set = cut(keyed.groupBy("_set").agg(least.alias("least")), "rows-of-sets")
    roots = _roots(keyed, small, members)
    placed = of_set.join(roots.withColumnRenamed("node", "_set"), "_set", "left")
    kept = cut(placed.groupBy(F.coalesce("root", "_set").alias("root")).agg(F.min("least").alias("least")).select("least._row"), "kept-rows")
    discard(of_set, roots)
    return keyed.join(_narrow(kept), "_row", "left_semi").select(docs.columns).toDF(*names)
