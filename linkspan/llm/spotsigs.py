"""Document fingerprints from spot signatures.

Articles and forms of "to be" are spread evenly over prose and are rare in lists and navigation.
Each such word is an anchor, and it and the content words that follow it are a signature. Where
no anchor has come for a while, each content word is one, so that texts without any, and the
beginnings of texts, have signatures as well. A fingerprint is the bag of a text's signatures, kept
as a set: each further occurrence of a signature is a signature of its own.

A set of n signatures is as similar as ``least`` to sets of n * least to n / least signatures at
most. So sets are dealt into ranges of length that are that wide, and a set meets those of its
own range and the next. There, two sets meet at one of their rarest signatures only, as many as
similar sets cannot all lack; what is left of both behind that place must be enough, and the
whole sets are compared last.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import cut, over_batches, slices
from linkspan.llm.graph import components

#: Words that begin a chain: articles and forms of "to be" in English, German, French and Spanish.
ANCHORS = frozenset(
    """the a an is are was were be been der die das den dem des ein eine einen einem einer ist sind war waren
    le la les un une est sont était el los las una es son era""".split()
)
#: Words that chains leave out, beside these.
COMMON = ANCHORS | frozenset(
    """of and to in that it for on with by as this at from or not und von zu mit sich auf für nicht im als
    et du que pour qui par dans sur au pas avec y de en se del por no con su para al lo""".split()
)
#: Content words of a chain, and how many words without an anchor make each content word one.
CHAIN, GAP = 2, 16
LEAST = 0.8
WORD = re.compile(r"[^\W_]+")
#: Ranges of the order of documents, for each shuffle partition, and rows that a range's bound is estimated from.
RANGES, SAMPLED = 4, 20
#: The most frequent signatures, which so many sets at least hold, go last in the order.
MOST_COMMON, OFTEN = 200_000, 3

Set = np.ndarray  # sorted, unsigned 32-bit hashes


def signatures(text: str | None, chain: int = CHAIN, gap: int = GAP, anchors: frozenset[str] = ANCHORS, common: frozenset[str] = COMMON) -> Set:
    """The hashes of a text's signatures, with the number of the occurrence as their seed; the whole text's, if it has no word, and none of an empty one."""
    if not text:
        return np.zeros(0, np.uint32)
    content: list[str] = []
    begun: list[tuple[str, int]] = []
    since = gap
    for word in WORD.findall(text.lower()):
        anchor = word in anchors
        if word not in common:
            content.append(word)
            anchor = anchor or since >= gap
            since += 1
        elif not anchor:
            since += 1
        if anchor:
            begun.append((word, len(content)))
            if word in anchors:
                since = 0
    hashed, seen, found = xxhash.xxh32_intdigest, {}, []
    for own in [" ".join((word, *content[at : at + chain])) for word, at in begun] or [text]:
        n = seen[own] = seen.get(own, -1) + 1
        found.append(hashed(own.encode("utf-8", "surrogatepass"), n))
    return np.unique(np.array(found, np.uint32))


def shown(own: Set) -> str:
    """A set as text: eight hexadecimal digits for each signature, in order."""
    return own.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> Set:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: Set, b: Set, least: float = 0.0) -> float:
    """The Jaccard similarity of two sets, so that of the bags they stand for, 1 of two empty ones; 0 without comparing them, if their lengths keep it below ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate((a, b)))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text; a null or empty text has an empty one.

    Equal texts have equal fingerprints. Repeated rows each have one; columns beyond doc_id and
    text are ignored whatever their names. An empty table gives an empty result.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([shown(signatures(x)) for x in batch.column(1).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), found], names=["doc_id", "fingerprint"])

    return over_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fingerprint string")


_ORDERED = "bucket long, k long, h long, tail boolean, doc_id long, text string"


def followed(docs: DataFrame) -> DataFrame:
    """The documents in ranges of descending doc_id, each with one more row at its end: the first document of the next range.

    Rows: bucket, k and h, which order a bucket's rows, tail, doc_id, text. After the last
    document comes the first. Rows without doc_id come last, rows with one doc_id in the order
    of their texts' hash. Only sampled keys, some for each range, and the ranges' numbers come
    to the driver.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    # ~x falls as x rises, and takes no value beyond a long's
    keyed = docs.select(F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(2**63 - 1)).alias("k"), F.xxhash64(text).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keys = cut(keyed.select("k", "h"), "order-keys")
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, SAMPLED * ranges / max(keys.count(), 1))
    drawn = keys.where(F.pmod(F.xxhash64("k", "h", F.lit(7)), F.lit(2**40)) < int(2**40 * share)).limit(4 * SAMPLED * ranges)
    sampled = sorted(set(map(tuple, drawn.collect())))
    edges = sampled[len(sampled) // ranges :: max(len(sampled) // ranges, 1)]
    bounds = spark.sparkContext.broadcast(np.array(edges, np.int64).reshape(-1, 2))

    @F.pandas_udf("long")
    def bucket(k: pd.Series, h: pd.Series) -> pd.Series:
        """How many bounds are not beyond (k, h)."""
        by, then = bounds.value[:, 0], bounds.value[:, 1]
        low, high = np.searchsorted(by, k, "left"), np.searchsorted(by, k, "right")
        for i in np.flatnonzero(high > low):
            low[i] += np.searchsorted(then[low[i] : high[i]], h.iloc[i], "right")
        return pd.Series(low.astype(np.int64))

    firsts = keys.groupBy(bucket("k", "h").alias("bucket")).agg(F.min(F.struct("k", "h")).alias("first")).select("bucket", "first.*")
    firsts = cut(firsts, "first-keys")
    numbers = sorted(r.bucket for r in firsts.select("bucket").collect())  # one for each range
    before = spark.createDataFrame(list(zip(numbers, [numbers[-1], *numbers[:-1]])) if numbers else [], "of long, bucket long")
    # as many rows as there are ranges
    heads = keyed.select("k", "h", "text").join(F.broadcast(firsts), ["k", "h"]).dropDuplicates(["k", "h"]).withColumnRenamed("bucket", "of").join(F.broadcast(before), "of")
    rows = keyed.select(bucket("k", "h").alias("bucket"), "k", "h", F.lit(False).alias("tail"), "doc_id", "text")
    return rows.union(heads.select("bucket", "k", "h", F.lit(True), F.lit(None).cast("long"), "text"))


_DIGEST = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def digest_rows(docs: DataFrame) -> DataFrame:
    """Every whole text's fingerprint, that of its edited text, and how like both and the next document's are.

    The next document is the one with the next smaller doc_id, and the first after the last;
    see ``followed`` for rows without doc_id or with the same. The edited text has its last
    third replaced by as much of the next text's beginning, or all of it. Two texts without
    signatures are alike. A null text is an empty one. A single document is its own next one.
    Repeated rows are documents each. Columns beyond doc_id and text are ignored. A task holds
    two texts at a time. An empty table gives an empty result.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, str, Set, str, Set]]:
        """Each document with the one after it, which a tail is for the last of a range."""
        last: tuple = ()
        for batch in batches:
            for bucket, doc_id, tail, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                now = (bucket, doc_id, text, signatures(text))
                if last and last[0] == bucket:
                    yield *last[1:], *now[2:]
                last = () if tail else now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        names = [x.split()[0] for x in _DIGEST.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        held, size = [], 0
        for doc_id, text, own, following, theirs in pairs(slices(batches)):
            changed = edited(text, following)
            new = signatures(changed)
            held.append((doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), shown(own), shown(new), likeness(own, new), likeness(own, theirs)))
            size += 8 * (len(own) + len(new)) + 200
            if size >= 1 << 20:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    ordered = followed(docs).repartition("bucket").sortWithinPartitions("bucket", "tail", "k", "h")
    return ordered.select("bucket", "doc_id", "tail", "text").mapInArrow(run, _DIGEST)


def _ranges(least: float, most: int = 2**31) -> list[int]:
    """The smallest lengths of ranges so wide that a set is similar to none beyond the next one."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(math.floor(edges[-1] / least + 1e-9) + 1)
    return edges


def near_pairs(sets: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, likeness) of the pairs of distinct sets (id, own array<long>) whose Jaccard similarity is ``least`` or more, once.

    Empty sets are similar to none here.
    """
    own = cut(sets.where(F.size("own") > 0).select("id", "own"), "spot-sets")
    counted = own.select(F.explode("own").alias("key")).groupBy("key").count().where(F.col("count") >= OFTEN)
    top = counted.orderBy(F.desc("count"), "key").limit(MOST_COMMON).collect()
    order = np.array(sorted((r[0], r[1]) for r in top), np.int64).reshape(-1, 2)
    shared, edges = own.sparkSession.sparkContext.broadcast(order), _ranges(least)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rarest signatures of each set, of which a similar set shares one, with their places."""
        out: tuple[list, ...] = ([], [], [], [], [])
        for i, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys = np.array(keys, np.int64)
            at = np.minimum(np.searchsorted(shared.value[:, 0], keys), max(len(shared.value) - 1, 0))
            often = np.where(shared.value[at, 0] == keys, shared.value[at, 1], 0) if len(shared.value) else np.zeros(len(keys), np.int64)
            rarest = keys[np.lexsort((keys, often))][: len(keys) - math.ceil(least * len(keys) - 1e-9) + 1]
            for column, values in zip(out, ([i] * len(rarest), [len(keys)] * len(rarest), [int(np.searchsorted(edges, len(keys), "right"))] * len(rarest), range(len(rarest)), rarest.tolist())):
                column.extend(values)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["id", "n", "span", "place", "key"])

    keyed = cut(over_batches(own, run, "id long, n int, span int, place int, key long"), "rare-signatures")
    side = lambda x, span: keyed.select("key", span.alias("span"), F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("place").alias(f"place_{x}"))
    met = side("a", F.explode(F.array(F.col("span"), F.col("span") + 1))).join(side("b", F.col("span")), ["key", "span"])
    n_a, n_b = F.col("n_a"), F.col("n_b")
    enough = (1 + least) * F.least(n_a - F.col("place_a"), n_b - F.col("place_b")) >= least * (n_a + n_b) - 1e-6
    once = (n_a < n_b) | (n_a == n_b) & (F.col("a") < F.col("b"))
    pairs = cut(met.where(once & (n_a >= least * n_b - 1e-6) & enough).select("a", "b").distinct(), "spot-pairs")
    of = lambda x: own.select(F.col("id").alias(x), F.col("own").alias(f"own_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared_n = F.size(F.array_intersect("own_a", "own_b"))
    found = both.withColumn("likeness", shared_n / (F.size("own_a") + F.size("own_b") - shared_n))
    return found.where(F.col("likeness") >= least - 1e-12).select("a", "b", "likeness")


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, fingerprint, class_id, component_id) of every document.

    Documents with equal fingerprints are one class, named by a hash of the fingerprint; a
    component holds the classes that links of ``least`` or more connect, named by the smallest
    class id. Texts with empty fingerprints are one class. Cases as in ``fingerprints``.
    """
    classed = cut(fingerprints(docs).withColumn("class_id", F.xxhash64("fingerprint")), "spot-classes")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([read(x).astype(np.int64) for x in batch.column(1).to_pylist()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), sets], names=["id", "own"])

    once = classed.groupBy("class_id").agg(F.min("fingerprint").alias("fingerprint"))
    links = near_pairs(over_batches(once, run, "id long, own array<long>"), least)
    roots = components(links.select("a", "b"))
    joined = classed.join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
    return joined.select("doc_id", "fingerprint", "class_id", F.coalesce("root", "class_id").alias("component_id"))
