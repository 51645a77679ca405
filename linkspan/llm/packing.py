"""Best-fit packing by a grouping genetic algorithm.

Documents are tokenized, cut into pieces of at most one sequence, and full pieces are done.
The other pieces are dealt into shards of bounded size, and for each shard several islands
evolve packings. An island begins with best fits of items in random orders. Crossover injects
whole well-filled bins of one parent into the other, drops the bins that hold a duplicate of an
injected item, and settles displaced items: larger ones first take the place of smaller ones in bins
that have the room, and what is left goes into the fullest bins that take it, largest first. It
goes on until no packing can have fewer bins or nothing has been gained for some generations.
After each epoch the best packing of an island moves to the next island of its shard. Bins
that stay far from full are dissolved, and their items are dealt anew into fewer shards, so that a
shard's rest is not lost.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import pairwise
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import cut, discard, kept, slices, tokenizer_file

CAPACITY = 4096
#: Id that ends each document.
END_ID = 1
SHARD_ITEMS = 4096
ISLANDS = 2
EPOCHS = 2
#: Generations of an epoch, and how many without a gain end it.
GENERATIONS, PATIENCE = 48, 12
POPULATION = 4
#: A mutation dissolves up to one in so many bins.
DISSOLVED = 12
#: Islands that one task evolves.
TASK_ISLANDS = 4
#: Bytes of words that a worker remembers.
WORD_BYTES = 128 << 20
#: Bins filled less than this are dissolved and dealt anew, on so many further levels at most.
LOOSE_FILL = 0.98
LEVELS = 3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Ids of texts by a tokenizer that lower-cases, drops white space and never merges across it.

    Words are encoded once and remembered as little-endian 32-bit ids. A mark behind a word of
    letters is a token of its own, so such words are looked up without it. New words of
    letters alone are encoded together, as the last token of each ends with the vocabulary's
    end-of-word suffix; all others one by one.
    """

    def __init__(self, path: str, most: int = WORD_BYTES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[n for piece, n in vocabulary.items() if piece.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.most, self.size = most, 0

    def ids(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            missing = {w for w in words if w not in self.known}
        if self.size > self.most:
            self.known, self.size, missing = {}, 0, set(words)
        known = len(self.known)
        self.learn(missing)
        # a word's own bytes twice, for it and its ids, and what a dict needs for them
        self.size += 140 * (len(self.known) - known) + 2 * sum(map(len, missing))
        return b"".join(map(self.known.__getitem__, words))

    def learn(self, words: set[str]) -> None:
        parts = {w: self.split(w) for w in words}
        new = {x for p in parts.values() for x in p if x not in self.known}
        letters = [x for x in new if x.isalpha()]
        ids, ends = self.encode(" ".join(letters)), ()
        if letters:
            ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) == len(letters):
            raw, cuts = ids.tobytes(), (4 * np.concatenate(([0], ends))).astype(int).tolist() if letters else [0]
            self.known.update(zip(letters, (raw[a:b] for a, b in pairwise(cuts))))
        for x in new:
            if x not in self.known:
                self.known[x] = self.encode(x).tobytes()
        for word, (core, mark) in parts.items():
            self.known[word] = self.known[core] + self.known[mark]

    @staticmethod
    def split(word: str) -> tuple[str, str]:
        """A word in the form to be looked up, and the mark behind it.

        What counts is the normalised word: a letter that becomes a letter and a combining mark
        has a token of that mark and what follows it.
        """
        core, mark = (word[:-1], word[-1]) if word[-1:] in (".", ",") else (word, "")
        if core.isascii():
            return (core.lower(), mark) if core.isalpha() else (word, "")
        return (core, mark) if mark and normalize("NFC", core).lower().isalpha() else (word, "")

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


def encoder(folder: str | None) -> WordEncoder:
    """The worker's encoder, kept until another operator's task runs in the worker."""
    return kept(WordEncoder, tokenizer_file("word_bpe_49k.json", folder))


def pieces(docs: DataFrame, folder: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Each document's pieces: a null text is a document of the end id alone."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(folder)
        for batch in slices(batches, keeping=WordEncoder):
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = own.ids(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


Bins = list[tuple[int, list[int]]]  # room left and items


def best_fit(bins: Bins, items: list[int], sizes: list[int], capacity: int) -> Bins:
    """Put items into the fullest bins that take them, or into new bins."""
    rooms = sorted((room, k) for k, (room, _) in enumerate(bins))
    out = [(room, list(held)) for room, held in bins]
    for item in items:
        size = sizes[item]
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
            out[k][1].append(item)
        else:
            room, k = capacity, len(out)
            out.append((capacity, [item]))
        out[k] = (room - size, out[k][1])
        if room > size:
            insort(rooms, (room - size, k))
    return out


def fitness(bins: Bins, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then more uneven filling."""
    return -len(bins), sum((1 - room / capacity) ** 2 for room, _ in bins)


def exchange(bins: Bins, loose: list[int], sizes: list[int]) -> tuple[Bins, list[int]]:
    """Put loose items into bins in the place of smaller ones, the largest that fit; returns the bins and the smaller items that are loose now, largest first."""
    order, out = sorted((sizes[i], i) for i in loose), []
    for room, held in bins:
        if room and order:
            held = list(held)
            for k in sorted(range(len(held)), key=lambda k: sizes[held[k]]):
                own = sizes[held[k]]
                at = bisect_left(order, (own + room + 1, -1)) - 1
                if at >= 0 and order[at][0] > own:
                    size, item = order.pop(at)
                    insort(order, (own, held[k]))
                    held[k] = item
                    room -= size - own
                    if not room:
                        break
        out.append((room, held))
    return out, [i for _, i in reversed(order)]


def settle(bins: Bins, loose: list[int], sizes: list[int], capacity: int) -> Bins:
    return best_fit(*exchange(bins, loose, sizes), sizes, capacity)


def crossover(a: Bins, b: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Inject well-filled bins of ``b`` into ``a``, drop bins with duplicates, settle what they displaced."""
    ranked = sorted(b, key=lambda x: x[0])
    good = ranked[: max(1, len(ranked) // 2)]
    injected = rng.sample(good, rng.randint(1, len(good)))
    inside = {i for _, held in injected for i in held}
    kept = [x for x in a if inside.isdisjoint(x[1])]
    kept_items = {i for _, held in kept for i in held}
    displaced = [i for _, held in a for i in held if i not in inside and i not in kept_items]
    return settle(injected + kept, displaced, sizes, capacity)


def mutate(bins: Bins, sizes: list[int], capacity: int, rng: random.Random) -> Bins:
    """Dissolve the emptiest bins and as many random ones."""
    n = rng.randint(1, max(1, len(bins) // DISSOLVED))
    emptiest = sorted(range(len(bins)), key=lambda k: -bins[k][0])[:n]
    gone = {*emptiest, *(rng.randrange(len(bins)) for _ in range(n))}
    return settle([x for k, x in enumerate(bins) if k not in gone], [i for k in gone for i in bins[k][1]], sizes, capacity)


def evolve(sizes: list[int], capacity: int, seed: int, guests: list[Bins], generations: int = GENERATIONS) -> tuple[Bins, int]:
    """One epoch of one island: the best packing it has, and how many generations there were.

    ``guests`` are the island's own best packing and the elite that has come; random beginnings join them.
    """
    rng, items = random.Random(seed), range(len(sizes))
    people = list(guests)
    while len(people) < POPULATION:
        people.append(best_fit([], rng.sample(items, len(items)), sizes, capacity))
    scored = sorted(((fitness(x, capacity), n, x) for n, x in enumerate(people)), reverse=True)
    least, gained, n = -(-sum(sizes) // capacity), 0, 0
    while n < generations and n - gained < PATIENCE and -scored[0][0][0] > least:  # no packing has fewer bins than that
        n += 1
        a, b = rng.sample(scored[:3], 2)
        child = crossover(a[2], b[2], sizes, capacity, rng)
        if rng.random() < 0.7:
            child = mutate(child, sizes, capacity, rng)
        if (score := fitness(child, capacity)) > scored[0][0]:
            gained = n
        scored = sorted([*scored[: POPULATION - 1], (score, POPULATION + n, child)], reverse=True)
    return scored[0][2], n


def to_bins(of: list[int], sizes: list[int], capacity: int) -> Bins:
    held: dict[int, list[int]] = {}
    for item, k in enumerate(of):
        held.setdefault(k, []).append(item)
    return [(capacity - sum(sizes[i] for i in items), items) for items in held.values()]


_STATE = "shard long, island int, items array<long>, sizes array<int>, bins array<int>, bin_count int, evenness double, generations int"


def _epoch(state: DataFrame, islands: int, capacity: int, epoch: int) -> DataFrame:
    """One epoch of all ``islands``; ``guest`` is the elite that has come from another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = row["sizes"]
                guests = [to_bins(x, sizes, capacity) for x in (row["bins"], row["guest"]) if x]
                best, generations = evolve(sizes, capacity, hash((row["shard"], row["island"], epoch)), guests)
                of = np.zeros(len(sizes), np.int32)
                for k, (_, held) in enumerate(best):
                    of[held] = k
                score = fitness(best, capacity)
                yield pa.RecordBatch.from_pylist(
                    [{"shard": row["shard"], "island": row["island"], "items": row["items"], "sizes": sizes, "bins": of.tolist(), "bin_count": -score[0], "evenness": score[1], "generations": generations}],
                    pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("items", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("bins", pa.list_(pa.int32())), ("bin_count", pa.int32()), ("evenness", pa.float64()), ("generations", pa.int32())]),
                )

    return state.repartition(-(-islands // TASK_ISLANDS), "shard", "island").mapInArrow(run, _STATE)


def _level(items: DataFrame, n: int, capacity: int, level: int) -> tuple[DataFrame, int]:
    """Pack (item, length) rows; rows (item, sequence_id, offset, fill)."""
    shards = -(-n // SHARD_ITEMS)
    dealt = items.groupBy(F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)).alias("shard"))
    # a shard has about SHARD_ITEMS items, whatever the keys of the documents are
    state = dealt.agg(F.sort_array(F.collect_list(F.struct("item", "length"))).alias("x")).select(
        "shard", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))).alias("island"), F.col("x.item").alias("items"), F.col("x.length").cast("array<int>").alias("sizes"),
        F.lit(None).cast("array<int>").alias("bins"), F.lit(None).cast("array<int>").alias("guest"),
    )
    done = None
    for epoch in range(EPOCHS):
        before, done = done, cut(_epoch(state, ISLANDS * shards, capacity, epoch), f"islands-{epoch}")
        if before is not None:
            discard(before)
        elite = done.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("bins").alias("guest"))
        state = done.join(elite, ["shard", "island"])
    best = done.groupBy("shard").agg(F.min_by(F.struct("items", "sizes", "bins"), F.struct("bin_count", -F.col("evenness"), "island")).alias("x")).select("x.*")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: tuple[list, ...] = ([], [], [], [])
                for room, held in to_bins(row["bins"], row["sizes"], capacity):
                    at = 0
                    for i in held:
                        for column, value in zip(out, (row["items"][i], 2 * row["items"][held[0]] + 1, at, 1 - room / capacity)):
                            column.append(value)
                        at += row["sizes"][i]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["item", "sequence_id", "offset", "fill"])

    placed = cut(best.mapInArrow(place, "item long, sequence_id long, offset long, fill double"), f"placed-{level}")
    discard(done)
    return placed, shards


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Place rows (item long, unique; length long, 1 to ``capacity``) into as few sequences as found.

    Returns (item, sequence_id, offset). Full items are sequences of their own.
    """
    full = items.where(F.col("length") >= capacity).select("item", (2 * F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out, left = full, items.where(F.col("length") < capacity).select("item", "length")
    for level in range(LEVELS):
        n = left.count()
        if not n:
            break
        placed, shards = _level(left, n, capacity, level)
        last = shards == 1 or level == LEVELS - 1
        out = out.union((placed if last else placed.where(F.col("fill") >= LOOSE_FILL)).select("item", "sequence_id", "offset"))
        if last:
            break
        left = cut(placed.where(F.col("fill") < LOOSE_FILL).select("item").join(left, "item"), f"loose-{level}")
    return out


def pack_documents(docs: DataFrame, folder: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces and their places.

    Takes doc_id and text; other columns are ignored. A null or empty text is the end id
    alone. Rows that repeat, or have no doc_id, are packed each for itself. A text of any
    length is cut into pieces of ``capacity``. An empty table gives an empty result. ``folder``
    holds the tokenizer's file.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    all_pieces = cut(pieces(docs, folder, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces")
    placed = cut(pack(all_pieces.select("item", "length"), capacity), "places")
    return all_pieces.join(placed, "item").drop("item")
