"""Spelling variants: words that are one edit from each other, grouped under the most frequent one.

One edit changes at most two of a word's bigrams. If all words order their bigrams alike, by how
rare they are in the vocabulary and then by place, the first bigram that two near words have
kept stands behind two others at most in either. So near words share one of their three rarest
bigrams, at the same place or, in the longer word, one further on. Words meet at bigram, place
and length only, and each pair that meets is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import cut, discard, over_batches, slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
#: Of all (document, run) pairs, those whose checksum this divides lose a letter.
MISPRINT = 199
MIN_LENGTH, MIN_COUNT = 6, 5
#: How many times as frequent a word's form is as the word.
FORM_FACTOR = 5
#: One edit changes so many bigrams at most, and one more must be looked at.
RAREST = 3
#: A task sends its counts on when it holds so many words.
HELD_WORDS = 100_000


def lower(word: str) -> str:
    """The word with A-Z alone lower-cased."""
    return word.lower() if word.isascii() else word.translate(_LOWER)


def misprint(doc_id: str, word: str, every: int = MISPRINT) -> str:
    """The word as the document has it: one letter is missing if ``every`` divides the checksum of both."""
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    return word if h % every else word[: h % len(word)] + word[h % len(word) + 1 :]


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = MISPRINT) -> DataFrame:
    """(word, n): the lower-cased words of at least ``min_length`` letters that occur ``min_count`` times or more.

    Takes doc_id and text; a null id counts as an empty one, a null text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own: Counter = Counter()
                for word, n in Counter(RUN.findall(text or "")).items():
                    if len(word) >= min_length:
                        own[lower(word)] += n
                for word, n in own.items():
                    printed = misprint(doc_id, word, every)
                    if len(printed) >= min_length:
                        held[printed] += n
            if len(held) >= HELD_WORDS:
                yield out()
                held.clear()
        if held:
            yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def bigram_counts(vocabulary: DataFrame) -> dict[str, int]:
    """How often each bigram occurs in the words: no more rows than pairs of the letters that words are made of."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Counter(w[k : k + 2] for w in batch.column(0).to_pylist() for k in range(len(w) - 1))
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["gram", "n"])

    return dict(over_batches(vocabulary.select("word"), run, "gram string, n long").groupBy("gram").agg(F.sum("n")).collect())


def _mask(word: str) -> int:
    """A bit for each remainder of its letters: words one edit apart differ in two at most."""
    bits = 0
    for c in set(word):
        bits |= 1 << ord(c) % 63
    return bits


def rarest(word: str, counts: dict[str, int]) -> list[tuple[str, int]]:
    """The bigrams, with their places, of which near words share one."""
    grams = [(counts.get(word[k : k + 2], 0), word[k : k + 2], k) for k in range(len(word) - 1)]
    return [(gram, k) for _, gram, k in sorted(grams)[:RAREST]]


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words that differ by one inserted, deleted or replaced letter, once.

    Takes distinct words (word, n) of at least four letters; the counts go along.
    """
    counts = vocabulary.sparkSession.sparkContext.broadcast(bigram_counts(vocabulary))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            mask = _mask(word)
            for gram, place in rarest(word, counts.value):
                for column, value in zip(out, (word, n, mask, gram, place, len(word))):
                    column.append(value)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["word", "n", "mask", "gram", "place", "size"])

    grams = cut(over_batches(vocabulary.select("word", "n"), run, "word string, n long, mask long, gram string, place int, size int"), "rare-bigrams")
    at = lambda place, size: F.xxhash64("gram", place, size)
    side = lambda x, key: grams.select(key.alias("key"), F.col("word").alias(x), F.col("n").alias(f"n_{x}"), F.col("mask").alias(f"mask_{x}"), F.col("size").alias(f"size_{x}"))
    place, size = F.col("place"), F.col("size")
    probes = F.explode(F.array(at(place, size), at(place, size + 1), at(place + 1, size + 1)))
    met = side("a", probes).join(side("b", at(place, size)), "key")
    once = (F.col("size_a") < F.col("size_b")) | (F.col("a") < F.col("b"))
    few = F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b"))) <= 2
    return met.where(once & few & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b").distinct()


def _followed(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last, twice as far in each round.

    Each form is so many times as frequent as its word that there are few rounds.
    """
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        before, now = now, cut(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(before)


def group(vocabulary: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct words (word, n).

    A word's form is its most frequent near word, the smallest of equals, if that is ``factor``
    times as frequent; its root is the last that forms lead to, or itself.
    """
    pairs = cut(near_pairs(vocabulary), "near-words")
    # a word has no more near words than letters can be put into it
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("word")).alias("near"))
    both = both.union(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("word")).alias("near")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    frequent: Column = -F.col("near.less") >= factor * F.col("n")
    judged = cut(best.select("word", "n_near", F.when(frequent, F.col("near.word")).alias("form"), F.when(frequent, -F.col("near.less")).alias("form_n")), "forms")
    roots = _followed(judged.where("form is not null"))
    joined = vocabulary.select("word", "n").join(judged, "word", "left").join(roots, "word", "left")
    discard(pairs)
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the documents; see ``words`` and ``group``.

    Repeated rows count each; columns beyond doc_id and text are ignored whatever their
    names. Texts of any length are read as wholes, words of any length compared. An empty table
    or one without words gives an empty result.
    """
    vocabulary = cut(words(docs), "vocabulary")
    return group(vocabulary).select("word", "form", "root", "n", "n_near", "form_n")
