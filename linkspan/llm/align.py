"""Alignment of two tokenizers' tokens over the same bytes.

The byte ranges of one tokenizer's tokens (B) are a static index of sorted intervals. Each token
of the other (A) stabs it by bisection and finds the run of B tokens that it overlaps. A gap
between two B tokens that no A token spans is where both end: it bounds a group.

Neither tokenizer merges over a space or line feed that follows another character than white
space, which the vocabulary is checked for, so a text falls into segments there. Segments that
are new to a worker are encoded and aligned together, and remembered; a text's groups are those
of its segments in a row.

What counts over the corpus is gathered by blocks of documents. A block holds each id pair once,
with the number of its documents that link it; sums of these are counts over all documents, and
go back to a block as one list. So what is shuffled are a block's distinct pairs, not links. A
pair of a group is never written out for each of its occurrences: a group's distinct ids are
paired, and carry how many links they stand for.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from public_tokenizers import PATTERN
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import cut, kept, slices, tokenizer_file

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text of a block, beyond one text.
BLOCK_BYTES = 2 << 20
#: A worker forgets its segments when they hold about so many bytes.
SEGMENT_BYTES = 80 << 20
#: Segments of about so many bytes are encoded at once.
ENCODE_BYTES = 1 << 16
#: A segment of more characters is encoded by itself, by the vocabulary's own library.
LONG = 4096
#: The distinct ids of a group with more links are paired, not its tokens.
MOST_LINKS = 1024
SPACE = "▁"
#: Stands before what is encoded as pieces, so that no space is added to it.
LEAD = "."


#: What a segment adds to its text: whether both tokenizers give its bytes back, the numbers of tokens of A and B, of groups
#: and links, the groups as text, pairs, and how many links each stands for (nothing: one each).
Segment = tuple[bool, int, int, int, int, str, bytes, bytes]
NOTHING: Segment = (False, 0, 0, 0, 0, "", b"", b"")


def overlapped(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last token of B that each token of A overlaps, from the byte ends of both."""
    starts_a = np.concatenate(([0], ends_a[:-1]))
    return np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(ends_b, ends_a, "left")


def group_numbers(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B, counted from 0."""
    first, last = overlapped(ends_a, ends_b)
    depth = np.zeros(len(ends_b) + 1, np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, last, -1)
    spanned = np.cumsum(depth)[: len(ends_b) - 1] > 0  # the gap behind each token but the last
    of_b = np.concatenate(([0], np.cumsum(~spanned)))
    return of_b[first], of_b


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable characters of Latin-1 stand for themselves, the other bytes in turn for U+0100 on.
    """
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Aligner:
    """Both tokenizers, their tokens' bytes, and the segments that the worker remembers."""

    def __init__(self, byte_level: str, pieces: str, most: int = SEGMENT_BYTES) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True  # their strings inside texts are plain text
        spec, letters = json.loads(self.a.to_str()), byte_of_letter()
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or not spec["pre_tokenizer"]["use_regex"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{byte_level} does not split texts at white space by itself")
        added = {x["content"] for x in spec["added_tokens"]}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = token.encode() if token in added else bytes(map(letters.__getitem__, token))
        merged = [vocabulary["".join(x.split(" ") if isinstance(x, str) else x)] for x in spec["model"]["merges"]]
        #: encodes the same several times as fast; there if merges come in the order of what they make
        self.ranked = None
        if merged == sorted(set(merged)):
            ranks = {self.bytes_a[i]: i for token, i in vocabulary.items() if token not in added}
            self.ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.bytes_b: list[bytes] = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)) and (SPACE in piece.lstrip(SPACE) or "\n" in piece):
                raise ValueError(f"a piece holds a space or line feed after another character: {piece!r}")
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode())
        if len(self.b.encode(LEAD)) != 1:
            raise ValueError(f"{LEAD!r} is not one piece")
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        self.base = len(self.bytes_b)
        # a space or line feed and all up to the next one that follows another character than white space
        self.split = re.compile(r"[ \n][^ \n]*(?:(?<=\s)[ \n][^ \n]*)*").findall
        self.known: dict[str, Segment] = {}
        self.older: dict[str, Segment] = {}
        self.most, self.size = most, 0

    def segments(self, texts: list[str | None]) -> list[list[str]]:
        """The segments of each text behind a space; a null or empty text has none."""
        return [self.split(f" {x}") if x else [] for x in texts]

    def learn(self, wanted: set[str]) -> None:
        """Remember the segments. Of the others, those that were wanted since half of the room was filled up are kept."""
        if 2 * self.size > self.most:
            self.older, self.known, self.size = self.known, {}, 0
        new = []
        for x in wanted - self.known.keys():
            if x in self.older:
                self.keep(x, self.older[x])
            else:
                new.append(x)
        held, size = [], 0
        for x in new:
            # white space that goes on behind it would be another segment's
            if x[-1].isspace() or len(x) > LONG:
                self.align([x])
                continue
            held.append(x)
            size += len(x)
            if size >= ENCODE_BYTES:
                self.align(held)
                held, size = [], 0
        if held:
            self.align(held)

    def encode(self, text: str, long: bool) -> tuple[list[int], list[int]]:
        """Ids of both of segments in a row."""
        a = self.a.encode(text, add_special_tokens=False).ids if long or self.ranked is None else self.ranked.encode_ordinary(text)
        return a, self.b.encode(LEAD + text)[1:]

    def align(self, segments: list[str]) -> None:
        raw = [x.encode() for x in segments]
        a, b = self.encode("".join(segments), len(segments) == 1 and len(segments[0]) > LONG)
        whole = b"".join(raw)
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            if len(segments) > 1:  # find those that are not given back
                half = len(segments) // 2
                self.align(segments[:half])
                self.align(segments[half:])
            else:
                self.keep(segments[0], NOTHING)
            return
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        of_a, of_b = group_numbers(ends_a, ends_b)
        ends = np.cumsum(list(map(len, raw)))
        # tokens and groups up to each segment's end
        at_a, at_b = np.searchsorted(ends_a, ends) + 1, np.searchsorted(ends_b, ends) + 1
        at_g = of_a[at_a - 1] + 1
        n_a, n_b = np.bincount(of_a), np.bincount(of_b)
        shown, n_links = self.shown(a, b, n_a, n_b), np.cumsum(n_a * n_b)
        few = n_a * n_b <= MOST_LINKS
        pairs = self.pairs(np.array(a), np.array(b), n_a, n_b, few)
        at_pairs, wide = np.cumsum(np.where(few, n_a * n_b, 0)), np.concatenate(([0], np.cumsum(~few)))
        before = (0, 0, 0, 0, 0)
        for x, i, j, g, total, p in zip(segments, at_a.tolist(), at_b.tolist(), at_g.tolist(), n_links[at_g - 1].tolist(), at_pairs[at_g - 1].tolist()):
            i0, j0, g0, total0, p0 = before
            found, links = pairs[8 * p0 : 8 * p], b""
            if wide[g] > wide[g0]:
                found, links = self.counted(a[i0:i], b[j0:j], n_a[g0:g].tolist(), n_b[g0:g].tolist())
            self.keep(x, (True, i - i0, j - j0, g - g0, total - total0, ";".join(shown[g0:g]), found, links))
            before = i, j, g, total, p

    @staticmethod
    def shown(a: list[int], b: list[int], n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """Each group as text, from the tokens and how many of them a group has."""
        to_a, to_b = np.cumsum(n_a), np.cumsum(n_b)
        from_a, from_b = (to_a - n_a).tolist(), (to_b - n_b).tolist()
        out = [f"{a[i]}|{b[j]}" for i, j in zip(from_a, from_b)]
        for g in np.flatnonzero((n_a > 1) | (n_b > 1)).tolist():
            out[g] = f"{','.join(map(str, a[from_a[g] : to_a[g]]))}|{','.join(map(str, b[from_b[g] : to_b[g]]))}"
        return out

    def pairs(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, few: np.ndarray) -> bytes:
        """The pairs of all links of groups with few of them."""
        n = np.where(few, n_a * n_b, 0)
        group = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)
        i, j = np.cumsum(n_a)[group] - n_a[group] + place // n_b[group], np.cumsum(n_b)[group] - n_b[group] + place % n_b[group]
        return (a[i] * self.base + b[j]).astype(np.int64).tobytes()

    def counted(self, a: list[int], b: list[int], n_a: list[int], n_b: list[int]) -> tuple[bytes, bytes]:
        """The distinct pairs of a segment's groups and how many links each stands for."""
        links: Counter = Counter()
        i = j = 0
        for k, m in zip(n_a, n_b):
            counts_b = Counter(b[j : j + m])
            for x, n in Counter(a[i : i + k]).items():
                for y, times in counts_b.items():
                    links[x * self.base + y] += n * times
            i, j = i + k, j + m
        return np.fromiter(links.keys(), np.int64, len(links)).tobytes(), np.fromiter(links.values(), np.int64, len(links)).tobytes()

    def keep(self, text: str, found: Segment) -> None:
        self.known[text] = found
        # the objects' own bytes, and what the dict needs for them
        self.size += 450 + len(text) + len(found[5]) + len(found[6]) + len(found[7])


def aligner(folder: str | None) -> Aligner:
    """The worker's aligner, kept until another operator's task runs in the worker."""
    return kept(Aligner, tokenizer_file(BYTE_LEVEL, folder), tokenizer_file(PIECES, folder))


def align(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, groups) of every whole text: an array of groups, each with the ids a and b of its tokens in order.

    A null or empty text, and one that a tokenizer does not give back byte by byte, has no
    groups. Repeated rows are each aligned; columns beyond doc_id and text are ignored
    whatever their names. An empty table gives an empty result. ``folder`` holds both vocabularies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(folder)
        group = pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])
        for batch in slices(batches, keeping=Aligner):
            texts = own.segments(batch.column(1).to_pylist())
            own.learn({x for t in texts for x in t})
            out = []
            for text in texts:
                found = [own.known[x] for x in text]
                sides = [g.split("|") for x in found for g in x[5].split(";")] if all(x[0] for x in found) else []
                out.append([{k: list(map(int, v.split(","))) for k, v in zip("ab", g)} for g in sides])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(group))], names=["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")


_ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, links binary, pairs array<long>, docs array<long>"


def _block(own: Aligner, number: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each document, with its pairs' places in the block's list and their links, and one with the list."""
    texts = own.segments(batch.column(1).to_pylist())
    own.learn({x for t in texts for x in t})
    rows, pairs, links = [], [], []
    for text in texts:
        same, n_a, n_b, n_groups, n_links, shown, listed, times = zip(*map(own.known.__getitem__, text)) if text else zip(NOTHING)
        if not all(same):
            n_a = n_b = n_groups = n_links = (0,)
            shown, listed, times = (), (), ()
        rows.append((sum(n_a), sum(n_b), sum(n_groups), sum(n_links), hashlib.sha256(";".join(shown).encode()).hexdigest() if shown else ""))
        each, back, total = np.unique(np.frombuffer(b"".join(listed), np.int64), return_inverse=True, return_counts=True)
        if any(times):
            total = np.zeros(len(each), np.int64)
            np.add.at(total, back, np.frombuffer(b"".join(t or np.ones(len(x) // 8, np.int64).tobytes() for x, t in zip(listed, times)), np.int64))
        pairs.append(each)
        links.append(total.astype(np.int64).tobytes())
    listed, places = np.unique(np.concatenate(pairs), return_inverse=True)
    ends = np.cumsum(list(map(len, pairs)))[:-1]
    n, kinds = len(texts), (pa.int64(),) * 6 + (pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    columns = [
        [number] * (n + 1), [*batch.column(0).to_pylist(), None], *([*c, None] for c in zip(*rows)),
        [*(x.astype(np.int32).tobytes() for x in np.split(places, ends)), None], [*links, None], [None] * n + [listed], [None] * n + [np.bincount(places, minlength=len(listed))],
    ]
    names = [x.split()[0] for x in _ALIGNED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def aligned_blocks(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The documents in blocks, written once: a row for each document, and one with the distinct pairs of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = aligner(folder), TaskContext.get().partitionId() << 32
        for batch in slices(batches, BLOCK_BYTES, keeping=Aligner):
            if batch.num_rows:
                yield _block(own, number, batch)
                number += 1

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ALIGNED), "aligned")


def _listed(blocks: DataFrame) -> DataFrame:
    """The blocks' pairs: block, place, pair, docs."""
    both = blocks.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "x"))
    return both.select("block", "place", "x.pairs", "x.docs").withColumnRenamed("pairs", "pair")


def _counts(blocks: DataFrame, base: int) -> DataFrame:
    """(pair, docs, best) over all documents; best: no pair with the same id of A is in more."""
    total = _listed(blocks).groupBy("pair").agg(F.sum("docs").alias("docs"))
    of_a = F.expr(f"pair div {base}")
    # a row for each id of A: no more than the vocabulary has
    most = total.groupBy(of_a.alias("a")).agg(F.max("docs").alias("most"))
    return total.join(F.broadcast(most), of_a == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(a, b, docs, best): in how many documents each id pair is linked, and whether no other pair of ``a`` is in more.

    Rows that repeat count each; see ``align`` for texts without groups.
    """
    base = len(aligner(folder).bytes_b)
    counted = cut(_counts(aligned_blocks(docs, folder), base), "pair-counts")
    return counted.select(F.expr(f"pair div {base}").cast("int").alias("a"), (F.col("pair") % base).cast("int").alias("b"), "docs", "best")


def digest_rows(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every whole text.

    n_best: links whose pair is in as many documents as any of its id of A; count_sum: the
    number of documents of each link's pair, summed. A text without groups (see ``align``) has
    zeros and an empty digest. Repeated rows are documents each. Columns beyond doc_id and text
    are ignored. Texts of any length are taken as wholes. An empty table gives an empty result.
    """
    base = len(aligner(folder).bytes_b)
    blocks = aligned_blocks(docs, folder)
    counted = cut(_counts(blocks, base), "pair-counts")
    answers = _listed(blocks).select("block", "place", "pair").join(counted, "pair")
    # as many rows of a block as it has distinct pairs
    lists = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "docs", "best"))).alias("x")).select(F.col("block").alias("of"), "x.docs", "x.best")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, best = (right.column(k).combine_chunks().values.to_numpy(zero_copy_only=False) if right.num_rows else np.zeros(0, np.int64) for k in ("docs", "best"))
        sums = []
        for places, links in zip(left.column("places").to_pylist(), left.column("links").to_pylist()):
            at, n = np.frombuffer(places, np.int32), np.frombuffer(links, np.int64)
            sums.append((int(n[best[at].astype(bool)].sum()), int((n * docs[at]).sum())))
        n_best, count_sum = zip(*sums) if sums else ((), ())
        columns = [*(left.column(k) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), left.column("groups_sha256")]
        return pa.table(columns, names=[x.split()[0] for x in out.split(", ")])

    rows = blocks.where("pairs is null").drop("pairs", "docs")
    return rows.groupBy("block").cogroup(lists.groupBy("of")).applyInArrow(run, out)
