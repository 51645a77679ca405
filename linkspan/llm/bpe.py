"""Byte-level BPE with a segment tree.

The leaves of the tree are byte positions; a leaf holds the rank of the pair that the token
starting there makes with the next one, and an inner node the leftmost minimum below it. A
merge takes the root's pair and updates three leaves, so a piece of n bytes needs n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import Memo, kept, slices, tokenizer_file

RANKS = "byte_bpe_50k.tiktoken"
_NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: always merge the pair of least rank, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    leaves = 1 << max(n - 1, 1).bit_length()
    tree = [_NONE] * (2 * leaves)
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[leaves + i] = r << 32 | i
    for k in range(leaves - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    follow = list(range(1, n + 1))  # where the token that starts here ends
    before = list(range(-1, n - 1))

    while tree[1] != _NONE:
        i = tree[1] & 0xFFFFFFFF
        j = follow[i]
        end = follow[i] = follow[j]
        p = before[i]
        r = rank(piece[i : follow[end]]) if end < n else None
        tree[leaves + j] = _NONE
        tree[leaves + i] = _NONE if r is None else r << 32 | i
        if end < n:
            before[end] = i
        if p >= 0:
            r = rank(piece[p:end])
            tree[leaves + p] = _NONE if r is None else r << 32 | p
        # point updates of the three leaves, each up to where nothing changes
        for k in ((leaves + j) >> 1, (leaves + i) >> 1, (leaves + p) >> 1 if p >= 0 else 0):
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : follow[i]]])
        i = follow[i]
    return out


class Codec:
    """Encodes and decodes whole texts; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        self.ranks = read_ranks(path)
        self.parts = {i: b for b, i in self.ranks.items()}
        self.find = regex.compile(PATTERN).findall
        self.known = Memo(lambda match: np.array(merge(match.encode("utf-8", "surrogatepass"), self.ranks), "<u4").tobytes(), value_bytes=48)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.find(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.parts.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(folder: str | None) -> Codec:
    """The worker's codec, kept until another operator's task runs in the worker."""
    return kept(Codec, tokenizer_file(RANKS, folder))


def encode(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, ids binary): the ids of every whole text; a null text is empty and has none.

    Repeated rows are each encoded; columns beyond doc_id and text are ignored. ``folder``
    holds the rank file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, keeping=Codec):
            ids = [codec(folder).encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, raw binary): the bytes that ``ids`` stand for; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, keeping=Codec):
            raw = [codec(folder).decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids, and digest both, batch by batch.

    A null or empty text has no tokens and the digests of nothing. Repeated rows are each
    encoded, texts of any length as wholes; an empty table gives an empty result. Columns
    beyond doc_id and text are ignored. ``folder`` holds the rank file.
    """
    hexed = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(folder)
        for batch in slices(batches, keeping=Codec):
            out = []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text or "")
                out.append((len(ids) // 4, hexed(ids), hexed(own.decode(ids))))
            n, a, b = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
