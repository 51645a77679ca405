"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 2- and 3-grams per language are summed by Spark from a bounded sample of
labelled rows. The log-probability matrix (languages x buckets, so of fixed size) is
broadcast, and each batch of texts is scored as a sparse product: the rows of the matrix
that a text's n-grams select, summed per text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import bounded_sample, bucket3, held_out, over_batches

ORDERS = (2, 3)
BUCKETS = 1 << 15
#: About so many labelled rows are learned from, chosen by a hash of doc_id.
TRAIN_ROWS = 20_000
#: Languages of a model, each with a row of 128 KB in the broadcast matrix.
MOST_LANGS = 512
UNKNOWN = "und"
_MIX = np.uint32(2654435761)
_CHUNK = 1 << 20


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: bucket of every n-gram of the joined texts, and each text's first and end n-gram."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    for order in ORDERS:
        n = max(len(points) - order + 1, 0)
        hashed = np.zeros(n, np.uint32)
        for k in range(order):
            hashed = (hashed + points[k : k + n]) * _MIX
            hashed ^= hashed >> np.uint32(15)
        starts = np.minimum(ends - sizes, n)
        yield (hashed % np.uint32(BUCKETS)).astype(np.int32), starts, np.clip(ends - order + 1, starts, n)


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about a million characters; a longer text is a run of its own."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > _CHUNK:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)


def normal(text: str | None) -> str:
    return (text or "").lower()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray
    logp: np.ndarray  # languages x buckets, float32

    def parts(self) -> Iterator[Model]:
        """The model in parts of at most ``MOST_LANGS`` languages, of which a task holds one."""
        for a in range(0, len(self.langs), MOST_LANGS):
            yield Model(self.langs[a : a + MOST_LANGS], self.prior[a : a + MOST_LANGS], self.logp[a : a + MOST_LANGS])

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log joint probability, texts x languages."""
        out = np.tile(self.prior, (len(texts), 1))
        for a, b in chunks(texts):
            for ids, starts, ends in grams(texts[a:b]):
                full = np.flatnonzero(ends > starts)
                if len(full):
                    edges = np.stack((starts[full], ends[full]), 1).ravel()
                    for k, row in enumerate(self.logp):
                        values = np.append(row[ids].astype(np.float64), 0.0)
                        out[a + full, k] += np.add.reduceat(values, edges)[::2]
        return out


def train(docs: DataFrame, bound: int = TRAIN_ROWS) -> Model:
    """Learn from ``text`` and ``lang`` of about ``bound`` rows that are not held out.

    Rows with a null doc_id, text or lang teach nothing, repeated rows teach once. Without any
    usable row the model knows no language. The driver holds a number for each language and bucket.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket3(F.col("doc_id")) != 1))
    sample = bounded_sample(known.select(F.col("doc_id").cast("long"), "text", "lang"), bound).select("text", "lang")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, langs = map(normal, batch.column(0).to_pylist()), batch.column(1).to_pylist()
        of: dict[str, list[str]] = {}
        for text, lang in zip(texts, langs):
            of.setdefault(lang, []).append(text)
        rows: list[tuple[str, np.ndarray, np.ndarray]] = []
        for lang, own in of.items():
            total = np.zeros(BUCKETS, np.int64)
            for a, b in chunks(own):
                for ids, starts, ends in grams(own[a:b]):
                    inside = np.zeros(len(ids) + 1, np.int64)
                    np.add.at(inside, starts, 1)
                    np.add.at(inside, ends, -1)
                    total += np.bincount(ids[np.cumsum(inside)[:-1] > 0], minlength=BUCKETS)
            at = np.flatnonzero(total)
            rows += [(lang, np.append(at, -1), np.append(total[at], len(own)))]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([r[0] for r in rows], [len(r[1]) for r in rows]).tolist(), pa.string()), pa.array(np.concatenate([r[1] for r in rows])), pa.array(np.concatenate([r[2] for r in rows]))], names=["lang", "bucket", "n"]
        )

    counted = over_batches(sample, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    langs = sorted(counted["lang"].unique())
    table = np.zeros((len(langs), BUCKETS + 1))
    table[counted["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), counted["bucket"].to_numpy(int)] = counted["n"].to_numpy(float)
    rows, table = table[:, -1], table[:, :-1] + 0.5
    return Model(langs, np.log(rows / max(rows.sum(), 1)), np.log(table / table.sum(1, keepdims=True)).astype(np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; only ``text`` decides.

    score is the posterior probability of lang_pred. A null text, one without a letter, or
    a model without languages gives ``und`` and 0. Ties go to the language first in order.
    Repeated rows are each scored, texts of any length as wholes; columns beyond doc_id and text are ignored.
    An empty table gives an empty result. Each ``MOST_LANGS`` languages are one pass of a batch, with their own matrix.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(UNKNOWN).alias("lang"), F.lit(float("-inf")).alias("best"), F.lit(float("-inf")).alias("total"))
    kinds = (pa.string(), pa.float64(), pa.float64())

    def judged(shared: object) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        """The best language so far, its log joint probability, and the logarithm of the sum of all so far."""

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            part, texts = shared.value, list(map(normal, batch.column(1).to_pylist()))
            lang, best, total = batch.column(2).to_pylist(), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            joint = part.scores(texts)
            top, most = joint.argmax(1), joint.max(1)
            sums = most + np.log(np.exp(joint - most[:, None]).sum(1))
            values = [part.langs[i] if new else x for i, new, x in zip(top, most > best, lang)], np.maximum(most, best), np.logaddexp(total, sums)
            return pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(v, k) for v, k in zip(values, kinds))], names=batch.schema.names)

        return run

    for part in model.parts():
        rows = over_batches(rows, judged(docs.sparkSession.sparkContext.broadcast(part)), "doc_id long, text string, lang string, best double, total double")

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = np.array([has_letter(normal(x)) for x in batch.column(1).to_pylist()], bool) & np.isfinite(batch.column(3).to_numpy())
        score = np.where(known, np.exp(np.minimum(np.where(known, batch.column(3).to_numpy(), 0.0) - np.where(known, batch.column(4).to_numpy(), 0.0), 0.0)), 0.0)
        langs = [x if k else UNKNOWN for x, k in zip(batch.column(2).to_pylist(), known)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(held_out, batch.column(0).to_pylist()), pa.bool_()), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return over_batches(rows, told, "doc_id long, held_out boolean, lang_pred string, score double")
