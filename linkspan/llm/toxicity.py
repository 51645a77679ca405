"""Toxicity by maximum-scoring segments.

Each token has a log-odds weight for appearing in toxic documents. Its Dirichlet prior is
its stem's estimate (first 7, then 5, then 4 characters, then the base rate), so that unseen
forms of a known stem count; weights are lowered by some standard errors, and a drift makes
the expected score of clean text negative. One linear scan finds every maximal segment.
Segment scores are turned into expected counts by the extreme-value law of such scores
(lambda and K from clean rows), the significant ones are added up, and a logistic curve
makes a probability of the sum. Drift, lambda, K and curve are fitted on rows that the weights
were not learned from, with the weights that are used later.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspan.llm.common import Memo, bounded_sample, bucket3, cut, discard, held_out, over_batches, slices

#: About so many labelled rows are learned from, chosen by a hash of doc_id.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
STEMS = (4, 5, 7)
PRIOR = 5.0
STANDARD_ERRORS = 3.0
#: Weights below this count as none.
LEAST_WEIGHT = 0.5
#: A token's score is its weight less the drift: so many times the mean weight in clean rows, and this much at least.
DRIFT_FACTOR, LEAST_DRIFT = 2.0, 0.05
#: A segment counts if fewer than this many of its score are expected by chance in the text.
E_VALUE = 0.05
_SPLIT = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split()


def stems(token: bytes) -> list[tuple[int, bytes]]:
    text = token.decode("utf-8", "surrogatepass")
    return [(n, text[:n].encode("utf-8", "surrogatepass")) for n in STEMS]


def maximal_segments(places: list[int], weights: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), in linear time.

    Tokens at ``places`` score ``weights`` (positive); all others score ``-drift``.
    """
    stack: list[tuple[float, float, int, int, int]] = []  # score before, score through, first, last, link to a lower start
    total, before = 0.0, -1
    for place, weight in zip(places, weights):
        total -= drift * (place - before - 1)
        left, right, first = total, total + weight, place
        total, before = right, place
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, place, j))
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(first, last, right - left) for left, right, first, last, _ in stack]


@dataclass
class Model:
    base: float = 0.1
    theta: dict[tuple[int, bytes], tuple[float, float]] = field(default_factory=dict)  # (level, token): toxic, clean rows; level 0: whole token
    drift: float = LEAST_DRIFT
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, float] = (-3.0, 2.0)

    def weight(self, token: bytes) -> float:
        """The token's lowered log-odds; 0 if nothing positive is left."""
        rate, error = self.base, 0.0
        for level, part in (*stems(token), (0, token)):
            found = self.theta.get((level, part))
            if found:
                toxic, clean = found[0] + PRIOR * rate, found[1] + PRIOR * (1 - rate)
                rate = toxic / (toxic + clean)
                error = math.sqrt(1 / (found[0] + PRIOR * self.base) + 1 / (found[1] + PRIOR * (1 - self.base)))
        odds = math.log(rate / (1 - rate)) - math.log(self.base / (1 - self.base)) - STANDARD_ERRORS * error
        return odds if odds >= LEAST_WEIGHT else 0.0

    def scan(self, text: str | None, weight: Memo) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and maximal segments."""
        words = tokens(text)
        found = np.fromiter(map(weight.__getitem__, words), np.float64, len(words))
        places = np.flatnonzero(found > self.drift)
        weights = (found[places] - self.drift).tolist()
        return len(words), maximal_segments(places.tolist(), weights, self.drift)

    def significant(self, n: int, segments: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """The segments with few enough expected by chance; their score is then ``-ln`` of that number."""
        scored = [(a, b, self.lam * s - math.log(max(self.k * n, 1e-9))) for a, b, s in segments]
        return [x for x in scored if x[2] > -math.log(E_VALUE)]

    def probability(self, significant: list[tuple[int, int, float]]) -> float:
        x = self.curve[0] + self.curve[1] * math.log1p(sum(s for _, _, s in significant))
        return 1 / (1 + math.exp(-max(min(x, 500), -500)))


def fit_drift(n: int, weights: np.ndarray, counts: np.ndarray) -> float:
    """The drift from the positive weights in clean rows of ``n`` tokens: the expected score becomes negative."""
    return max(LEAST_DRIFT, DRIFT_FACTOR * float(weights @ counts) / max(n, 1))


def fit_lambda(n: int, weights: np.ndarray, counts: np.ndarray, most: float, drift: float) -> float:
    """The root of E exp(lambda * score) = 1 over the tokens of clean rows and one more of the weight ``most``."""
    ups, times = np.append(np.maximum(weights, drift), max(most, 2 * drift)) - drift, np.append(counts, 1)
    rest = max(n - counts.sum(), 0)
    low, high = 0.0, 50.0
    for _ in range(60):
        mid = (low + high) / 2
        mean = (times @ np.exp(np.minimum(mid * ups, 600)) + rest * math.exp(-mid * drift)) / (times.sum() + rest)
        low, high = (mid, high) if mean < 1 else (low, mid)
    return max(low, 1e-4)


def _fit_curve(xs: np.ndarray, ys: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps with a little ridge.

    Toxic rows weigh more, by the root of how much rarer they are.
    """
    a, b = -2.0, 1.0
    weight = np.where(ys > 0, np.sqrt(max((1 - ys).sum(), 1) / max(ys.sum(), 1)), 1.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * xs, -30, 30)))
        g = np.array([(weight * (ys - p)).sum() - 0.5 * (a + 2), (weight * (ys - p) * xs).sum() - 0.5 * (b - 1)])
        v = weight * p * (1 - p)
        h = np.array([[v.sum() + 0.5, (v * xs).sum()], [(v * xs).sum(), (v * xs * xs).sum() + 0.5]])
        step = np.linalg.solve(h, g)
        a, b = a + float(step[0]), b + float(step[1])
        if abs(step).max() < 1e-8:
            break
    return a, max(b, 0.0)


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> Model:
    """Learn from ``labels.toxic`` of about ``bound`` rows that are not held out.

    Weights come from three quarters of them; drift, lambda, K and the curve are fitted on the
    rest. Each text counts once, as toxic if any of its rows is. Null labels, ids or texts teach
    nothing; without both classes the defaults remain. The driver gets the counts of tokens in
    the bounded sample, a histogram of weights, and four numbers for each fitting row.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (bucket3(F.col("doc_id")) != 1))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = bounded_sample(marked, bound, text=None)
    known = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    drawn = cut(known.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "toxicity-sample")
    sample = bounded_sample(drawn, bound).select("text", "toxic", (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("fitting"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: tuple[Counter, ...] = (Counter(), Counter())
        for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
            seen[toxic > 0].update({(0, t) for t in tokens(text)})
        for side in seen:
            for (_, token), n in list(side.items()):
                for stem in stems(token):
                    side[stem] += n
        keys = list(set().union(*seen))
        values = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.binary()), *(pa.array([side[k] for k in keys], pa.int64()) for side in seen)]
        return pa.RecordBatch.from_arrays(values, names=["level", "token", "clean", "toxic"])

    counted = over_batches(sample.where("not fitting").select("text", "toxic"), count, "level int, token binary, clean long, toxic long")
    # a token of one toxic row has no positive weight
    most = counted.groupBy("level", "token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > 1").collect()
    whole = [r for r in most if not r.level]
    base = sum(r.toxic for r in whole) / max(sum(r.toxic + r.clean for r in whole), 1)
    model = Model(min(max(base, 1e-3), 0.5), {(r.level, bytes(r.token)): (float(r.toxic), float(r.clean)) for r in most})
    if most:
        _fit(model, sample.where("fitting").select("text", "toxic"))
    discard(drawn)
    return model if most else Model()


def _fit(model: Model, rows: DataFrame) -> None:
    """Set drift, lambda, K and the curve from rows (text, toxic)."""
    context = rows.sparkSession.sparkContext

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen = Memo(shared.value.weight), Counter()
        for batch in slices(batches):
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                found = [memo[t] for t in tokens(text)]
                seen.update((int(toxic > 0), round(1000 * w)) for w in found if w)
                seen[int(toxic > 0), 0] += len(found)  # at 0: all tokens
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], names=["y", "weight", "n"])

    shared = context.broadcast(model)
    found = rows.mapInArrow(weights, "y int, weight long, n long").groupBy("y", "weight").agg(F.sum("n").alias("n")).collect()
    if {r.y for r in found} != {0, 1}:
        return
    clean = [(r.weight / 1000, r.n) for r in found if not r.y and r.weight]
    ups, counts = np.array([c[0] for c in clean]), np.array([c[1] for c in clean], float)
    n = next(r.n for r in found if not r.y and not r.weight)
    model.drift = fit_drift(n, ups, counts)
    model.lam = fit_lambda(n, ups, counts, max(r.weight for r in found) / 1000, model.drift)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(shared.value.weight)
        for batch in slices(batches):
            scanned = [shared.value.scan(x, memo) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in scanned], pa.int64()), pa.array([max((s for *_, s in x), default=0.0) for _, x in scanned], pa.float64())], names=["n", "top"])

    shared = context.broadcast(model)
    best = [r for r in rows.where("toxic = 0").mapInArrow(tops, "n long, top double").collect() if r.n]
    extreme = [model.lam * r.top - math.log(r.n) for r in best if r.top > 0]
    # rows without a positive token have no maximum; K is scaled by the share that has one
    model.k = math.exp(float(np.mean(extreme)) - 0.5772) * len(extreme) / len(best) if extreme else 1 / max(n, 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(shared.value.weight)
        for batch in slices(batches):
            found = [sum(s for *_, s in shared.value.significant(*shared.value.scan(x, memo))) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.float64())], names=["y", "x"])

    shared = context.broadcast(model)
    pairs = rows.mapInArrow(sums, "y int, x double").collect()
    model.curve = _fit_curve(np.log1p(np.array([r.x for r in pairs])), np.array([float(r.y > 0) for r in pairs]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) for every row, from its text alone.

    passages has every significant segment: first and last token, and minus the natural log
    of how many as good are expected by chance. A null or empty text has none and gets the
    curve's lowest score. Repeated rows are each scored; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    segment = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = shared.value, Memo(shared.value.weight)
        for batch in slices(batches):
            found = [m.significant(*m.scan(text, memo)) for text in batch.column(1).to_pylist()]
            scores = list(map(m.probability, found))
            passages = [[{"first": a, "last": b, "score": s} for a, b, s in x] for x in found]
            values = [batch.column(0), pa.array(map(held_out, batch.column(0).to_pylist()), pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(passages, segment)]
            yield pa.RecordBatch.from_arrays(values, names=["doc_id", "held_out", "score", "predicted", "passages"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<first: int, last: int, score: double>>")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic.

    Null and empty texts stay. Repeated rows stay or go together; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = shared.value, Memo(shared.value.weight)
        for batch in slices(batches):
            keep = [m.probability(m.significant(*m.scan(text, memo))) < THRESHOLD for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
