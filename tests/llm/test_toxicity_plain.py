"""Toxicity scores of whole texts by plain means: every segment's score from its definition, for a model as it was learned."""

import math
import random
import zlib
from collections import Counter

from linkspan.llm import toxicity


def plain_segments(scores):
    """The best-scoring run of tokens, then the same on either side of it, while scores are positive."""
    todo, out = [(0, len(scores))], []
    while todo:
        a, b = todo.pop()
        best, at = 0.0, None
        low, start, total = 0.0, a, 0.0
        for k in range(a, b):
            total += scores[k]
            if total - low > best + 1e-12:
                best, at = total - low, (start, k)
            if total < low:
                low, start = total, k + 1
        if at:
            out.append((*at, best))
            todo += [(a, at[0]), (at[1] + 1, b)]
    return out


def test_every_column_by_plain_means(spark):
    rng = random.Random(4)
    plain, rude = ["sea", "town", "river", "boat", "light", "bread", "walk", "über", "naïve", "idle"], ["moron", "moronic", "idiot", "idiots", "stupid"]
    rows, labels = [], []
    for k in range(400):
        toxic = k % 4 == 0
        words = rng.choices(plain, k=rng.randrange(20, 120))
        for _ in range(rng.randrange(2, 5) if toxic else rng.random() < 0.05):
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(rude, k=rng.randrange(2, 6) if toxic else 1)
        rows.append((k, " ".join(words) + rng.choice([".", "!", ""])))
        labels.append((k, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "!!!"), (None, "stupid moron idiot " * 3), rows[0], rows[0], (1003, "sea " * 30_000 + "moron idiot stupid moron " * 4 + "boat " * 30_000)]
    table = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, passages string, score double").repartition(3)
    model = toxicity.train(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    want = Counter()
    for i, text in rows:
        words = toxicity.tokens(text)
        weights = [model.weight(w) for w in words]
        # a token scores its weight less the drift, if that is positive, else the drift is lost
        segments = plain_segments([w - model.drift if w > model.drift else -model.drift for w in weights])
        expected = [(model.lam * s - math.log(max(model.k * len(words), 1e-9))) for _, _, s in segments]
        total = sum(x for x in expected if x > -math.log(toxicity.E_VALUE))
        x = model.curve[0] + model.curve[1] * math.log1p(total)
        score = 1 / (1 + math.exp(-x))
        want[i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1, round(score, 9), int(score >= toxicity.THRESHOLD)] += 1
    got = Counter((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in toxicity.score(table, model).collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    right = [(k[3], k[0] % 4 == 0) for k in want if k[1] and k[0] is not None and k[0] < 400]
    assert sum(p for p, t in right if t) > 0.9 * sum(t for _, t in right) and sum(p for p, t in right if not t) < 0.1 * len(right)
