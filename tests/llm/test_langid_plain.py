"""Language identification against a plain naive Bayes, gram by gram."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from linkspan.llm import langid


def plain_buckets(text):
    out = []
    for order in (2, 3):
        for k in range(len(text) - order + 1):
            h = 0
            for c in text[k : k + order]:
                h = (h + ord(c)) * 2654435761 % 2**32
                h ^= h >> 15
            out.append(h % langid.BUCKETS)
    return out


def test_every_column_by_plain_means(spark):
    """Whole result: counts, smoothing, priors, posterior, held-out flag; null ids, texts and languages, ties and repeats among the rows."""
    rng = random.Random(21)
    sounds = {"xx": ["ba", "do", "ké", " "], "yy": ["shr", "mo", "ba", " "], "zz": ["ñu", "ké", "tt", " ", "."]}
    rows = []
    for k in range(240):
        lang = rng.choice([*sounds, None])
        rows.append((k, "".join(rng.choice(sounds[lang or "xx"]) for _ in range(rng.randrange(1, 60))), lang))
    rows += [(500, None, "xx"), (501, "", "yy"), (502, "12 34", "zz"), (None, "ba do ba do", "xx"), (503, "BA Do ké", None), rows[3], rows[3], (504, "q", None)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    counts, n = {}, Counter()
    for _, text, lang in {r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and not held(r[0])}:
        counts.setdefault(lang, Counter()).update(plain_buckets(text.lower()))
        n[lang] += 1
    logp = {x: {b: np.float32(math.log((counts[x][b] + 0.5) / (sum(counts[x].values()) + 0.5 * langid.BUCKETS))) for b in range(langid.BUCKETS)} for x in counts}
    want = Counter()
    for i, text, _ in rows:
        low = (text or "").lower()
        joint = {x: math.log(n[x] / sum(n.values())) + sum(float(logp[x][b]) for b in plain_buckets(low)) for x in sorted(counts)}
        best = max(joint, key=joint.get)
        known = any(c.isalpha() for c in low)
        score = 1 / sum(math.exp(v - joint[best]) for v in joint.values()) if known else 0.0
        want[i, held(i), best if known else "und", round(score, 6)] += 1
    table = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, source string").repartition(3)
    got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in langid.predict(table, langid.train(table)).collect())
    assert got == want and len({k[2] for k in want}) == 4
