"""Alignment, spelling variants and fingerprints against brute force and the tokenizers' own libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import types as T
from tokenizers import Tokenizer

from linkspan.llm import align, spotsigs, variants
from linkspan.llm.common import tokenizer_file

FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(tokenizer_file(align.BYTE_LEVEL))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(align.PIECES))


def plain_groups(libraries, text):
    """Groups by walking both lists of tokens, from the libraries' ids of the whole text."""
    if not text:
        return []
    tokens_a, tokens_b = libraries
    letters = align.byte_of_letter()
    a, b = tokens_a.encode(f" {text}", add_special_tokens=False).ids, tokens_b.encode(text)
    raw_a = [bytes(letters[c] for c in tokens_a.id_to_token(i)) for i in a]
    raw_b = [bytes([int(tokens_b.id_to_piece(i)[3:5], 16)]) if tokens_b.is_byte(i) else tokens_b.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(raw_a) == b"".join(raw_b) == f" {text}".encode():
        return []
    ends_a, ends_b = set(np.cumsum(list(map(len, raw_a))).tolist()), set(np.cumsum(list(map(len, raw_b))).tolist())
    cuts = sorted(ends_a & ends_b)
    place = lambda ids, raw: zip(ids, np.searchsorted(np.array(cuts), np.cumsum(list(map(len, raw)))).tolist())
    groups = [([], []) for _ in cuts]
    for side, found in enumerate((place(a, raw_a), place(b, raw_b))):
        for i, k in found:
            groups[k][side].append(i)
    return groups


def plain_alignment(libraries, rows):
    found = [(i, plain_groups(libraries, t)) for i, t in rows]
    held, best = Counter(), defaultdict(int)
    for _, groups in found:
        held.update({(x, y) for a, b in groups for x in a for y in b})
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    for i, groups in found:
        links = [(x, y) for a, b in groups for x in a for y in b]
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        yield (i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links), hashlib.sha256(shown.encode()).hexdigest() if shown else "")


ODD = ["  two  spaces   and\n\n\nlines \n x", "tab\tand\r\nreturn", "é   　  z", "▁literal ▁ sign", "=" * 40 + " " + "-=" * 30, "x" * 5000 + " y", " ", "\n", "a ", "a\n", "日本語のテキスト。", "<0x41> <s> </s><|endoftext|> <unk>", "\x00\x01 \x1c\x1d", "👩‍👩‍👧 family 🏴", "don't we'll I'M 12345 a1b2", "x" + " " * 300 + "y", "▁", "naïve café " * 50]


def test_alignment(spark, libraries, docs, rows, no_docs):
    more = [(90_000 + k, t, *rows[0][2:]) for k, t in enumerate(ODD)]
    table = docs.union(spark.createDataFrame(more, docs.schema)).repartition(5)
    want = Counter(plain_alignment(libraries, [(r[0], r[1]) for r in [*rows, *more]]))
    got = align.digest_rows(table)
    assert got.columns == FIELDS and Counter(map(tuple, got.collect())) == want
    assert any(r[1] == 0 for r in want) and any(r[3] < min(r[1], r[2]) for r in want)
    assert align.digest_rows(no_docs).count() == 0
    shown = {(r.doc_id, len(r.groups)) for r in align.align(table).collect()}
    assert shown == {(r[0], r[3]) for r in want}
    first = next(r for r in align.align(table).collect() if r.doc_id == 90_000)
    assert [(list(g.a), list(g.b)) for g in first.groups] == plain_groups(libraries, ODD[0])
    pairs = {(r.a, r.b): (r.docs, r.best) for r in align.pair_counts(table).collect()}
    held = Counter()
    for r in [*rows, *more]:
        held.update({(x, y) for a, b in plain_groups(libraries, r[1]) for x in a for y in b})
    assert {k: n for k, (n, _) in pairs.items()} == held


def test_alignment_forgets_and_counts_wide_groups(libraries, monkeypatch):
    """A small room for segments, and groups of more links than are written out, change nothing."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["word", "naïve", "日本", "==--==", "🏴👩", "1234567", "a\nb"]) + str(rng.randrange(50)) for _ in range(80)) for _ in range(20)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"doc_id": k, "text": t} for k, t in enumerate([*texts, None, ""])], pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    usual = align._block(align.Aligner(tokenizer_file(align.BYTE_LEVEL), tokenizer_file(align.PIECES)), 0, batch)
    monkeypatch.setattr(align, "MOST_LINKS", 1)
    monkeypatch.setattr(align, "ENCODE_BYTES", 50)
    monkeypatch.setattr(align, "LONG", 8)
    small = align.Aligner(tokenizer_file(align.BYTE_LEVEL), tokenizer_file(align.PIECES), most=1)
    assert align._block(small, 0, batch) == usual == align._block(small, 0, batch)


def test_very_long_texts_align(spark, libraries):
    """10 MB in many words, and 300 kB in one."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("etaoin shrdlué") for _ in range(rng.randrange(1, 9))) for _ in range(500)]
    texts = [" ".join(rng.choices(vocabulary, k=1_700_000)), "".join(rng.choices("abcdé=", k=300_000)), "short text"]
    got = {r.doc_id: r for r in align.digest_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        groups = plain_groups(libraries, text)
        assert (got[k].n_groups, got[k].n_a, got[k].n_b) == (len(groups), sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups))


def near(a, b):
    """Whether one letter inserted, deleted or replaced makes one word of the other."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    for word, n in counts.items():
        others = [o for o in counts if near(word, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        yield word, n, len(others), best if best and counts[best] >= 5 * n else None


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aéÿz"])
def test_near_words(spark, letters):
    """Every pair of words of few letters, long runs and repeats among them."""
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(400)}
    words |= {w[:i] + w[i + 1 :] for w in list(words)[:150] for i in (0, 3, len(w) - 1) if len(w) > 6}
    words |= {"a" * n for n in range(6, 15)} | {"a" * 4000, "a" * 4001, "b" * 4000}
    counts = {w: rng.choice([5, 6, 30, 200, 2000]) for w in sorted(words)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    pairs = [frozenset((r.a, r.b)) for r in variants.near_pairs(table).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {frozenset((a, b)) for a in counts for b in counts if a < b and near(a, b)}
    form = {w: f for w, _, _, f in plain_variants(counts)}
    root = lambda w: w if form[w] is None else root(form[w])
    want = {(w, f, root(w), n, k, counts.get(f)) for w, n, k, f in plain_variants(counts)}
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group(table).collect()}
    assert got == want and any(r[2] not in (r[0], r[1]) for r in want)


def test_variants(spark, no_docs):
    """Whole texts: words, misprints by checksum, counts; rows without id or text, and rows that repeat."""
    rng = random.Random(9)
    base = [*["variant"] * 9, "Variant", "VARIANT", "varient", "colour", "color1", "naïveté", "NAÏVETÉ", "Ünïcode", "zz", "stone's", "×÷×÷×÷", "groundless"]
    texts = [(rng.choice([None, k]), " ".join(rng.choice(base) for _ in range(60)) + rng.choice(["", ".", "\n"])) for k in range(300)]
    rows = [*texts, texts[0], texts[0], (1, None), (2, "")]
    counts = Counter()
    for i, text in rows:
        for run in variants.RUN.findall(text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            counts[low if h % 199 else low[: h % len(low)] + low[h % len(low) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = {r.word: r for r in variants.variants(table).collect()}
    assert {w: r.n for w, r in got.items()} == counts
    assert {w: (r.n_near, r.form) for w, r in got.items()} == {w: (k, f) for w, _, k, f in plain_variants(counts)}
    assert any(r.form for r in got.values()) and variants.variants(no_docs).count() == 0


def plain_signatures(text):
    """Anchors and the content words behind them, word by word, each with the number of its occurrence."""
    words = spotsigs.WORD.findall(text.lower())
    out = []
    for k, word in enumerate(words):
        last = max((j for j in range(k) if words[j] in spotsigs.ANCHORS), default=None)
        alone = (k if last is None else k - last - 1) >= spotsigs.GAP or (last is None)
        if word in spotsigs.ANCHORS or word not in spotsigs.COMMON and alone:
            out.append(" ".join([word, *[w for w in words[k + 1 :] if w not in spotsigs.COMMON][: spotsigs.CHAIN]]))
    out = out or [text] * bool(text)
    return {xxhash.xxh32_intdigest(x.encode(), seed=out[:k].count(x)) for k, x in enumerate(out)}


PROSE = "the cat sat on a mat and the dog was in der garten but les chiens sont no friends of the old house near the river bank where boats go".split()


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    return ["", "!!!", "word", "the", "the the", *(" ".join(rng.choices(PROSE, k=rng.randrange(1, 150))) for _ in range(60)), *(" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=n)) for n in (3, 30, 300))]


def test_signatures(prose):
    for text in prose:
        assert set(spotsigs.signatures(text).tolist()) == plain_signatures(text), text
    assert spotsigs.signatures(None).tolist() == [] and len(spotsigs.signatures("a " * 100_000 + "b")) > 0
    own = spotsigs.signatures(prose[20])
    assert (spotsigs.read(spotsigs.shown(own)) == own).all()
    assert spotsigs.likeness(own, own) == 1.0 and spotsigs.likeness(own, own[:0]) == 0.0 and spotsigs.likeness(own, own[:1], 0.9) == 0.0


@pytest.mark.parametrize("n", [1, 2, 40])
def test_fingerprints(spark, prose, no_docs, n):
    """Every column by plain means: ties of doc_id, rows without one, repeats and nulls among them."""
    rng = random.Random(n)
    rows = [(k * 3, t) for k, t in enumerate(rng.sample(prose, n))]
    if n > 2:
        rows += [rows[5], rows[5], (rows[7][0], prose[9]), (rows[7][0], prose[30]), (None, prose[12]), (None, None), (-(2**62), prose[14]), (2**62, None)]
    hashed = lambda t: xxhash.xxh64(t.encode(), seed=42).intdigest()
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed(hashed(r[1]))))
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = Counter()
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]]):
        cut = len(t) // 3
        changed = t[: len(t) - cut] + after[:cut]
        own, new, theirs = map(plain_signatures, (t, changed, after))
        shown = lambda s: "".join(f"{x:08x}" for x in sorted(s))
        want[i, len(t), hashlib.sha256(changed.encode()).hexdigest(), shown(own), shown(new), jaccard(own, new), jaccard(own, theirs)] += 1
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in ("bucket", "k", "h", "tail", "n_chars"))])
    table = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], schema).repartition(3)
    got = spotsigs.digest_rows(table)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert Counter(map(tuple, got.collect())) == want
    assert spotsigs.digest_rows(no_docs).count() == 0 and spotsigs.fingerprints(no_docs).count() == 0


def test_near_fingerprints(spark):
    """All pairs of sets: linked exactly if their similarity is 0.8 or more; then classes and components of texts."""
    rng = random.Random(11)
    sets = []
    for _ in range(60):
        base = rng.sample(range(3000), rng.randrange(1, 60))
        for _ in range(rng.randrange(1, 6)):
            sets.append(tuple(sorted({*rng.sample(base, max(1, len(base) - rng.randrange(4))), *rng.sample(range(3000), rng.randrange(3))})))
    sets = [*dict.fromkeys(sets), ()]
    want = {frozenset((a, b)) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    found = spotsigs.near_pairs(spark.createDataFrame([(k, list(s)) for k, s in enumerate(sets)], "id long, own array<long>").repartition(3)).collect()
    assert {frozenset((r.a, r.b)) for r in found} == want and len(found) == len(want) > 20

    words = [rng.choice(PROSE) + str(k % 90) if rng.random() < 0.6 else rng.choice(PROSE) for k in range(600)]
    copy = " ".join(words)
    texts = [copy, copy, " ".join([*words[:590], "other", "end"]), " ".join(reversed(words)), None, "", "the the", "the the"]
    rows = spotsigs.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    of = {r.doc_id: (r.class_id, r.component_id) for r in rows}
    assert of[0] == of[1] and of[2][0] != of[0][0] and of[2][1] == of[0][1] != of[3][1] and of[4] == of[5] and of[6] == of[7]
