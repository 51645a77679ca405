"""SimHash, quality rules, personal data and tokenizers against brute force and the libraries."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
import xxhash

from linkspan.llm import bpe, packing, pii, quality, simhash, token_count
from linkspan.llm.common import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, distance=4):
    """The smallest id that each of the (id, fingerprint) pairs reaches."""
    best = {f: min((i for i, g in pairs if g == f and i is not None), default=None) for _, f in pairs}
    root = {f: f for f in best}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fps = list(best)
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= distance:
                root[find(fps[a])] = find(fps[b])
    smallest = {}
    for f, i in best.items():
        if i is not None:
            smallest[find(f)] = min(i, smallest.get(find(f), i))
    return {f: smallest.get(find(f)) for f in best}


def as_set(rows):
    return Counter(map(tuple, rows))


def test_simhash(docs, rows, no_docs):
    pairs = [(r[0], plain_fingerprint(r[1])) for r in rows]
    reached = plain_components(pairs)
    want = Counter((i, f"{f:016x}", reached[f]) for i, f in pairs)
    assert as_set(simhash.digest_rows(docs).collect()) == want
    assert simhash.digest_rows(no_docs).count() == 0


@pytest.mark.parametrize("distance", [1, 2, 3, 4, 5, 6])
@pytest.mark.parametrize("hot", [4096, 1])
def test_simhash_links_at_every_distance(spark, distance, hot):
    rng = np.random.default_rng(distance)
    fps = {int(x) for x in rng.integers(0, 2**63, 12)}
    for start in list(fps):
        for n in range(1, 9):
            fps.add(start ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    fps = sorted(fps)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), distance=distance, hot=hot)).collect()
    root = {r.node % 2**64: r.root for r in found}
    want = plain_components([(f, f) for f in fps], distance)
    groups = lambda of: {frozenset(f for f in fps if of.get(f, f) == v) for v in {of.get(f, f) for f in fps}}
    assert groups(root) == groups(want)


@pytest.mark.parametrize("hot", [4096, 3])
def test_simhash_links_all(spark, hot):
    """Clusters, chains and near misses; also with nearly every anchor taken for a hot one."""
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 2**63, 40)]
    for start in fps[:8]:
        at = start
        for _ in range(12):
            for bit in rng.choice(64, rng.integers(1, 7), replace=False):
                at ^= 1 << int(bit)
            fps.append(at)
    fps = sorted(set(fps))
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), hot=hot)).collect()
    root = {r.node % 2**64: r.root for r in found}
    want = plain_components([(f, f) for f in fps])
    groups = lambda of: {frozenset(f for f in fps if of.get(f, f) == v) for v in {of.get(f, f) for f in fps}}
    assert groups(root) == groups(want)


def test_golay_covers():
    code = simhash.Golay()
    words = np.random.default_rng(2).integers(0, 2**23, 3000)
    nearest = words ^ code.error[code.rest[words]]
    assert (code.rest[nearest] == 0).all()
    assert max(int(x).bit_count() for x in words ^ nearest) <= 3


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_quality(docs, rows, no_docs):
    found = quality.rules(docs).collect()
    assert Counter(tuple(r)[:7] for r in found) == Counter((r[0], *plain_quality(r[1])) for r in rows)
    assert not any(r.kept and r.base_failed for r in found)
    assert quality.rules(no_docs).count() == 0
    assert sum(r.kept for r in found) == quality.clean(docs).count()
    assert quality.clean(docs).columns == docs.columns


def test_quality_lines():
    prose = "The first line says something plain and true about the river, the town and its people.\n"
    menu = "Home | News | Sports | Contact\nAll rights reserved.\n"
    counts, text = quality.judge(prose * 1 + "Another sentence follows with words of its own kind.\n" + menu)
    assert counts["kept"] and "Home" not in text and "rights" not in text
    assert not quality.judge("\n".join(f"{w} | b{w} | c{w}" for w in "pqrstuvw"))[0]["kept"]


@pytest.mark.parametrize("size", [5, 7, 40, 9000])
def test_repeated_words_of_many_words(size):
    rng = np.random.default_rng(size)
    words = [b"%d" % x for x in rng.integers(0, size, 9000)] + [b"%d" % x for x in range(40)] * 2
    assert quality.repeated_words(words) == plain_quality(b" ".join(words).decode())[4]


def plain_base(text):
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_base(docs, rows, no_docs):
    found = pii.digest_rows(docs, pii.Model()).collect()
    want = []
    for r in rows:
        spans = plain_base(r[1])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((r[0], *(sum(s[0] == k for s in spans) for k in pii.KINDS), hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert as_set(found) == as_set(want)
    assert any(r.spans for r in found)
    assert pii.digest_rows(no_docs, pii.train(no_docs)).count() == 0


def test_pii_random_base():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(rng.choice(list("01234567 ..--@@a+()%"), 60))
        assert pii.ordered([s for s, ok in pii.base_matches(text) if ok]) == plain_base(text)


def private_rows(n):
    rng = random.Random(4)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    words = lambda: " ".join(rng.choice(["the", "at", "dot", "river", "Town.", "and", "of", "mill", "in", "call"]) for _ in range(rng.randint(3, 9)))

    def card():
        while True:
            found = digits(16)
            if pii.luhn(found):
                return found

    parts = lambda: rng.choice([f"jo.{digits(2)}@mail{rng.randrange(9)}.example.com", card(), digits(16), f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", ".".join(str(rng.randrange(1, 256)) for _ in range(4)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"v{rng.randrange(9)}.{rng.randrange(99)}"])
    return [(i, f"{words()} {parts()} {words()} {parts()} {words()}") for i in range(n)]


def test_pii_boosting(spark):
    """Trees tell valid from failed candidates; what people disguise is found, and little else."""
    rows = private_rows(1500)
    docs = spark.createDataFrame([*rows, (7000, ""), (None, "1.1.1.1"), (7001, None)], "doc_id long, text string")
    model = pii.train(docs)
    assert set(model.thresholds) == set(pii.KINDS)
    x = np.array([pii.features("card 4111111111111111 x", ("card", 5, 21)), pii.features("card 4111111111111112 x", ("card", 5, 21))])
    good, bad = model.trees["card"].scores(x)
    assert good > 0.8 > 0.2 > bad
    for r in pii.detect(docs, model).collect():
        taken = {k for s in r.base for k in range(s.start, s.end)}
        assert all(taken.isdisjoint(range(s.start, s.end)) for s in r.added)
    hits = Counter()
    for i, text in private_rows(4000)[1500:]:
        base, failed, _ = pii.candidates(text)
        other, right, _ = pii.disguised(text, base, failed, random.Random(i))
        taken, _, wide = pii.candidates(other)
        found = {s for s, _ in model.added(other, wide)}
        missing = {s for s in right - found if not any(t[1] < s[2] and s[1] < t[2] for t in taken)}
        for kind in pii.KINDS:
            hits[kind, "right"] += sum(s[0] == kind for s in found & right)
            hits[kind, "wrong"] += sum(s[0] == kind for s in found - right)
            hits[kind, "missing"] += sum(s[0] == kind for s in missing)
    for kind in pii.KINDS:
        assert hits[kind, "right"] > 50, (kind, hits)
        assert hits[kind, "right"] >= 0.9 * (hits[kind, "right"] + hits[kind, "wrong"]), (kind, hits)
        assert hits[kind, "right"] >= 0.9 * (hits[kind, "right"] + hits[kind, "missing"]), (kind, hits)
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame([(0, "ask jo.7 [at] mail3 [dot] example [dot] com or +1 (555) 010-1234"), (1, None)], "doc_id long, text string"), model).collect()}
    assert out == {0: "ask [EMAIL] or [PHONE]", 1: None}
    assert set(pii.train(spark.createDataFrame([(1, "no numbers")], "doc_id long, text string")).thresholds) == set(pii.KINDS)


def test_bpe_is_the_library(docs, rows, no_docs):
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizer_file(bpe.RANKS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in rows:
        ids = np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes()
        want.append((r[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert as_set(bpe.round_trip(docs).collect()) == as_set(want)
    assert bpe.round_trip(no_docs).count() == 0
    both = bpe.decode(bpe.encode(docs)).collect()
    assert Counter((r.doc_id, bytes(r.raw).decode()) for r in both) == Counter((r[0], r[1] or "") for r in rows)


def test_token_counts_are_the_librarys(docs, rows, no_docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(token_count.PIECES))
    want = Counter((r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 4096) for r in rows)
    assert as_set(token_count.count_tokens(docs).collect()) == want
    assert as_set(token_count.count_tokens(docs, chunk=7).collect()) == want
    assert token_count.count_tokens(no_docs).count() == 0


def test_token_counts_of_very_long_texts(spark):
    """Ten megabytes with and without spaces, by chunks that different tasks map."""
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(token_count.PIECES))
    rng = np.random.default_rng(11)
    syllables = ["er", "th", "an", "ti", "on", "es", "É", "ou", "1", ".", "日", "\n", "ß"]
    draw = lambda n, more: "".join(np.array([*syllables, *more])[rng.integers(0, len(syllables) + len(more), n)])
    texts = [draw(5_000_000, [" "] * 4), draw(5_000_000, []), "a" * 300_000, "-" * 100_001, " " * 70_000, "ab" * 60_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: (len(t.encode()), len(library.encode(t))) for i, t in enumerate(texts)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_count.count_tokens(rows).collect()} == want


def test_texts_whose_chunks_do_not_meet(spark, monkeypatch):
    """Without a context each chunk is mapped from the start state only; other texts are run in one piece."""
    monkeypatch.setattr(token_count, "CONTEXT", 0)
    monkeypatch.setattr(token_count.Transducer, "chunk_map", lambda self, context, chunk, first: {} if not first else {"x": ("y", 1)})
    own = token_count.Transducer(tokenizer_file(token_count.PIECES))
    texts = ["in the beginning " * 9, "aaaaaaaaaaaaaaaaaaaa", "short"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_count.count_tokens(rows, chunk=16).collect()} == {i: own.count(t) for i, t in enumerate(texts)}


def test_state_maps_compose():
    own = token_count.transducer(None)
    rng = np.random.default_rng(7)
    for _ in range(300):
        text = "".join(rng.choice(list("abcé. \n  "), rng.integers(1, 60)))
        cuts = sorted({0, len(text), *(int(x) for x in rng.integers(1, len(text) + 1, 4))})
        at, total = own.name(own.root), 0
        for a, b in pairwise(cuts):
            at, n = own.chunk_map(token_count.SPACE + text[:a], text[a:b], a == 0)[at]
            total += n
        assert total == own.count(text)


def test_transducer_is_the_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(token_count.PIECES))
    own = token_count.Transducer(tokenizer_file(token_count.PIECES), most=3000)  # forgets its states now and then
    pieces = sorted(own.scores)
    rng = np.random.default_rng(12)
    for n in rng.integers(1, 12, 3000).tolist():
        text = "".join(pieces[k][: rng.integers(1, 9)] for k in rng.integers(0, len(pieces), n).tolist())
        assert own.count(text) == len(library.encode(text)), text


def test_packing(docs, rows, no_docs):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = []
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 64)):
            part = ids[a : a + 64]
            want.append((r[0], k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    found = packing.pack_documents(docs, capacity=64).collect()
    assert as_set(tuple(r)[:5] for r in found) == as_set(want)
    check_places(found, 64)
    assert packing.pack_documents(no_docs).count() == 0


def check_places(found, capacity):
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


def test_packing_levels(spark, monkeypatch):
    """Several shards, dissolved bins and islands: each item once, close to the bound."""
    monkeypatch.setattr(packing, "SHARD_ITEMS", 200)
    rng = np.random.default_rng(8)
    sizes = [int(x) for x in rng.integers(1, 4097, 1500)]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length long")
    found = packing.pack(items).join(items, "item").collect()
    assert sorted(r.item for r in found) == list(range(1500))
    assert len(check_places(found, 4096)) <= 1.04 * -(-sum(sizes) // 4096)


def test_crossover_keeps_items():
    rng = random.Random(9)
    sizes = [rng.randint(1, 100) for _ in range(120)]
    a, b = packing.best_fit([], list(range(120)), sizes, 100), packing.best_fit([], list(range(119, -1, -1)), sizes, 100)
    for child in (packing.crossover(a, b, sizes, 100, rng), packing.mutate(a, sizes, 100, rng), packing.evolve(sizes, 100, 1, [a, b])[0]):
        assert sorted(i for _, held in child for i in held) == list(range(120))
        assert all(room == 100 - sum(sizes[i] for i in held) >= 0 for room, held in child)


@pytest.mark.parametrize(("low", "high", "gain"), [(1, 4096, 0), (900, 2100, 4), (1000, 1700, 40)])
def test_evolution_against_best_fit(low, high, gain):
    """Two epochs of two islands: generations are run, and bins are never more than best fit's, and fewer on hard sizes."""
    rng = random.Random(low)
    sizes = [rng.randint(low, high) for _ in range(3000)]
    falling = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    plain = len(packing.best_fit([], falling, sizes, 4096))
    elite = [packing.evolve(sizes, 4096, seed, []) for seed in (1, 2)]
    assert all(n > 0 for _, n in elite)
    best = min((packing.evolve(sizes, 4096, 3 + k, [x[0] for x in (elite if k else elite[::-1])]) for k in (0, 1)), key=lambda x: len(x[0]))
    assert len(best[0]) <= plain - gain, (len(best[0]), plain)
