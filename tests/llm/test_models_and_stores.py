"""Language, toxicity, search, archives and the pipeline against brute force, planted cases and round trips."""

import base64
import hashlib
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkspan.llm import bpe, langid, pii, quality, queries, topk, toxicity, warc
from linkspan.llm.common import cut, discard, held_out, shared_dir, tokenizer_file
from linkspan.llm.graph import components
from linkspan.llm.oracles import ORACLES
from tests.llm.test_text_operators import WORD, check_places, plain_base, plain_components, plain_fingerprint


def made_up(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_langid(spark, docs, no_docs):
    rng = random.Random(1)
    of = {"aa": ["ka", "to", "mi"], "bb": ["schl", "ung", "eit"], "cc": ["ción", "ado", "ñe"]}
    rows = [(i, made_up(rng, of[lang], rng.randint(3, 60)), lang) for i in range(900) for lang in [rng.choice("abc") * 2]]
    table = spark.createDataFrame([*rows, (9001, None, "aa"), (9002, "12 + 3 !!", "aa"), (9003, "kato", None), (None, "schlung eit", None)], "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.predict(table, langid.train(table)).collect()}
    assert len(found) == 904
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 for i, r in found.items())
    out = [(found[i].lang_pred, lang) for i, _, lang in rows if held_out(i)]
    assert np.mean([a == b for a, b in out]) > 0.98
    assert [found[i].lang_pred for i in (9001, 9002, 9003, None)] == ["und", "und", "aa", "bb"]
    # a held-out row's label is not learned, and another batch size changes nothing
    model, other = langid.train(table), langid.train(table.withColumn("lang", __import__("pyspark").sql.functions.expr("if(crc32(cast(doc_id as string)) % 3 = 1, 'zz', lang)")))
    assert model.langs == other.langs and np.array_equal(model.logp, other.logp)
    assert langid.predict(docs, langid.train(no_docs)).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(no_docs, model).count() == 0


def test_langid_in_parts(spark, docs, monkeypatch):
    """Any number of languages: parts of one, two or all languages predict the same, and more languages than a part has are learned."""
    rng = random.Random(8)
    rows = [(k, " ".join("".join(chr(97 + k % 13 + rng.randrange(5)) for _ in range(4)) for _ in range(30)), f"l{k % 13}") for k in range(400)]
    table = spark.createDataFrame([*rows, (900, None, "l1"), (901, "1 2 3", "l2"), (902, "", None)], "doc_id long, text string, lang string").withColumn("best", F.lit("x"))
    model = langid.train(table)
    assert len(model.langs) == 13
    told = lambda: {r.doc_id: (r.held_out, r.lang_pred, round(r.score, 9)) for r in langid.predict(table, model).collect()}
    whole = told()
    for most in (1, 5):
        monkeypatch.setattr(langid, "MOST_LANGS", most)
        assert len(list(model.parts())) == -(-13 // most) and told() == whole
    held = [(r[2], whole[r[0]][1]) for r in rows if whole[r[0]][0]]
    assert sum(a == b for a, b in held) > 0.95 * len(held) and whole[900][1:] == whole[901][1:] == ("und", 0.0)


def test_langid_scores_are_sums():
    rng = np.random.default_rng(2)
    model = langid.Model(["x", "y"], np.log([0.5, 0.5]), rng.normal(size=(2, langid.BUCKETS)).astype(np.float32))
    texts = ["abc", "", "a", "zürich und so", "ab"]
    want = []
    for t in texts:
        one = model.prior.copy()
        for ids, starts, ends in langid.grams([t]):
            one += model.logp[:, ids[starts[0] : ends[0]]].sum(1)
        want.append(one)
    assert np.allclose(model.scores(texts), want)


def plain_segments(scores):
    """All maximal scoring segments by definition: recursive choice of the best, then each side."""
    if not len(scores):
        return []
    sums = np.concatenate(([0], np.cumsum(scores)))
    best = max(((sums[b] - sums[a], -(b - a), -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    if best[0] <= 0:
        return []
    a, b = best[3], best[4]
    return plain_segments(scores[:a]) + [(a, b - 1, best[0])] + [(x + b, y + b, s) for x, y, s in plain_segments(scores[b:])]


def test_maximal_segments():
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = np.where(rng.random(25) < 0.4, rng.random(25) * 3, -0.37)
        places = np.flatnonzero(scores > 0)
        found = toxicity.maximal_segments(places.tolist(), scores[places].tolist(), 0.37)
        want = [(a, b, s) for start in [0] for a, b, s in plain_segments(scores)]
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in found], [s for *_, s in want])


def toxic_rows(rng, n):
    syllables = ["er", "th", "an", "ti", "on", "es", "ou", "nd"]
    rows, labels = [], []
    for i in range(n):
        text, toxic = made_up(rng, syllables, rng.randint(5, 300)).split(" "), rng.random() < 0.15
        for _ in range(rng.randint(1, 6) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["vile", "scum", "grolx" + rng.choice(syllables)]))
        rows.append((i, " ".join(text)))
        if rng.random() < 0.9:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark, docs, no_docs):
    rng = random.Random(4)
    rows, labels = toxic_rows(rng, 1500)
    table = spark.createDataFrame([*rows, (5001, None), (5002, ""), (None, "vile scum")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 1), (77_777, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(table, marks)
    found = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    assert len(found) == 1503 and found[None].predicted == 1 and found[5001].score == found[5002].score < 0.7
    held = [(found[i].predicted, t) for i, _, t in labels if held_out(i)]
    assert np.mean([p == t for p, t in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == held_out(i) for i, r in found.items())
    kept = toxicity.keep_clean(table, model).collect()
    assert Counter(r.doc_id for r in kept) == Counter(i for i, r in found.items() if not r.predicted)
    assert toxicity.score(docs, toxicity.train(no_docs, marks.limit(0))).where("predicted = 1").count() == 0
    assert toxicity.score(no_docs, model).count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def test_topk(spark):
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in v] for v in rng.normal(size=(300, 8)).astype(np.float32)]
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[7], "x") for i in range(40)]  # one very common vector
    rows += [(50_000, None, "x"), (50_050, [None] + [1.0] * 7, "x"), (50_100, [float("nan")] * 8, "x"), (None, vectors[3], "x"), (2000, [1.0, 2.0], "x"), (2050, [3.0, -1.0], "x"), (2100, [], "x"), (3, vectors[3], "x"), (3000, [-1e6] * 8, "x"), (3050, [0.0] * 8, "x")]
    rows += [(3, vectors[3], "x"), (50, vectors[9], "x"), (50, vectors[50], "x"), (120, vectors[120], "y")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    good = [(i, tuple(int(np.floor(256 * x)) for x in v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in {i for i, _ in good if i % 50 == 0}:
        answers = sorted((-sum(a * b for a, b in zip(v, w)), i) for p, v in good if p == q for i, w in good if i != q and len(w) == len(v))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(answers)]
    assert Counter(map(tuple, topk.search(table).collect())) == Counter(want)
    assert topk.search(table.limit(0)).count() == 0


def test_topk_beyond_half_a_long(spark):
    """Large rows among small ones, whose scores pass 2**62, are exact and spoil no other; a score that is no long is an error of its own."""
    schema, rng = "vec_id long, embedding array<float>", random.Random(2)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(64)]) for k in range(120)] + [(150, [1.2e6] * 64), (151, [1.2e6] * 63 + [-1.2e6]), (152, [-1.1e6] * 64), (153, [5e6] + [0.0] * 63)]
    table = spark.createDataFrame(rows, schema)
    whole = {k: [int(np.floor(256 * float(np.float32(x)))) for x in v] for k, v in rows}
    score = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b]))
    want = []
    for q in (k for k in whole if k % 50 == 0):
        best = sorted((k for k in whole if k != q), key=lambda k: (-score(q, k), k))[:5]
        want += [(q, n + 1, k, score(q, k)) for n, k in enumerate(best)]
    assert Counter(map(tuple, topk.search(table).collect())) == Counter(want) and max(w[3] for w in want) > 2**62
    with pytest.raises(Exception, match="OVERFLOW"):
        topk.search(spark.createDataFrame([(0, [3e7] * 4), (1, [3e7] * 4)], schema)).collect()


def test_topk_by_waves(spark, monkeypatch):
    """Small blocks and waves of one block give what one wave gives."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(900, 4)))], "vec_id long, embedding array<double>")
    want = topk.search(rows, every=3).collect()
    monkeypatch.setattr(topk, "QUERY_BLOCK", 40)
    monkeypatch.setattr(topk, "WAVE_BYTES", 1)
    monkeypatch.setattr(topk, "TASK_VECTORS", 200)
    assert Counter(topk.search(rows, every=3).collect()) == Counter(want)


def test_warc(spark, tmp_path):
    rows = [(i, f"http://a/{i}?q=é b\r\n", "<p>" + "x" * (i % 7) * 50) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (None, "http://n", "<p>only</p>"), (None, "http://n", "<p>"), (7, "http://a/7", rows[7][2]), (200, "z", "ü" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", __import__("pyspark").sql.functions.lit("clash")).repartition(3)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = first.get(h or "", i) != i
        want.append((i, len(raw), warc.sha1_base32(raw), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    assert Counter(map(tuple, warc.archive(pages).collect())) == Counter(want)
    assert warc.archive(pages.limit(0)).count() == 0
    index = warc.write(pages, f"file://{tmp_path}/w", min_bytes=10**9)
    assert index.where("record_type = 'revisit'").count() == 0
    some = index.where("page_id % 10 = 3")
    assert Counter(r.page_id for r in warc.read(some).collect()) == Counter([3, 13, 23, 33, 43, 53])
    store, _ = pyarrow.fs.FileSystem.from_uri(f"file://{tmp_path}")
    row = index.where("page_id = 200").first()
    headers, http, payload = warc.parse(store.open_input_file(row.path.removeprefix("file://")).read_at(row.length, row.offset))
    assert payload == ("ü" * 100_000).encode() and headers["WARC-Type"] == "response" and b"200 OK" in http


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 201), (200, 202), (200, 203), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 100, 101: 100} | {200 + i: 200 for i in range(4)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_folder_is_the_clusters(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    table = cut(spark.range(3), "x")
    there = lambda: [x for x in os.listdir(f"{shared_dir(spark).removeprefix('file://')}/linkspan") if x.startswith("x-")]
    assert there()
    discard(table, table)
    assert not there()


def plain_sets(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def plain_one_of_each(rows):
    """Of rows (id, text), one of each group that links of Jaccard 0.8 connect, by all pairs."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, plain_sets(t)) for i, t in rows]
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i, _ in rows}


def test_pipeline(spark, sf_dir):
    """run() against plain Python: rules by DuckDB, all pairs, plain redaction and the tokenizer's library; models decide as they score."""
    tokenizers = pytest.importorskip("tokenizers")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    toxic = toxicity.score(table, toxicity.train(table, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    clean = {r.doc_id for r in toxic.where("predicted = 0").collect()}
    rows = [(r.doc_id, r.text) for r in table.collect() if r.doc_id in clean]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({ORACLES['op6_quality']}) WHERE kept").fetchall()}
    rows = [(i, quality.judge(t)[1]) for i, t in rows if i in kept]
    ones = plain_one_of_each(rows)
    rows = [(i, t) for i, t in rows if i in ones]
    model = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    library = tokenizers.Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = []
    for i, text in rows:
        base, _, wide = pii.candidates(text)
        spans, out, end = pii.ordered([*base, *(s for s, _ in model.added(text, wide))]), "", 0
        for kind, a, b in spans:
            if a >= end:
                out += text[end:a] + f"[{kind.upper()}]"
            end = max(end, b)
        ids = [*library.encode(out + text[end:], add_special_tokens=False).ids, 1]
        want += [(i, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(tuple(r)[:5] for r in found) == Counter(want)
    assert len(clean) < table.count() and len(ones) < len(kept) < len(clean)
    bins = Counter()
    for r in found:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 4096 and len(bins) == -(-sum(bins.values()) // 4096)


@pytest.fixture(scope="session")
def larger_dir(sf_dir):
    at = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    return at if os.path.isdir(at) else sf_dir


def test_registered_models_on_held_out_documents(spark, larger_dir):
    """Accuracy of op2 and op3, as registered, on rows that they do not learn from."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{larger_dir}/documents.parquet").collect()}
    langs = [r for r in queries.queries()["op2_langid"](spark, larger_dir).collect()]
    assert len(langs) == len(docs) and all(r.held_out == held_out(r.doc_id) for r in langs)
    judged = [r.lang_pred == docs[r.doc_id].lang for r in langs if r.held_out and docs[r.doc_id].lang and langid.has_letter(docs[r.doc_id].text or "")]
    assert len(judged) > 50 and np.mean(judged) > 0.95
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger_dir}/labels.parquet").collect() if r.toxic is not None}
    scored = [r for r in queries.queries()["op3_toxicity"](spark, larger_dir).collect()]
    assert len(scored) == len(docs)
    held = [(r.predicted, labels[r.doc_id]) for r in scored if r.held_out and r.doc_id in labels]
    assert np.mean([p == t for p, t in held]) > 0.93
    assert not [1 for p, t in held if p and not t][3:]


def test_registered_texts_on_documents(spark, sf_dir):
    """op1, op4, op5, op7 and op8, as registered, against plain versions and the libraries."""
    sentencepiece, tiktoken, tokenizers = (pytest.importorskip(x) for x in ("sentencepiece", "tiktoken", "tokenizers"))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = queries.queries()
    pairs = [(i, plain_fingerprint(t)) for i, t in rows]
    reached = plain_components(pairs)
    assert {tuple(r)[:3] for r in found["op1_simhash"](spark, sf_dir).collect()} == {(i, f"{f:016x}", reached[f]) for i, f in pairs}
    spans = {r.doc_id: r for r in found["op4_pii"](spark, sf_dir).collect()}
    for i, t in rows:
        base = plain_base(t)
        assert spans[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [spans[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(filter(None, spans[i].spans.split(",")))
    library = tokenizers.Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    packed = found["op5_packing"](spark, sf_dir).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in packed) == Counter((i, k, zlib.crc32(np.array(x[a : a + 4096], "<u4").tobytes())) for i, x in ids.items() for k, a in enumerate(range(0, len(x), 4096)))
    assert len(check_places(packed, 4096)) == -(-sum(map(len, ids.values())) // 4096)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_file(bpe.RANKS), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = {i: np.array(coder.encode_ordinary(t or ""), "<u4").tobytes() for i, t in rows}
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in found["op7_bpe"](spark, sf_dir).collect()} == {(i, len(x) // 4, hashlib.sha256(x).hexdigest()) for i, x in coded.items()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    assert {(r.doc_id, r.n_tokens) for r in found["op8_token_count"](spark, sf_dir).collect()} == {(i, len(pieces.encode(t or ""))) for i, t in rows}


@pytest.mark.parametrize("name", [s[0] for s in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, docs, no_docs, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, no_docs, sf_dir).count() == 0
    assert stage(spark, docs, sf_dir).count() > 0
