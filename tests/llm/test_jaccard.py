"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from linkspan.llm import jaccard, simhash
from linkspan.llm.graph import components


def plain_kept(rows):
    """Of each component over pairs with a 5-word Jaccard of 0.8 or more, the smallest doc_id, nulls last."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(rows):
        at = find(k)
        best[at] = min(best.get(at, (True, 0)), (i is None, i or 0))
    return Counter(None if none else i for none, i in best.values())


def edited_rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 300))]
        for _ in range(6):
            text = list(base)
            for _ in range(rng.randint(0, max(len(base) // 20, 1))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    base = [rng.choice(words) for _ in range(200)]
    for _ in range(60):  # a large group on both sides of 0.8
        text = list(base)
        for _ in range(rng.randint(0, 7)):
            text[rng.randrange(200)] = rng.choice(words)
        rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


def test_stage_finds_edited_copies(spark):
    """One changed word in 60 leaves a similarity of 51 / 61 and up, though far more than 4 bits may differ."""
    rows = edited_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert Counter(r.doc_id for r in stage(spark, table, "").collect()) == plain_kept(rows)


@pytest.mark.parametrize(("small", "members"), [(16, 512), (2, 512), (2, 3), (1, 1)])
def test_all_pairs(docs, rows, small, members):
    """Groups whole or in parts of a few sets."""
    own = [(r[0], r[1]) for r in rows]
    found = jaccard.keep_one(docs, small, members)
    assert found.columns == docs.columns
    assert Counter(r.doc_id for r in found.collect()) == plain_kept(own)


@pytest.mark.parametrize("members", [2, 5])
def test_large_groups_in_parts(spark, members):
    """Edited copies in groups on both sides of 0.8, each cut into many parts."""
    rows = edited_rows()
    found = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 1, members)
    assert Counter(r.doc_id for r in found.collect()) == plain_kept(rows)


@pytest.mark.parametrize("most", [None, 1, 3, 7, 1000])
def test_runs(most):
    """Values come whole but for those with too many rows, whatever the batches; slices of these are marked, all of them."""
    rng = random.Random(most or 0)
    keys = sorted(rng.choices(range(12), [40, 1, 1, 9, 1, 25, 1, 1, 1, 1, 30, 2], k=160))
    batches, at = [], 0
    while at < len(keys):
        step = rng.randrange(0, 9)
        batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + step], pa.int64()), pa.array(range(at, min(at + step, len(keys))), pa.int64())], names=["key", "place"]))
        at += step
    found = [(c[0].tolist(), c[1].tolist(), part) for c, part in jaccard.runs(iter(batches), most)]
    assert [p for _, places, _ in found for p in places] == list(range(160))
    for n, (own, _, part) in enumerate(found):
        if part:
            assert len(set(own)) == 1
        else:
            assert not set(own) & {k for m, x in enumerate(found) if m != n for k in x[0]}


def test_rows_that_share_an_id(spark):
    """Different texts with one doc_id both stay; copies without doc_id leave one."""
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (None, "p q r s t u"), (None, "p q r s t u"), (None, "A b c d e f g"), (2, None), (3, " ")]
    found = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert Counter(map(tuple, found.collect())) == Counter([rows[0], rows[1], rows[2], rows[5]])


def test_any_column_names(spark):
    """Columns by the names that the operator uses itself come back as they were."""
    names = ["_row", "_set", "_size", "_bits", "_prefix", "doc_id", "n", "a", "root", "column0", "text", "Least"]
    rows = [tuple(f"{n}{k}" if n not in ("doc_id", "text") else k if n == "doc_id" else ("a b c d e f g h" if k < 3 else f"other text {k}") for n in names) for k in range(6)]
    schema = ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names)
    got = jaccard.keep_one(spark.createDataFrame(rows, schema).repartition(2))
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(r for k, r in enumerate(rows) if k not in (1, 2))
    assert jaccard.keep_one(spark.createDataFrame([], schema)).count() == 0


def test_links_of_fingerprints(spark):
    """The stage links sets by SimHash: what is within 4 bits is joined before any pair that shingles find, and each such pair is checked."""
    rows = edited_rows()
    keyed = jaccard._keyed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    prints = {r._set: r._fp % 2**64 for r in keyed.select("_set", "_fp").collect()}
    assert {simhash.majority(jaccard.shingles(t)) for _, t in rows} == set(prints.values())
    pairs = jaccard._near_fingerprints(jaccard._cards(keyed))
    roots = {r.node: r.root for r in components(pairs).collect()}
    near = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert near and all(roots[a] == roots[b] for a, b in near)
    assert all(a < b for a, b in map(tuple, pairs.collect()))
    assert jaccard._apart(pairs, components(pairs)).count() == 0


def test_stage_reads_fingerprints(spark, monkeypatch):
    """The stage's rows come by way of SimHash's links."""
    seen = []
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps, distance: seen.append(distance) or links(fps, distance))
    table = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "h i j k l m n"), (4, None)], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert {r.doc_id for r in stage(spark, table, "").collect()} == {1, 3, 4} and seen == [4]
