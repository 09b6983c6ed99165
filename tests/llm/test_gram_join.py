import random
import tracemalloc
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import gram_join as G
from millrace.llm import links as L
from millrace.llm.textvec import normalise


def grams(text, n):
    w = normalise(text).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(docs, n, t):
    sets = {}
    for i, text in docs:
        if i is not None and grams(text, n):
            sets.setdefault(i, []).append(grams(text, n))
    out = set()
    for a, b in combinations(sorted(sets), 2):
        if any(len(x & y) >= t * len(x | y) - 1e-12 for x in sets[a] for y in sets[b]):
            out.add((a, b))
    return out


def pairs_of(docs, *how):
    """The pairs of ids, with copies multiplied out."""
    pairs, members = G.similar_pairs(docs, *how)
    ids = {}
    for r in members.collect():
        ids.setdefault(r["class"], set()).add(r.doc_id)
    both = {(a, b) for r in pairs.collect() for a in ids[r.class_a] for b in ids[r.class_b]} | {(a, b) for own in ids.values() for a in own for b in own}
    return {(min(p), max(p)) for p in both if p[0] != p[1]}


def linked_of(pairs):
    """(id, smallest id of its component, number of partners) of each id in pairs."""
    parent, degree = {}, {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {(i, root(i), degree[i]) for i in degree}


def rows_of(df):
    assert df.columns == ["doc_id", "class_id", "n_links"]
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return set(map(tuple, rows))


def corpus(made_words, seed=1, n=150):
    r = random.Random(seed)
    vocabulary = made_words(2, 60)
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 40)))) for i in range(n)]
    for i in range(n, 2 * n):
        w = docs[r.randrange(n)][1].split()
        for _ in range(r.randint(0, 6)):
            k = r.randrange(len(w))
            w[k : k + r.randint(0, 2)] = [r.choice(vocabulary)]
        docs.append((i, " ".join(w)))
    return docs


def test_pairs_equal_brute_force(docs_of, made_words):
    docs = corpus(made_words)
    for n, t in ((5, 0.4), (2, 0.7), (3, 0.25)):
        assert pairs_of(docs_of(docs), n, t) == brute(docs, n, t)
        assert rows_of(G.similar_documents(docs_of(docs), n, t)) == linked_of(brute(docs, n, t))


def test_frequent_grams_and_parted_groups(docs_of, made_words):
    docs = corpus(made_words, 9)
    shared = " ".join(made_words(11, 12))
    docs += [(1000 + i, f"{shared} {' '.join(made_words(i, 3 + i % 4))}") for i in range(60)]  # a passage of many documents
    for hot, most in ((64, 1_000_000), (3, 1_000_000), (2, 5)):
        got = rows_of(G.similar_documents(docs_of(docs).repartition(3), 3, 0.5, share=400, hot=hot, most=most))
        assert got == linked_of(brute(docs, 3, 0.5)), (hot, most)


def variants(made_words, seed, n, length=40):
    """Texts that are a passage with some words changed, most of them similar to most others."""
    r = random.Random(seed)
    base = made_words(seed, length)
    out = []
    for _ in range(n):
        w = list(base[: r.randint(length // 2, length)])
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"other{r.randrange(40)}"
        out.append(" ".join(w))
    return out


def test_heavy_grams_lose_no_link(docs_of, made_words, monkeypatch):
    texts = [x for seed, n in ((21, 50), (22, 30), (23, 4)) for x in variants(made_words, seed, n)]
    docs = list(enumerate([*texts, *texts[:5], " ".join(made_words(21, 10) + made_words(22, 10))])) + [(1000 + i, x) for i, x in corpus(made_words, 5, 60)]
    expected = linked_of(brute(docs, 3, 0.4))
    assert pairs_of(docs_of(docs), 3) == brute(docs, 3, 0.4)
    for heavy, rows in ((2, 4096), (8, 4096), (8, 7), (20, 20)):
        monkeypatch.setattr(G, "DENSE_ROWS", rows)
        assert rows_of(G.similar_documents(docs_of(docs).repartition(3), 3, 0.4, hot=6, heavy=heavy)) == expected, (heavy, rows)
    monkeypatch.setattr(G, "HEAVY", 8)
    found = L.settled(G.classes(docs_of(docs), 3, 0.4, heavy=8))
    pairs, _ = G.similar_classes(found, 0.4, True, heavy=8)
    ids = {}
    for r in found.filter("doc_id is not null").collect():
        ids.setdefault(r["class"], set()).add(r.doc_id)
    got = [(r.class_a, r.class_b) for r in pairs.collect()]
    assert len(set(got)) == len(got) and all(a < b for a, b in got)
    both = {(min(x, y), max(x, y)) for a, b in got for x in ids[a] for y in ids[b]} | {p for own in ids.values() for p in combinations(sorted(own), 2)}
    assert both == brute(docs, 3, 0.4)


def test_variants_of_a_text_cost_no_row_a_pair(docs_of, made_words):
    """A text of many variants: candidate pairs that are written grew with their square."""
    docs = list(enumerate(variants(made_words, 31, 500)))
    found = L.settled(G.classes(docs_of(docs)))
    verified, wanted = G.similar_classes(found, G.THRESHOLD, False)
    members = found.filter("doc_id is not null").selectExpr("doc_id AS id", "class")
    assert {tuple(r) for r in L.linked(members, verified).collect()} == linked_of(brute(docs, G.N, G.THRESHOLD))
    written = wanted.filter("pairs is not null").agg(F.sum(F.octet_length("pairs"))).first()[0] or 0
    wanted.unpersist()
    assert written // 16 < 10 * len(docs)


def peak_mb(run, *args):
    tracemalloc.start()
    try:
        run(*args)
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_many_candidates():
    """What the filters of step 4 hold doesn't follow the number of pairs."""
    n = 2500
    row = {"bucket": 0, "part": 0, "whole": True, "dense": None, "classes": G._pack(np.arange(n), "<i8"), "sizes": G._pack(np.full(n, 20), "<i4"), "places": bytes(4 * n), "spread": bytes([20] * n * G.FANOUT), "counts": G._pack(np.ones(n), "<u4"), "grams": bytes(6 * n)}
    group = pa.Table.from_pylist([row])
    assert peak_mb(G._candidates(4, L.block_keys(4)[0], 0.4), group) < 350


def test_memory_of_entries():
    """The result takes 16 bytes an entry; parts are not held beside it."""
    n = 100_000
    parts = [[G._pack(np.arange(n), "<i8")] * 20, [G._counts(np.ones(n, np.int64))] * 20, [bytes(6 * n)] * 20]
    assert peak_mb(G._entries, *parts) < 1.3 * 16 * 20 * n / 1e6


def test_overlaps(monkeypatch):
    r = np.random.default_rng(5)
    monkeypatch.setattr(G, "AT_ONCE", 200)
    for kinds, rows, wide in ((60, 30, 40), (5000, 50, 20), (3, 1, 1)):
        a, b = ([np.unique(np.concatenate((r.integers(0, kinds, r.integers(1, 50)), r.integers(0, 9, 4)))).astype(np.uint64) for _ in range(n)] for n in (rows, wide))
        got = np.concatenate([m for _, m in G.overlaps(a, b)])
        assert (got == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_several_texts_of_one_id_join_their_groups(docs_of, made_words):
    a, b = (" ".join(made_words(k, 30)) for k in (1, 2))
    docs = docs_of([(1, a), (2, a), (2, b), (3, b), (4, "quite another text of its own")])
    assert rows_of(G.similar_documents(docs)) == {(1, 1, 1), (2, 1, 2), (3, 1, 1)}
    assert sorted(r.doc_id for r in G.drop_similar(docs).collect()) == [1, 4]


def test_clashing_names(docs_of):
    docs = docs_of([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x")]).selectExpr("doc_id AS DOC_ID", "'mine' AS surplus_id", "text AS Text", "'other' AS Surplus_Id_", "1 AS class")
    left = G.drop_similar(docs)
    assert left.columns == docs.columns and sorted(tuple(r) for r in left.collect()) == [(1, "mine", "a b c d e f g", "other", 1), (3, "mine", "x", "other", 1)]


def test_group_keeps_one_document(docs_of, made_words):
    docs = corpus(made_words, 4)
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(docs, 5, 0.4):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    kept = {r.doc_id for r in G.drop_similar(docs_of(docs)).collect()}
    assert kept == {root(i) for i, _ in docs}


def test_many_copies_and_awkward_rows(docs_of):
    text = "one two three four five six seven eight nine ten"
    docs = docs_of([(i, text) for i in range(300)] + [(None, text), (900, None), (901, ""), (902, "..."), (903, "short"), (904, "short"), (1, text)], extra=True)
    assert len(pairs_of(docs)) == 300 * 299 // 2 + 1
    assert rows_of(G.similar_documents(docs)) == {(i, 0, 299) for i in range(300)} | {(903, 903, 1), (904, 903, 1)}
    left = G.drop_similar(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 900, 901, 902, 903] and ids.count(None) == 1


def test_empty_table(docs_of):
    assert G.similar_documents(docs_of([])).count() == 0
    assert G.drop_similar(docs_of([])).count() == 0


def test_long_text(docs_of, made_words):
    long = " ".join(made_words(7, 50_000))
    docs = docs_of([(1, long), (2, long + " and a little more"), (3, " ".join(made_words(8, 3000)))])
    assert pairs_of(docs) == {(1, 2)}


def test_pairs_within_in_slices(monkeypatch):
    monkeypatch.setattr(L, "AT_ONCE", 100)
    starts, sizes = np.array([0, 3, 200]), np.array([3, 1, 90])
    got = {(int(a), int(b)) for x, y in L.pairs_within(starts, sizes) for a, b in zip(x, y)}
    assert got == set(combinations(range(3), 2)) | set(combinations(range(200, 290), 2))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (200, 201), (201, 202)], "a long, b long").repartition(4)
    for few in (0, 3, L.FEW_EDGES):
        got = {(r.u, r.v) for r in L.components(edges, few).collect()}
        assert got == {(i, 0) for i in range(1, 51)} | {(101, 100), (201, 200), (202, 200)}


def test_each_group_has_its_own_partition(spark):
    for n in (1, 8, 33, 500):
        keys = L.own_partitions(n)
        df = spark.createDataFrame([(int(k),) for k in keys], "k int").repartition(n, "k")
        assert sorted(df.selectExpr("spark_partition_id() AS p").toPandas().p) == list(range(n))


def test_block_pairs_are_spread_evenly(spark):
    for blocks in (1, 4, 9, 40):
        keys, parted = L.block_keys(blocks)
        a, b = np.meshgrid(np.arange(blocks), np.arange(blocks))
        got = L.block_of(a.ravel(), b.ravel(), blocks, keys).reshape(blocks, blocks)
        assert (got == got.T).all() and len(np.unique(got)) == len(keys) == blocks * (blocks + 1) // 2
        df = spark.createDataFrame([(int(k),) for k in keys], "k int").repartition(parted, "k")
        sizes = df.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert len(sizes) == parted and sizes.max() - sizes.min() <= 1
