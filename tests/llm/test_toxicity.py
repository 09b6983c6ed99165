import random

import numpy as np

from millrace.llm import toxicity as X


def labelled(made_words, n=600):
    r = random.Random(2)
    plain, bad = made_words(1, 300), made_words(99, 8)
    rows = []
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.randint(20, 80))]
        y = int(r.random() < 0.3)
        if y:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), y))
    return rows


def test_held_out_accuracy(spark, docs_of, made_words):
    rows = labelled(made_words)
    docs = docs_of([(i, t) for i, t, _ in rows], extra=True)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows[:400]], "doc_id long, quality int, toxic int")
    model = X.train(docs, labels)
    assert 0 < len(model.weights) < 2000
    out = {r.doc_id: r for r in X.score_documents(docs, model).collect()}
    right = sum(out[i].is_toxic == bool(y) for i, _, y in rows[400:])
    assert right >= 0.97 * 200
    kept = {r.doc_id for r in X.drop_toxic(docs, model).collect()}
    assert kept == {i for i in out if not out[i].is_toxic}
    assert X.drop_toxic(docs, model).columns == docs.columns


def test_one_step_follows_the_update_rule():
    m = X.Ftrl(3, 1.0, 1.0, 0.5, 0.1)
    at = np.array([0, 2])
    m.learn(at, 1)
    assert np.allclose(m.z, [-0.5, 0, -0.5]) and np.allclose(m.n, [0.25, 0, 0.25])
    w = m.weights(at)
    assert np.isclose(w[0], 0.5 / (1.5 + 0.1)) and w[1] == 0  # L1 holds back the feature, not the bias


def test_score_equals_plain_sum(made_words):
    rows = labelled(made_words, 200)
    model = X.fit(X.distinct_features([t for _, t, _ in rows]), [y for *_, y in rows])
    texts = [t for _, t, _ in rows[:50]] + ["", None, "one", "two words"]
    table = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    want = []
    for t in texts:
        words, _ = X.word_hashes([t])
        s = model.bias + sum(table.get(int(b), 0.0) for b in np.unique(X.features(words)))
        want.append(1 / (1 + np.exp(-s)))
    assert np.allclose(X.score(model, texts), want)


def plain_training(texts, toxic, epochs=6, alpha=1.0, beta=1.0, l1=8.0, l2=0.1):
    """FTRL-proximal over strings, one coordinate at a time; the order of the texts is the module's."""
    rows = []
    for t in texts:
        w = t.lower().split()
        rows.append({("", x) for x in w} | {("2", *p) for p in zip(w, w[1:])} | {("skip", *p) for p in zip(w, w[2:])})
    order = np.random.default_rng(7).permutation(len(rows))
    held = set(order[::5].tolist()) if len(rows) >= 50 else set()
    used = [i for i in order.tolist() if i not in held]
    seen = {}
    for i in used:
        for f in rows[i]:
            seen[f] = seen.get(f, 0) + 1
    kept = [sorted(f for f in r if seen.get(f, 0) > 1) for r in rows]
    z, n = {}, {}

    def weight(f):
        a, b = z.get(f, 0.0), n.get(f, 0.0)
        least = 0.0 if f == "bias" else l1
        return 0.0 if abs(a) <= least else ((least if a > 0 else -least) - a) / ((beta + b**0.5) / alpha + l2)

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(np.array(used)).tolist():
            at = ["bias", *kept[i]]
            w = {f: weight(f) for f in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - toxic[i]
            for f in at:
                b = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - ((b + g * g) ** 0.5 - b**0.5) / alpha * w[f]
                n[f] = b + g * g
    return [1 / (1 + np.exp(-sum(weight(f) for f in ["bias", *k]))) for k in kept], sum(weight(f) != 0 for f in z if f != "bias")


def test_training_equals_a_plain_one(made_words):
    rows = labelled(made_words, 150)
    texts, toxic = [t for _, t, _ in rows], [y for *_, y in rows]
    model = X.fit(X.distinct_features(texts), toxic)
    want, weights = plain_training(texts, toxic)
    assert np.allclose(X.score(model, texts), want) and len(model.weights) == weights > 0


def test_bounds_of_the_sample(spark, docs_of, made_words):
    rows = labelled(made_words, 120)
    docs = docs_of([(i, t) for i, t, _ in rows] * 2)  # repeated rows train once
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    whole = X.train(docs, labels)
    assert np.array_equal(whole.buckets, X.train(docs_of([(i, t) for i, t, _ in rows]), labels).buckets)
    few = X.train(docs, labels, max_chars=6000)
    assert len(few.weights) < len(whole.weights)
    assert X.train(docs, labels, max_chars=10) is not None and len(X.train(docs, labels, max_chars=10).weights) == 0
    assert X.train(docs.selectExpr("doc_id AS DOC_ID", "text AS Text"), labels).bias == whole.bias


def test_awkward_tables(spark, docs_of):
    docs = docs_of([(1, None), (None, ""), (2, "x")])
    for rows in ([], [(1, 1, 1)], [(None, 1, 1), (2, 0, None)]):
        model = X.train(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        assert X.drop_toxic(docs, model).count() == 3
    assert X.score_documents(docs_of([]), X.NOTHING).count() == 0
    assert X.score_documents(docs, X.NOTHING).filter("is_toxic").count() == 0
