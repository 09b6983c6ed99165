"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features are presence of words, word pairs and pairs with one word between,
each hashed into 2**BITS buckets. FTRL-proximal (McMahan et al., 2013) gives every coordinate
its own rate, and its L1 term leaves few weights other than zero: they are kept
as two short arrays, are checked against MAX_WEIGHTS, and go to the workers as a
broadcast. Features of a single training text get no weight, as they say nothing about others. Training runs on an executor, over a bounded sample of the labelled
rows: those with the smallest hash of their id, at most MAX_ROWS of them and as many as have MAX_CHARS characters
together (documented bounds). Their texts are hashed where they are read, and only the hashes go to the trainer. The
scoring covers every text whole.

Defined results: equal rows train once; a null text scores like an empty one, by the bias alone; rows
with a null doc_id are scored but never trained on; a doc_id with several labels
counts once, as toxic if any says so; several texts under one labelled id all
train. With no label of either class the model has no weights and rejects
nothing. Input columns named toxicity or is_toxic are replaced by the results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import lean, map_arrow, place_of, quoted, with_computed
from .textvec import gram_hashes, slices, word_hashes

BITS = 30
MAX_ROWS, MAX_CHARS, MAX_WEIGHTS = 16_000, 200_000_000, 2_000_000
SKIPS = ((0,), (0, 1), (0, 2))


@dataclass(frozen=True)
class Model:
    """Sorted buckets, their weights, the bias, and the probability from which a text is toxic."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    threshold: float


NOTHING = Model(np.zeros(0, np.int32), np.zeros(0), -10.0, 0.5)


def _kind(words: np.ndarray, k: int) -> np.ndarray:
    """Buckets of the k-th kind of feature at each place of a text."""
    return ((gram_hashes(words, SKIPS[k]) ^ np.uint64(k * 0x5851F42D4C957F2D)) >> np.uint64(64 - BITS)).astype(np.int32)


def features(words: np.ndarray) -> np.ndarray:
    """Bucket of each feature of a text, with repeats."""
    return np.concatenate([_kind(words, k) for k in range(len(SKIPS))])


class Ftrl:
    """FTRL-proximal state over a dense range of coordinates; coordinate 0 is the bias."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at if not isinstance(at, slice) else np.arange(len(z))) == 0, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, y: int) -> None:
        """One step on a text whose distinct coordinates are `at`, each with value 1."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def distinct_features(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct buckets of each text."""
    rows: list[np.ndarray] = []
    for first, last in slices(texts):
        words, at = word_hashes(texts[first:last])
        rows += [np.unique(features(words[at[i] : at[i + 1]])) for i in range(last - first)]
    return rows


def fit(rows: list[np.ndarray], toxic: list[int], epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, held_out: int = 5) -> Model:
    """A model from labelled texts, given by their distinct features; every held_out-th text sets the threshold only."""
    if len(set(toxic)) < 2:
        return NOTHING
    order = np.random.default_rng(7).permutation(len(rows))
    held, used = (order[::held_out], np.setdiff1d(order, order[::held_out], assume_unique=True)) if len(rows) >= 50 else (order, order)
    every = np.concatenate([rows[i] for i in used])
    every.sort()
    buckets = np.unique(every[1:][every[1:] == every[:-1]])  # a feature of one text says nothing about others
    del every
    places = list(rows)
    for i, r in enumerate(rows):
        k = np.searchsorted(buckets, r)
        k[k == len(buckets)] = 0
        places[i] = np.concatenate(([0], k[buckets[k] == r] + 1)).astype(np.int32) if len(buckets) else np.zeros(1, np.int32)
    model = Ftrl(len(buckets) + 1, alpha, beta, l1, l2)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(used):
            model.learn(places[i], toxic[i])
    w = model.weights(slice(None))
    kept = np.flatnonzero(w[1:])
    score = np.array([w[p].sum() for p in places])
    truth = np.asarray(toxic)
    # halfway through the widest gap among the thresholds of the best F1 on held-out texts
    s, y = score[held], truth[held]
    cuts = np.unique(s)
    cuts = np.concatenate((cuts[:1] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1:] + 1))
    f1 = np.array([2 * (y[s > c] == 1).sum() / max(1, (s > c).sum() + y.sum()) for c in cuts])
    widths = np.diff(np.concatenate(([s.min() - 1], np.unique(s), [s.max() + 1])))
    best = cuts[np.argmax(np.where(f1 >= f1.max() - 1e-12, widths, -1.0))]
    return Model(buckets[kept], w[1:][kept], float(w[0]), float(1 / (1 + np.exp(-best))))


def score(model: Model, texts: list[str | None]) -> np.ndarray:
    """Probability of being toxic of each text."""
    out = np.full(len(texts), model.bias)
    quick = np.zeros(1 << 16, bool)
    quick[model.buckets & 0xFFFF] = True
    words, at = word_hashes(texts)
    for k, gaps in enumerate(SKIPS):
        # over the whole batch at once; features that would reach into the next text are left out
        found = _kind(words, k)
        hits = np.flatnonzero(quick[found & 0xFFFF])
        place = np.searchsorted(model.buckets, found[hits])
        place[place == len(model.buckets)] = 0
        same = model.buckets[place] == found[hits] if len(model.buckets) else np.zeros(0, bool)
        hits, place = hits[same], place[same]
        row = np.searchsorted(at, hits, side="right") - 1
        inside = hits + gaps[-1] < at[row + 1]
        pairs = np.unique(row[inside] * (len(model.buckets) + 1) + place[inside])
        np.add.at(out, pairs // (len(model.buckets) + 1), model.weights[pairs % (len(model.buckets) + 1)])
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(3).to_pylist()
        for first, last in slices(texts):
            some = batch.slice(first, last - first)
            made = [f.astype("<u4").tobytes() for f in distinct_features(texts[first:last])]
            yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(made, pa.binary())], names=["doc_id", "place", "toxic", "features"])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = sorted(((i, h, y, f) for b in batches for i, h, y, f in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[:2])
    model = fit([np.frombuffer(f, "<u4").astype(np.int32) for *_, f in got], [y for _, _, y, _ in got])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """Fit on at most max_rows labelled documents of max_chars characters together, in one task of an executor."""
    names = {c.lower(): F.col(quoted(c)) for c in docs.columns}
    texts = docs.select(names["doc_id"].cast("long").alias("doc_id"), F.coalesce(names["text"].cast("string"), F.lit("")).alias("text")).withColumn("place", F.xxhash64("text"))
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # at most max_rows narrow rows: small enough to broadcast
    # an id may have several texts: the bounds are for what is trained on, so narrow rows of all of them are put in order
    found = texts.select("doc_id", "place", F.length("text").alias("n")).join(F.broadcast(sample), "doc_id").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("place")]
    first = found.orderBy(*order).limit(max_rows)
    so_far = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    picked = first.select("doc_id", "place", "toxic", so_far.alias("so_far")).filter(F.col("so_far") <= max_chars).drop("so_far")
    rows = texts.join(F.broadcast(picked), ["doc_id", "place"]).select("doc_id", "place", "toxic", "text")
    hashed = rows.mapInArrow(lean(_hashed), "doc_id bigint, place bigint, toxic int, features binary").dropDuplicates(["doc_id", "place"])
    made = hashed.repartition(1).mapInArrow(lean(_trained), "model binary").first()
    model = pickle.loads(made[0]) if made else NOTHING
    if len(model.weights) > MAX_WEIGHTS:
        raise ValueError(f"{len(model.weights)} weights are too many to broadcast; raise l1")
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxicity (probability) and is_toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[str | None]) -> list[pa.Array]:
        p = score(shared.value, texts)
        return [pa.array(p), pa.array(p > shared.value.threshold)]

    return with_computed(docs, [T.StructField("toxicity", T.DoubleType()), T.StructField("is_toxic", T.BooleanType())], compute)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model rejects, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = place_of("text", docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for first, last in slices(texts):
                yield batch.slice(first, last - first).filter(pa.array(score(shared.value, texts[first:last]) <= shared.value.threshold))

    return map_arrow(docs, run, docs.schema)
