"""Quality by positive-unlabelled learning: non-negative unbiased risk with an estimated class prior.

Trusted positives are labelled rows, unlabelled ones are web texts of unknown quality.  Features are shares of byte
classes, of repeated words and lines, and extremes of these over windows, all of the whole text.  A first network tells
positives from unlabelled texts; on a part kept apart, the best bin of its scores (the one with the smallest upper bound
on the ratio of unlabelled to positive rows above a score) gives the class prior.  A second network then minimises the
non-negative unbiased risk: a batch whose estimated risk of negatives is below zero is pushed back instead.

At most POSITIVES and UNLABELLED ids, those with the smallest hash of doc_id, are gathered for the fit, whatever the corpus,
with one row of features each (of rows that repeat an id, the smallest); every row is scored.

Defined cases: null and empty texts have the features of an empty text and get a score; a null doc_id is not held out
(crc32 of null is null) and serves no fit; repeated rows get the same score; with fewer than LEAST positives or unlabelled rows
every text scores the prior 0.5; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, documents, table

POSITIVES, UNLABELLED, LEAST = 6_000, 12_000, 20
HIDDEN, EPOCHS, BATCH, RATE = 24, 40, 512, 3e-3
#: Bytes of a window over which extremes are taken.
WINDOW = 512

_CLASS = np.full(256, 11, dtype=np.uint8)
for _n, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\v\f", b".,;:'-", b"!?", b"|", b"#*%$&@^~=+<>_\\/`", b"\"()[]{}")):
    _CLASS[list(_bytes)] = _n
_CLASS[[*range(9), *range(14, 32), 127]] = 10
_CLASSES = 12
_WATCHED = (1, 2, 5, 6, 7, 8)


def features(text: str | None) -> np.ndarray:
    """A fixed number of finite features of a whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = max(1, raw.size)
    kinds = _CLASS[raw]
    share = np.bincount(kinds, minlength=_CLASSES) / n
    extremes = []
    if raw.size:
        size = min(WINDOW, raw.size)
        whole, last = kinds[: raw.size - raw.size % size].reshape(-1, size), kinds[-size:]  # the last one ends with the text
        for k in _WATCHED:
            per = np.append((whole == k).sum(axis=1), (last == k).sum()) / size
            extremes += [per.max(), per.mean() - per.min()]
    else:
        extremes = [0.0] * (2 * len(_WATCHED))
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    twice = sum(map(eq, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    upper = sum(map(str.isupper, words))
    plain = sum(map(str.isalpha, words))
    lengths = Counter(map(len, words))
    mean = sum(a * b for a, b in lengths.items()) / m
    spread = math.sqrt(sum(b * (a - mean) ** 2 for a, b in lengths.items()) / m)
    expected = min(1.0, 8 * m**-0.35) if m > 1 else 1.0
    rest = [math.log1p(raw.size), math.log1p(m), math.log1p(k), mean, spread, len(counts) / m, len(counts) / m - expected, top / m, twice / m, math.log1p(twice), 1 - len(set(lines)) / k, math.log1p(m / k), upper / m, plain / m, max(lengths, default=0) ** 0.5, share[1] / (share[0] + share[1] + 1e-9)]
    return np.concatenate((share, np.sqrt(share), extremes, rest))


WIDTH = features("").size


def in_fold(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


class Net:
    """One hidden layer, tanh; f(x) > 0 says positive."""

    def __init__(self, width: int, seed: int):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def step(self, x: np.ndarray, slope: np.ndarray) -> None:
        """An Adam step down the loss whose slope in f at each row of x is given."""
        h = np.tanh(x @ self.p[0] + self.p[1])
        back = slope[:, None] * self.p[2] * (1 - h * h)
        self.t += 1
        for k, g in enumerate((x.T @ back, back.sum(0), h.T @ slope, slope.sum(keepdims=True))):
            g = g + 1e-4 * self.p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] -= RATE * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _train(p: np.ndarray, u: np.ndarray, prior: float | None, seed: int) -> Net:
    """With a prior: non-negative unbiased risk, logistic loss. Without: positives against unlabelled rows, equally weighted."""
    net, rng = Net(p.shape[1], seed), np.random.default_rng(seed)
    steps = max(1, EPOCHS * max(len(p), len(u)) // BATCH)
    for _ in range(min(steps, 2000)):
        a, b = p[rng.integers(0, len(p), BATCH // 2)], u[rng.integers(0, len(u), BATCH // 2)]
        fa, fb = net(a), net(b)
        n = len(a)
        if prior is None:
            slope_a, slope_b = (_sigmoid(fa) - 1) / n, _sigmoid(fb) / n
        else:
            negatives = np.logaddexp(0, fb).mean() - prior * np.logaddexp(0, fa).mean()
            slope_b = _sigmoid(fb) / n
            if negatives >= 0:
                slope_a = prior * (_sigmoid(fa) - 1) / n - prior * _sigmoid(fa) / n
            else:  # push the estimated risk of negatives back up
                slope_a, slope_b = prior * _sigmoid(fa) / n, -slope_b
        net.step(np.vstack((a, b)), np.concatenate((slope_a, slope_b)))
    return net


def class_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among unlabelled scores u, from scores p of positives, by the best bin."""
    cuts = np.unique(np.concatenate((p, u)))
    over_p, over_u = (1 - np.searchsorted(np.sort(x), cuts, side="left") / len(x) for x in (p, u))
    ok = over_p > 0
    slack = math.sqrt(math.log(4 / delta) / 2 / len(u)) + math.sqrt(math.log(4 / delta) / 2 / len(p))
    bound = over_u[ok] / over_p[ok] + (1 + gamma) / over_p[ok] * slack
    at = int(np.argmin(bound))
    return float(np.clip(over_u[ok][at] / over_p[ok][at], 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 7) -> dict | None:
    """Weights, scaling and the estimated prior from feature rows."""
    if len(positive) < LEAST or len(unlabelled) < LEAST:
        return None
    both = np.vstack((positive, unlabelled))
    mean, scale = both.mean(0), both.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    first = _train(p[::2], u[::2], None, seed)
    prior = class_prior(first(p[1::2]), first(u[1::2]))
    return {"mean": mean, "scale": scale, "prior": prior, "nets": [_train(p, u, prior, seed + k).p for k in range(3)]}


def probability(model: dict | None, rows: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(rows), 0.5)
    x = np.clip((rows - model["mean"]) / model["scale"], -6, 6)
    total = sum(np.tanh(x @ p[0] + p[1]) @ p[2] + p[3] for p in model["nets"])
    return np.round(_sigmoid(total / len(model["nets"])), 9)  # a row's last bits depend on the batch it is in


FEATURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("positive", T.BooleanType()), T.StructField("x", T.BinaryType())])


def fit_documents(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A model from rows that are not held out: documents with label 1, and documents whatever their label."""
    usable = docs.where(F.col("doc_id").isNotNull() & ~in_fold("doc_id")).select("doc_id", "text")
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~in_fold("doc_id")).distinct()
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES)
    others = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(UNLABELLED)
    picked = chosen.withColumn("positive", F.lit(True)).unionByName(others.withColumn("positive", F.lit(False)))
    sample = usable.join(F.broadcast(picked), "doc_id")  # POSITIVES + UNLABELLED ids at most, so texts stay where they are

    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "positive": rows["positive"], "x": [features(t).tobytes() for t in rows["text"]]}

    # one row of features for each chosen id, however often it occurs, so the bound holds for what the driver gathers
    got = arrow_map(sample.select("doc_id", "positive", "text"), make, FEATURES).groupBy("doc_id", "positive").agg(F.min("x").alias("x")).collect()
    arrays = [np.frombuffer(b"".join(sorted(bytes(r["x"]) for r in got if r["positive"] == side))).reshape(-1, WIDTH) for side in (True, False)]
    order = [np.random.default_rng(5).permutation(len(a)) for a in arrays]  # sorted, then dealt: the same rows give the same model
    return fit(*(a[o] for a, o in zip(arrays, order, strict=True)))


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def score_documents(docs: DataFrame, model: dict | None) -> DataFrame:
    def make():
        return lambda rows: {"doc_id": rows["doc_id"], "score": probability(model, np.array([features(t) for t in rows["text"]]))}

    return arrow_map(docs.select("doc_id", "text"), make, SCORED)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier predicts as good."""
    model = fit_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)

    def good(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                kept = probability(model, np.array([features(t) for t in batch.column("text").to_pylist()])) >= 0.5
                yield batch.filter(pa.array(kept))

    from .common import small_batches

    small_batches(docs.sparkSession)
    return docs.mapInArrow(good, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_documents(docs, fit_documents(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(in_fold("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
