"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its byte n-grams (with word boundaries); every n-gram has an embedding in a
hashed table. A window of words is the average of its n-gram embeddings, fed to a linear softmax;
a document is as toxic as its most toxic window. Embeddings and softmax are trained jointly in
numpy: first on whole-document averages, then on the windows that decide each document. A
misspelled word shares most n-grams with the word it stands for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import give_back, written

#: n-gram lengths in bytes, word boundaries included.
LENGTHS = (3, 4, 5, 6)
BUCKETS, DIMENSION = 1 << 18, 4
#: Words of a window.
WINDOW = 2
#: Share of the loss that toxic documents have.
POS = 0.3
#: n-grams of fewer training documents are not trained.
MIN_DOCUMENTS = 5
#: Bounds on what training reads: labelled documents of each label, by hash, and bytes of a document
#: (a longer one is not trained on, but scored like any other).
TRAIN_ROWS_PER_LABEL, TRAIN_BYTES = 1500, 100_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that end a word besides white space: ASCII punctuation.
_STOP = _SPACE.copy()
_STOP[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "*@$"]] = True


def subwords(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """(n-gram buckets, word number of each, words) of a text."""
    t = _LOWER[np.frombuffer(b" " + text + b" ", np.uint8)]
    stop = _STOP[t]
    t = np.where(stop, np.uint8(32), t)
    starts = stop[:-1] & ~stop[1:]
    n = int(starts.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    # Word of each position; the stop before a word belongs to it as its boundary.
    word = np.concatenate([np.cumsum(starts), [n]]) - 1
    v = t.astype(np.uint64)
    prefix = np.concatenate([[0], np.cumsum(stop)])
    keys, words = [], []
    for length in LENGTHS:
        m = len(t) - length + 1
        if m <= 0:
            continue
        h = np.full(m, length, np.uint64)
        for j in range(length):
            h = h * np.uint64(0x100000001B3) + v[j : j + m]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        # Inside the n-gram no stop: only its first or last byte may be a boundary.
        inner = prefix[length - 1 : length - 1 + m] - prefix[1 : 1 + m]
        ok = inner == 0
        keys.append((h[ok] >> np.uint64(46)).astype(np.int64))
        words.append(word[:m][ok] + (stop[:m][ok] & ~starts[:m][ok]))
    return np.concatenate(keys), np.concatenate(words), n


def _windows(n: int) -> int:
    return max(1, n - WINDOW + 1)


def window_means(values: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Mean of values over the n-grams of each window of WINDOW words (or of all, if fewer)."""
    w = _windows(n)
    s = np.concatenate([[0.0], np.cumsum(np.bincount(word, values, n))])
    c = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))])
    width = min(WINDOW, n)
    a, b = np.arange(w), np.arange(w) + width
    return (s[b] - s[a]) / np.maximum(c[b] - c[a], 1)


@dataclass
class ToxicityModel:
    """Embeddings V, softmax weights U and bias; score(text) is in 0..1."""

    v: np.ndarray
    u: np.ndarray
    bias: np.ndarray

    def weights(self) -> tuple[np.ndarray, float]:
        """Each bucket's share in the log odds, and their offset."""
        return (self.v @ (self.u[1] - self.u[0])).astype(np.float64), float(self.bias[1] - self.bias[0])

    def linear(self) -> Linear:
        return Linear(*self.weights())

    def score(self, text: bytes) -> float:
        return self.linear().score(text)


@dataclass
class Linear:
    """What scoring needs of a model: as the softmax has two classes, one number per bucket."""

    weight: np.ndarray
    bias: float

    def linear(self) -> Linear:
        return self

    def score(self, text: bytes) -> float:
        key, word, n = subwords(text)
        top = self.bias + (window_means(self.weight[key], word, n).max() if n and len(key) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(top, -30, 30))))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 0, dimension: int = DIMENSION, first: int = 4, then: int = 8, rate: float = 0.3) -> ToxicityModel:
    """Adagrad on the mean log loss, labels balanced; no label or one label gives a constant score."""
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.05, (BUCKETS, dimension)).astype(np.float32)
    u = rng.normal(0, 0.5, (2, dimension)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        bias[:] = [0.0, 4.0] if len(labels) and labels[0] else [0.0, -4.0]
        return ToxicityModel(v * 0, u, bias)
    docs = [(k.astype(np.int32), w.astype(np.int32), n) for k, w, n in map(subwords, texts)]
    # n-grams of a few documents would only memorise them: they keep a zero embedding.
    seen_in = np.zeros(BUCKETS, np.int64)
    for key, _, _ in docs:
        seen_in[np.unique(key)] += 1
    v[seen_in < MIN_DOCUMENTS] = 0
    frozen = seen_in < MIN_DOCUMENTS
    share = {c: x / (labels == c).sum() for c, x in ((0, 1 - POS), (1, POS))}
    gv, gu, gb = np.full(BUCKETS, 1e-6, np.float32), np.full((2, dimension), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    for epoch in range(first + then):
        weight = (v @ (u[1] - u[0])).astype(np.float64)
        bags: list[tuple[np.ndarray, int, float]] = []
        for (key, word, n), label in zip(docs, labels, strict=True):
            if not n or not len(key):
                continue
            if epoch < first:
                bags.append((np.unique(key), label, share[label]))
                continue
            means = window_means(weight[key], word, n)
            # The deciding window of a toxic document, the four most suspect ones of a clean one.
            k = 1 if label else min(4, len(means))
            for at in np.argpartition(-means, k - 1)[:k]:
                bags.append((key[(word >= at) & (word < at + WINDOW)], label, share[label] / k))
        rng.shuffle(bags)
        size = 64
        for begin in range(0, len(bags), size):
            part = bags[begin : begin + size]
            length = np.array([max(len(b[0]), 1) for b in part])
            keys = np.concatenate([b[0] for b in part])
            y = np.array([b[1] for b in part])
            w = np.array([b[2] for b in part])
            w = w / w.mean()
            owner = np.repeat(np.arange(len(part)), [len(b[0]) for b in part])
            x = np.zeros((len(part), dimension), np.float32)
            for d in range(dimension):
                x[:, d] = np.bincount(owner, v[keys, d], len(part)) / length
            z = x @ u.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p.copy()
            g[np.arange(len(part)), y] -= 1
            g = (g * w[:, None] / len(part)).astype(np.float32)
            du, dx, db = g.T @ x, (g @ u) / length[:, None], g.sum(0)
            seen, inverse = np.unique(keys, return_inverse=True)
            dv = np.stack([np.bincount(inverse, dx[owner, d], len(seen)) for d in range(dimension)], 1).astype(np.float32)
            gv[seen] += (dv**2).mean(1)
            gu += du**2
            gb += db**2
            dv[frozen[seen]] = 0
            v[seen] -= rate * dv / np.sqrt(gv[seen])[:, None]
            u -= 0.1 * rate * du / np.sqrt(gu)
            bias -= 0.1 * rate * db / np.sqrt(gb)
    return ToxicityModel(v, u, bias)


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_ROWS_PER_LABEL) -> DataFrame:
    """(text, toxic) of at most about per_label documents of each label, chosen by a hash of doc_id.

    Labels are counted first and a hash threshold is set from the counts, so there is no sort and no
    group is gathered. Documents over TRAIN_BYTES are left out. Repeated labels of a doc_id count once each; null labels are left out.
    """
    lab = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and __id is not null")
    counts = {r["toxic"]: r["count"] for r in lab.groupBy("toxic").count().collect()}
    spread = 1 << 20
    limit = {c: min(spread, -(-per_label * spread // max(n, 1))) for c, n in counts.items()}
    draw = F.pmod(F.xxhash64(F.lit("train"), "__id"), F.lit(spread))
    chosen = lab.where(F.when(F.col("toxic") == 1, draw < limit.get(1, 0)).otherwise(draw < limit.get(0, 0)))
    text = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.octet_length("text") <= TRAIN_BYTES)
    return text.join(F.broadcast(chosen), text["doc_id"] == chosen["__id"]).select("doc_id", "text", "toxic")


def _trained(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")], strict=True)]
        rows.sort()
        linear = train([t for _, t, _ in rows], np.array([y for *_, y in rows], np.int64), seed).linear()
        rows.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([linear.weight.astype("<f8").tobytes()], pa.binary()), pa.array([linear.bias])], names=["weight", "bias"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_ROWS_PER_LABEL, seed: int = 0) -> Linear:
    """Trains on the bounded sample of training_rows. Pass only rows that may be learned from.

    The sample is written to the shared folder and trained on by one task; the driver gets only the
    log odds of the buckets (2 MB). Without a label, or with one only, every score is the same.
    """
    sample = written(training_rows(docs, labels, per_label), "toxicity-sample", "parquet")
    found = sample.coalesce(1).mapInArrow(_trained(seed), "weight binary, bias double").first()
    if found is None:
        return train([], np.zeros(0, np.int64), seed).linear()
    return Linear(np.frombuffer(bytes(found["weight"]), "<f8"), found["bias"])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            s = [model.score(t or b"") for t in batch.column("__t").to_pylist()]
            names = [c for c in batch.schema.names if c != "__t"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(s, pa.float64())], names=[*names, "score"])
        give_back()

    return run


def toxicity(docs: DataFrame, model: ToxicityModel | Linear) -> DataFrame:
    """(doc_id, score, predicted) of every whole text; null and empty texts get the bias alone.

    Only the text is read for a score. Repeated rows are scored alike, other columns are ignored, an
    empty table gives no rows. The model's share per bucket (2 MB) is broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.linear())
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("__t"))
    out = d.mapInArrow(_score(sent), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _clean(shared, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            keep = [model.score((t or "").encode()) < 0.5 for t in batch.column(column).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))
        give_back()

    return run


def clean(docs: DataFrame, model: ToxicityModel | Linear) -> DataFrame:
    """docs without those predicted toxic, all columns as they are; judged where they lie, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model.linear())
    return docs.mapInArrow(_clean(sent, docs.columns.index("text")), docs.schema)
