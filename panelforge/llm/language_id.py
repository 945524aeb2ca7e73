"""Language identification by a byte convolutional network in numpy.

Bytes are embedded, convolved with filters of several widths, rectified, max-pooled over a
fixed-length window and fed to a softmax. A text is cut into windows that cover all of it; its
language is the one with the highest mean log probability over the windows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import give_back, written

WIDTHS, FILTERS, EMBEDDING, LENGTH = (2, 3, 4, 5), 12, 8, 128
UNKNOWN = "und"
#: Bounds of the training sample: documents of each language, windows of each document.
TRAIN_DOCS_PER_LANG, TRAIN_WINDOWS_PER_DOC = 400, 6
#: Languages that are learned at most: the most frequent ones, ties by name.
MOST_LANGS = 512


def encoded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def windows(data: bytes) -> np.ndarray:
    """All of data as rows of LENGTH bytes, the last one filled up with zeros."""
    rows = max(1, -(-len(data) // LENGTH))
    return np.frombuffer(data.ljust(rows * LENGTH, b"\0"), np.uint8).reshape(rows, LENGTH)


@dataclass
class ByteNet:
    """The trained network: embedding, one kernel by width (width, embedding, filters), softmax."""

    langs: list[str]
    emb: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    _tables: list = field(default_factory=list)

    def tables(self) -> list[list[np.ndarray]]:
        """Each kernel row applied to every byte once: a convolution is then a sum of look-ups."""
        return [[(self.emb @ k[j]).astype(np.float32) for j in range(len(k))] for k in self.kernels]

    def pooled(self, x: np.ndarray, tables: list[list[np.ndarray]], argmax: bool = False):
        values, places = [], []
        for table, bias in zip(tables, self.biases, strict=True):
            n = LENGTH - len(table) + 1
            conv = table[0][x[:, :n]]
            for j in range(1, len(table)):
                conv += table[j][x[:, j : j + n]]
            if argmax:
                at = conv.argmax(1)
                places.append(at)
                values.append(np.take_along_axis(conv, at[:, None], 1)[:, 0] + bias)
            else:
                values.append(conv.max(1) + bias)
        return np.maximum(np.concatenate(values, 1), 0), places

    def log_probs(self, x: np.ndarray, tables=None) -> np.ndarray:
        if tables is None:
            self._tables = self._tables or self.tables()
            tables = self._tables
        z = self.pooled(x, tables)[0] @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of each text; no letter: und with probability zero."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not lettered or not self.langs:
            return out
        parts = [windows(encoded(texts[i])) for i in lettered]
        sizes = np.array([len(p) for p in parts])
        x = np.concatenate(parts)
        logs = np.concatenate([self.log_probs(x[a : a + 128]) for a in range(0, len(x), 128)])
        first = np.cumsum(sizes) - sizes
        mean = np.add.reduceat(logs, first, axis=0) / sizes[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for i, row in zip(lettered, p, strict=True):
            best = int(row.argmax())
            out[i] = (self.langs[best], float(row[best]))
        return out


def train(texts: list[str], langs: list[str], seed: int = 0, epochs: int = 12, rate: float = 0.004, per_doc: int = TRAIN_WINDOWS_PER_DOC) -> ByteNet:
    """Adam on the log loss of windows at random places of the texts, some of them cut short."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    k = len(names)
    net = ByteNet(
        names,
        rng.normal(0, 0.3, (256, EMBEDDING)),
        [rng.normal(0, 0.3, (w, EMBEDDING, FILTERS)) for w in WIDTHS],
        [np.zeros(FILTERS) for _ in WIDTHS],
        rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, max(k, 1))),
        np.zeros(max(k, 1)),
    )
    rows, target = [], []
    for text, lang in zip(texts, langs, strict=True):
        data = encoded(text)
        for _ in range(min(per_doc, 1 + len(data) // LENGTH)):
            at = int(rng.integers(0, max(1, len(data) - LENGTH + 1)))
            size = LENGTH if rng.random() < 0.7 else int(rng.integers(8, LENGTH + 1))
            rows.append(windows(data[at : at + size])[0])
            target.append(names.index(lang))
    if k < 2 or not rows:
        return net
    x, y = np.array(rows), np.array(target)
    weight = (len(y) / (k * np.maximum(np.bincount(y, minlength=k), 1)))[y]
    params = [net.emb, *net.kernels, *net.biases, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, size = 0, 64
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), size):
            pick = order[a : a + size]
            xb, yb = x[pick], y[pick]
            h, places = net.pooled(xb, net.tables(), argmax=True)
            z = h @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p *= weight[pick][:, None] / len(yb)
            d_out, d_bias = h.T @ p, p.sum(0)
            dh = (p @ net.out.T) * (h > 0)
            d_emb, d_kernels, d_biases = np.zeros_like(net.emb), [], []
            for i, (kernel, at) in enumerate(zip(net.kernels, places, strict=True)):
                g = dh[:, i * FILTERS : (i + 1) * FILTERS]
                d_biases.append(g.sum(0))
                dk = np.zeros_like(kernel)
                for j in range(len(kernel)):
                    byte = np.take_along_axis(xb, at + j, 1)
                    dk[j] = np.einsum("nf,nfd->df", g, net.emb[byte])
                    flow = g[:, :, None] * kernel[j].T[None]
                    for d in range(EMBEDDING):
                        d_emb[:, d] += np.bincount(byte.ravel(), flow[:, :, d].ravel(), 256)
                d_kernels.append(dk)
            step += 1
            for q, d, (m, v) in zip(params, [d_emb, *d_kernels, *d_biases, d_out, d_bias], moments, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def training_rows(docs: DataFrame, per_lang: int = TRAIN_DOCS_PER_LANG, most_langs: int = MOST_LANGS) -> DataFrame:
    """(doc_id, text, lang) of about per_lang documents of each of the most_langs most frequent languages,
    by a hash of doc_id. Languages are counted over all documents first."""
    d = docs.where("text is not null and lang is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    spread = 1 << 20
    counts = d.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs)
    shares = counts.select(F.col("lang").alias("__lang"), F.least(F.lit(spread), F.ceil(F.lit(per_lang * spread) / F.col("count"))).alias("__share"))
    chosen = d.join(F.broadcast(shares), F.col("lang") == F.col("__lang"))
    return chosen.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(spread)) < F.col("__share")).select("doc_id", "text", "lang")


def _trained(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for b in batches for row in b.to_pylist()]
        if rows:
            rows.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["pieces"]))
            net = train([t for r in rows for t in r["pieces"]], [r["lang"] for r in rows for _ in r["pieces"]], seed, per_doc=2)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])
        give_back()

    return run


def fit(docs: DataFrame, per_lang: int = TRAIN_DOCS_PER_LANG, seed: int = 0) -> ByteNet:
    """Trains on the bounded sample of training_rows. Pass only rows that may be learned from.

    The sample (windows of long documents, not their texts) is written to the shared folder and trained
    on by one task; the driver gets the network alone. Rows with null text or null lang teach nothing.
    Without two languages the net is untrained and names the only one, or und if there is none.
    """
    cut = F.substring
    rows = training_rows(docs, per_lang)
    n = F.octet_length("text")
    pieces = F.array(*[cut("text", F.pmod(F.xxhash64(F.lit(i), "doc_id"), F.greatest(F.length("text") - LENGTH, F.lit(1))).cast("int") + 1, F.lit(LENGTH)) for i in range(TRAIN_WINDOWS_PER_DOC)])
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.when(n <= 4 * LENGTH, F.array("text")).otherwise(pieces).alias("pieces"))
    found = written(rows, "language-sample").coalesce(1).mapInArrow(_trained(seed), "net binary").first()
    return pickle.loads(bytes(found["net"])) if found else train([], [], seed)


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part = batch.slice(at, 32)
                found = net.predict(part.column("__t").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: ByteNet) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text.

    Null texts and texts without a letter (a code point that Unicode calls one) are und with score 0. Only the text is read; repeated rows
    are predicted alike, a null doc_id is carried along, an empty table gives no rows. The net (some
    kilobytes) is broadcast; there is no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("__t"))
    return d.mapInArrow(_predict(sent), "doc_id long, lang_pred string, score double")
