"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model counts byte n-grams: a byte and the four before it. Case, symbols, table bars and words said
over and over tell junk in them, and the tables stay small beside the text, which word n-grams of this
text would not. Counts are summed over all trusted documents but a held-out fifth, every order's
probabilities come from joins of count tables sharded by n-gram, and batches of documents ask the
shards for the n-grams they hold. Perplexities are thresholded by a quantile of the held-out trusted
documents of the same language and length class, as short texts spread more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import blocks_for, few, give_back, written
from panelforge.llm.packing import docs_of, pack, pack_docs, pack_sorted, unpack, unpack_sorted

ORDER = 5
#: Bytes of text in a batch of documents, n-grams of a shard of the model, and batches that ask one
#: copy of a shard: more batches are answered by more copies.
BATCH_BYTES, SHARD_GRAMS, BATCHES_PER_COPY = 32_000_000, 250_000, 16
#: Trusted documents with this remainder of crc32(doc_id) by FOLDS are held out of the counts.
FOLDS, HELD_OUT = 5, 0
QUANTILE = 0.985
#: Length classes begin at these numbers of bytes; a class of fewer held-out documents takes the
#: threshold of its length over all languages.
LENGTHS, MIN_CLASS = (150, 300, 600), 30
UNKNOWN = "und"
_PAD = b"\n" * (ORDER - 1)
_UNIFORM = 1.0 / 256
_BLOCK = 1_000_000


def grams(data: bytes) -> np.ndarray:
    """The n-gram ending at each byte, as a number of 8 * ORDER bits; line feeds stand before."""
    t = np.frombuffer(_PAD + data, np.uint8).astype(np.int64)
    n, code = len(data), np.zeros(len(data), np.int64)
    for j in range(ORDER):
        code = (code << 8) | t[j : j + n]
    return code


def distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-grams, how often each occurs) of many texts, some at a time."""
    parts, held, size = [], [], 0
    for text in [*texts, None]:
        if text:
            held.append(grams(text))
            size += len(text)
        if held and (text is None or size > _BLOCK):
            parts.append(_runs(np.sort(np.concatenate(held))))
            held, size = [], 0
        if len(parts) > 16 or (text is None and len(parts) > 1):
            parts = [summed(parts)]
    return parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return x[first], np.diff(np.append(first, len(x)))


def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Tables of (n-grams, counts) as one."""
    codes, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(codes, kind="stable")
    codes, n = _runs(codes[order])
    return codes, np.add.reduceat(counts[order], np.cumsum(n) - n) if len(n) else n


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of this task's documents, with their count in those the model learns from."""
    parts = []
    for batch in batches:
        texts, learned = batch.column("__t").to_pylist(), batch.column("__learned").to_pylist()
        parts.append(distinct([t for t, x in zip(texts, learned, strict=True) if x]))
        codes, _ = distinct([t for t, x in zip(texts, learned, strict=True) if not x])
        parts.append((codes, np.zeros(len(codes), np.int64)))
        if len(parts) > 8:
            parts = [summed(parts)]
    if parts:
        codes, counts = summed(parts)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts)], names=["gram", "n"])
    give_back()


def discounts(counts: list[float]) -> tuple[float, float, float]:
    """The three discounts from how many n-grams occur once, twice, three and four times."""
    n1, n2, n3, n4 = (float(c or 0) for c in counts)
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d3 = 3 - 4 * y * n4 / n3 if n3 else 0.5
    return tuple(min(max(d, 0.05), cap) for d, cap in ((1 - 2 * y * n2 / n1, 0.95), (2 - 3 * y * n3 / n2, 1.95), (d3, 2.95)))


def probabilities(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, log_p) for every gram of counted (gram, n): n is its trusted count, 0 if unseen there.

    Orders are built from below: p_k = (c_k - D(c_k) + gamma(context) * p_(k-1)) / c(context), with raw
    counts at the highest order and numbers of distinct left neighbours below; an unseen context
    passes the lower order on. Every step is a join of tables keyed by n-gram.
    """
    mask = lambda k: F.lit((1 << (8 * k)) - 1)
    seen = {order: counted.where("n > 0").select("gram", F.col("n").alias("c"))}
    asked = {order: counted.select("gram")}
    for k in range(order - 1, 0, -1):
        seen[k] = seen[k + 1].groupBy(F.col("gram").bitwiseAND(mask(k)).alias("gram")).agg(F.count("*").alias("c"))
        asked[k] = asked[k + 1].select(F.col("gram").bitwiseAND(mask(k)).alias("gram")).distinct()
    below = None
    for k in range(1, order + 1):
        ones = seen[k].agg(*[F.sum((F.col("c") == i).cast("long")) for i in (1, 2, 3, 4)]).first()
        d1, d2, d3 = discounts(list(ones))
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        context = seen[k].groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("c").alias("total"), F.sum(cut).alias("freed"))
        p = asked[k].join(seen[k], "gram", "left").withColumn("context", F.shiftright("gram", 8)).join(context, "context", "left")
        if below is None:
            p = p.withColumn("low", F.lit(_UNIFORM))
        else:
            p = p.withColumn("suffix", F.col("gram").bitwiseAND(mask(k - 1))).join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("low")), "suffix")
        own = F.when(F.col("c").isNull(), 0.0).otherwise(F.col("c") - cut)
        p = p.select("gram", F.when(F.col("total").isNull(), F.col("low")).otherwise((own + F.col("freed") * F.col("low")) / F.col("total")).alias("p"))
        below = p if k == order else written(p, f"order{k}")
    return below.select("gram", F.log("p").alias("log_p"))


def _shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _requests(shards: int, copies: int):
    """Of each batch the distinct n-grams, by shard."""

    def run(packed: pd.DataFrame) -> pd.DataFrame:
        codes, _ = distinct([t for _, texts in docs_of(packed) for t in texts])
        batch, shard = int(packed["batch"].iloc[0]), _shard_of(codes, shards)
        rows = [(int(s), batch % copies, batch, pack_sorted(codes[shard == s].astype(np.uint64))) for s in np.unique(shard)]
        give_back()
        return pd.DataFrame(rows, columns=["shard", "copy", "batch", "blob"])

    return run


def _answers(asked: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """The log probabilities of a shard's n-grams for every batch that asks, in the order of asking."""
    model = model.sort_values("gram")
    codes, logs = model["gram"].to_numpy(), model["log_p"].to_numpy().astype("<f4")
    rows = [(batch, shard, pack(logs=[logs[np.searchsorted(codes, unpack_sorted(unpack(blob)).astype(np.int64))].tobytes()])) for batch, shard, blob in zip(asked["batch"], asked["shard"], asked["blob"], strict=True)]
    return pd.DataFrame(rows, columns=["batch", "shard", "blob"])


def _scored(shards: int):
    def run(packed: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        codes, _ = distinct([t for _, texts in docs_of(packed) for t in texts])
        logs, shard = np.zeros(len(codes), np.float32), _shard_of(codes, shards)
        for s, blob in zip(answers["shard"], answers["blob"], strict=True):
            logs[shard == s] = np.frombuffer(unpack(blob).column("logs")[0].as_py(), "<f4")
        rows = []
        for ids, texts in docs_of(packed):
            rows += [(i, float(np.exp(-logs[np.searchsorted(codes, grams(t))].mean(dtype=np.float64))) if t else None, len(t)) for i, t in zip(ids, texts, strict=True)]
        found = pd.DataFrame(rows, columns=["row", "perplexity", "n_bytes"])
        give_back()
        return found

    return run


def perplexities(docs: DataFrame, trusted_ids: DataFrame, batch_bytes: int = BATCH_BYTES, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """(doc_id, lang, trusted, held_out, n_bytes, perplexity); null and empty texts have no perplexity.

    Texts are dealt to batches by a hash and packed; each batch asks the shards of the model for its
    distinct n-grams once, and the answers are joined back to it. One way at every size: shards grow
    in number with the model, copies of a shard with the batches that ask it.
    """
    ids = few(trusted_ids.select(F.col("doc_id").cast("long").alias("__id")).where("__id is not null").distinct())
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("__t"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    d = d.join(ids, d["doc_id"] == ids["__id"], "left").select("doc_id", "lang", "__t", F.col("__id").isNotNull().alias("trusted"), held_out.alias("held_out"))
    amount = d.agg(F.sum(F.octet_length("__t"))).first()[0]
    batches = blocks_for(amount, batch_bytes)
    counted = d.select("__t", (F.col("trusted") & ~F.col("held_out")).alias("__learned")).mapInArrow(_counts, "gram long, n long")
    model = written(probabilities(written(counted.groupBy("gram").agg(F.sum("n").alias("n")), "counted")), "model")
    shards, copies = blocks_for(model.count(), shard_grams), blocks_for(batches, BATCHES_PER_COPY)
    # What a row is beside its text travels with it as one struct.
    row = F.struct("doc_id", "lang", "trusted", "held_out")
    d = d.select(F.pmod(F.xxhash64("doc_id", F.octet_length("__t")), F.lit(batches)).cast("int").alias("batch"), F.to_json(row).alias("doc_id"), "__t")
    packed = d.mapInArrow(pack_docs, "batch int, docs binary").groupBy("batch")
    asked = packed.applyInPandas(_requests(shards, copies), "shard int, copy int, batch int, blob binary")
    sharded = model.mapInArrow(_with_shard(shards), "gram long, log_p double, shard int").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    answers = asked.groupBy("shard", "copy").cogroup(sharded.groupBy("shard", "copy")).applyInPandas(_answers, "batch int, shard int, blob binary")
    found = packed.cogroup(answers.groupBy("batch")).applyInPandas(_scored(shards), "row string, perplexity double, n_bytes long")
    return found.select(F.from_json("row", "doc_id long, lang string, trusted boolean, held_out boolean").alias("row"), "perplexity", "n_bytes").select("row.*", "n_bytes", "perplexity")


def _with_shard(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = pa.array(_shard_of(batch.column("gram").to_numpy(), shards), pa.int64()).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("gram"), batch.column("log_p"), shard], names=["gram", "log_p", "shard"])

    return run


def quality(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) of every document; labels names trusted text.

    Trusted are the documents that labels marks with quality 1. A document is kept if its perplexity
    is at most the quantile of the held-out trusted documents of its language and length class; a
    class with under MIN_CLASS of them (a null language counts as und) takes the quantile of its
    length over all languages, a length without any that over all held-out documents, and without
    these everything with text is kept. Null and empty texts have a null perplexity and are not kept.
    Repeated rows give repeated rows, a null doc_id is never trusted, other columns are ignored, an
    empty table gives no rows.
    """
    scored = written(perplexities(docs, labels.where("quality = 1")), "scored")
    scored = scored.withColumn("__class", sum(((F.col("n_bytes") >= n).cast("int") for n in LENGTHS), F.lit(0)))
    base = scored.where("trusted and held_out and perplexity is not null")
    level = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    own = base.groupBy("lang", "__class").agg(level.alias("__own"), F.count("*").alias("n")).where(F.col("n") >= MIN_CLASS).drop("n")
    by_length = base.groupBy("__class").agg(level.alias("__length"))
    overall = base.agg(level).first()[0]
    # Checked: a few rows per language; the joined side would be dealt by a few languages otherwise.
    d = scored.join(few(own, 100_000), ["lang", "__class"], "left").join(F.broadcast(by_length), "__class", "left")
    threshold = F.coalesce("__own", "__length", F.lit(overall).cast("double"))
    return d.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= F.coalesce(threshold, F.lit(float("inf"))), F.lit(False)).alias("kept"))
