"""Benchmark decontamination: short test items inside long documents.

Containment search by MinHash, partitioned by size. A whole long document has next to no Jaccard
similarity with a short item, so documents are cut into windows sized for each size class of items
(items of U/2 to U shingles meet overlapping windows of 2U): inside such a window an item that is
contained has a similarity of at least 0.19, and with one-row bands and 64 hash functions it is missed
with a probability below 2e-6. Items of less than half the smallest class are looked up by the hashes
of their shingles instead. Every candidate is verified by exact containment of its shingles in
the whole document.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import blocks_for, give_back, written

SHINGLE, THRESHOLD, HASHES = 5, 0.8, 64
#: Words: ASCII lower-cased runs of digits, letters and anything beyond ASCII.
_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
#: Items compared at once; more items are taken block by block, each against all documents.
ITEMS_PER_BLOCK, BYTES_PER_BLOCK = 50_000, 16_000_000
_SMALLEST = 8


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_UPPER))


def shingles(text: str | None, size: int = SHINGLE) -> list[str]:
    """Space-joined shingles, repeats included; none in a shorter text."""
    w = words(text)
    return [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)]


_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: dict = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(20, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def shingle_hashes(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every shingle in order, shingles of each text), for all texts at once.

    Polynomial hashes of the texts reduced to words with single spaces; equal shingles have equal
    hashes. Bytes from 0x80 up are word bytes, so this cuts words as the text form does.
    """
    blob = b"\n".join(texts) + b"\n"
    t = _LOW[np.frombuffer(blob, np.uint8)]
    inside = _IN_WORD[t]
    before = np.concatenate([[False], inside[:-1]])
    after = before & ~inside
    starts = np.flatnonzero(inside & ~before)
    norm = np.where(after, np.uint8(32), t)[inside | after].astype(np.uint64)
    is_space = norm == 32
    ends_n = np.flatnonzero(is_space)
    starts_n = np.concatenate([[0], ends_n[:-1] + 1]) if len(ends_n) else ends_n
    limits = np.cumsum([len(x) + 1 for x in texts])
    n_words = np.diff(np.concatenate([[0], np.searchsorted(starts, limits)]))
    n = np.maximum(n_words - size + 1, 0)
    first = np.cumsum(n_words) - n_words
    g = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    last = g + size - 1
    up, down = _power(len(norm) + 1)
    h = np.concatenate([np.zeros(1, np.uint64), np.cumsum((norm + np.uint64(1)) * up[: len(norm)], dtype=np.uint64)])
    out = (h[ends_n[last]] - h[starts_n[g]]) * down[starts_n[g]]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32)), n


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, np.uint64)


def _signature(h: np.ndarray, mul: np.ndarray, add: np.ndarray, j: int) -> np.ndarray:
    """The j-th hash function over shingle hashes, as 32-bit values."""
    return ((h * mul[j] + add[j]) >> np.uint64(32)).astype(np.uint32)


class ItemIndex:
    """The items' MinHash values by size class, and their shingle sets."""

    def __init__(self, rows: list[tuple[int, str | None]], size: int, threshold: float, n_hashes: int) -> None:
        self.size, self.threshold, self.n_hashes = size, threshold, n_hashes
        self.mul, self.add = _family(n_hashes)
        self.items = []
        classes: dict[int, list[int]] = {}
        #: Items too short for a window of the smallest class, by the words of their shingles (all of
        #: their words if these are fewer than a shingle's): sorted hashes and the items.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        brief: dict[int, list[int]] = {}
        for row, (item_id, text) in enumerate(rows):
            n = len(words(text))
            if not n:
                continue
            if n < size:
                brief.setdefault(n, []).append(len(self.items))
                self.items.append((item_id, {" ".join(words(text))}, row))
                continue
            grams = set(shingles(text, size))
            if len(grams) < _SMALLEST // 2:
                brief.setdefault(size, []).append(len(self.items))
                self.items.append((item_id, grams, row))
                continue
            upper = _SMALLEST
            while upper < len(grams):
                upper *= 2
            classes.setdefault(upper, []).append(len(self.items))
            self.items.append((item_id, grams, row))
        #: For each class: sorted values of each hash function, and the item of each value.
        self.tables = {}
        for n, members in brief.items():
            h, each = shingle_hashes([(rows[self.items[m][2]][1] or "").encode() for m in members], n)
            order = np.argsort(h, kind="stable")
            self.short[n] = (h[order], np.repeat(members, each)[order])
        for upper, members in classes.items():
            h, n = shingle_hashes([(rows[self.items[m][2]][1] or "").encode() for m in members], size)
            at = np.cumsum(n) - n
            mins = np.stack([np.minimum.reduceat(_signature(h, self.mul, self.add, j), at) for j in range(n_hashes)], 1)
            order = np.argsort(mins, axis=0, kind="stable")
            self.tables[upper] = (np.take_along_axis(mins, order, 0), np.array(members)[order])

    def candidates(self, texts: list[bytes]) -> set[tuple[int, int]]:
        """(text number, item number) where a window of a text shares a MinHash value with an item."""
        h, n = shingle_hashes(texts, self.size)
        found: set[tuple[int, int]] = set()
        if not len(h) or not self.tables:
            return found
        # Blocks of _SMALLEST shingles, then of twice as many, never across texts.
        levels, owner, size = {}, np.flatnonzero(n), _SMALLEST
        counts = -(-n[owner] // size)
        cuts = [np.repeat((np.cumsum(n) - n)[owner], counts) + size * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))]
        levels[size] = counts
        while size < max(self.tables):
            half = -(-counts // 2)
            cuts.append(np.repeat(np.cumsum(counts) - counts, half) + 2 * (np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half)))
            counts, size = half, 2 * size
            levels[size] = counts
        alone = {u: np.cumsum(c) - 1 for u, c in levels.items()}
        texts_of = {u: np.repeat(owner, c) for u, c in levels.items()}
        for j in range(self.n_hashes):
            low, size = _signature(h, self.mul, self.add, j), _SMALLEST
            for cut in cuts:
                low = np.minimum.reduceat(low, cut)
                if size in self.tables:
                    # Windows of two neighbouring blocks of one text.
                    near = np.append(low[1:], low[-1])
                    near[alone[size]] = low[alone[size]]
                    window = np.minimum(low, near)
                    values, members = self.tables[size]
                    col = values[:, j]
                    a = np.searchsorted(col, window)
                    for k in np.flatnonzero(col[np.minimum(a, len(col) - 1)] == window):
                        b = np.searchsorted(col, window[k], "right")
                        found.update((int(texts_of[size][k]), int(m)) for m in members[a[k] : b, j])
                size *= 2
        return found

    def brief_candidates(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(words, text number, item number) where a text has a shingle that hashes as one of a short item."""
        out: set[tuple[int, int, int]] = set()
        for size, (hashes, members) in self.short.items():
            h, n = shingle_hashes(texts, size)
            owner = np.repeat(np.arange(len(texts)), n)
            a, b = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
            hit = np.flatnonzero(b > a)
            out |= {(size, int(owner[i]), int(m)) for i in hit for m in members[a[i] : b[i]]}
        return list(out)

    def matches(self, texts: list[str]) -> list[tuple[int, int, int, int]]:
        """(text number, item_id, shared shingles, item shingles) for every item contained in a text."""
        out, own, at = [], set(), None
        data = [t.encode() for t in texts]
        for size, k, m in sorted([(self.size, *c) for c in self.candidates(data)] + self.brief_candidates(data)):
            if (size, k) != at:
                own, at = set(shingles(texts[k], size)), (size, k)
            item_id, wanted, _ = self.items[m]
            shared = len(wanted & own)
            if shared >= self.threshold * len(wanted):
                out.append((k, item_id, shared, len(wanted)))
        return out


_index: dict = {}
#: Bytes of text searched at once; a longer text is searched alone.
_BLOCK_BYTES = 400_000


def _index_of(shared) -> ItemIndex:
    key, rows, size, threshold, n_hashes = shared.value
    if key not in _index:
        _index.clear()
        _index[key] = ItemIndex(rows, size, threshold, n_hashes)
    return _index[key]


def _found(index: ItemIndex, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
    """The matches of many texts, searched in blocks of bounded size."""
    a = 0
    while a < len(texts):
        b, total = a, 0
        while b < len(texts) and (b == a or total + len(texts[b]) <= _BLOCK_BYTES):
            total += len(texts[b])
            b += 1
        yield from ((a + k, *m) for k, *m in index.matches(texts[a:b]))
        a = b


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(shared)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            found = [(ids[k], *m) for k, *m in _found(index, [t or "" for t in batch.column("text").to_pylist()])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "item_id", "n_shared", "n_item"])
        give_back()

    return run


def _without(shared, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(shared)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for k, *_ in _found(index, [t or "" for t in batch.column(column).to_pylist()]):
                keep[k] = False
            yield batch.filter(pa.array(keep))
        give_back()

    return run


def _item_blocks(items: DataFrame, size: int, threshold: float, n_hashes: int) -> tuple[int, Iterator]:
    """(number of blocks, the items in blocks of bounded rows and bytes): one block at the driver at a time."""
    i = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    amount = i.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(blocks_for(amount["n"], ITEMS_PER_BLOCK), blocks_for(amount["bytes"], BYTES_PER_BLOCK))

    def sent() -> Iterator:
        for block in range(blocks):
            rows = [tuple(r) for r in i.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]
            yield items.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows, size, threshold, n_hashes))

    return blocks, sent()


def contaminated(docs: DataFrame, items: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, n_hashes: int = HASHES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): items contained in documents.

    An item is contained if at least threshold of its distinct shingles occur in the document; an
    item of fewer words than a shingle is contained where its words stand in a row. Items without a
    word match nothing, and neither do null texts. Repeated rows give repeated matches; a null id is
    carried along; empty tables give no rows; other columns are ignored. Items go to the tasks in
    blocks of bounded rows and bytes, one at a time, documents stay where they are: there is no shuffle.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    blocks, each = _item_blocks(items, size, threshold, n_hashes)
    for sent in each:
        found = d.mapInArrow(_search(sent), "doc_id long, item_id long, n_shared long, n_item long")
        if blocks > 1:
            found = written(found, "contaminated")
            sent.destroy()
        out = found if out is None else out.unionByName(found)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def decontaminated(docs: DataFrame, items: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, n_hashes: int = HASHES) -> DataFrame:
    """docs without those that contain an item, all columns as they are; judged where they lie.

    Null texts stay, repeated rows go or stay together, an empty table gives no rows, and without items
    all stay. Beyond one block of items what is left is written after each.
    """
    out = docs
    blocks, each = _item_blocks(items, size, threshold, n_hashes)
    for sent in each:
        out = out.mapInArrow(_without(sent, docs.columns.index("text")), docs.schema)
        if blocks > 1:
            out = written(out, "decontaminated")
            sent.destroy()
    return out


def oracle(size: int = SHINGLE, threshold: float = THRESHOLD) -> str:
    """Exact containment as DuckDB SQL over the views documents and benchmark."""
    word = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
    grams = "CASE WHEN len(w) >= k THEN list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i+k-1], ' ')) ELSE [] END"
    return f"""
WITH i0 AS (SELECT row_number() OVER () AS ir, item_id, {word} AS w FROM benchmark),
i1 AS (SELECT *, least(len(w), {size}) AS k FROM i0 WHERE len(w) > 0),
i AS (SELECT DISTINCT ir, item_id, k, unnest({grams}) AS g FROM i1),
n AS (SELECT ir, count(*) AS n_item FROM i GROUP BY ir),
d0 AS (SELECT row_number() OVER () AS dr, doc_id, {word} AS w FROM documents),
d1 AS (SELECT * FROM d0 CROSS JOIN (SELECT DISTINCT k FROM i1) AS sizes),
d AS (SELECT DISTINCT dr, doc_id, k, unnest({grams}) AS g FROM d1)
SELECT any_value(doc_id) AS doc_id, any_value(item_id) AS item_id, count(*)::BIGINT AS n_shared, any_value(n_item)::BIGINT AS n_item, count(*) / any_value(n_item) AS containment
FROM d JOIN i USING (k, g) JOIN n USING (ir) GROUP BY dr, ir HAVING count(*) >= {threshold} * any_value(n_item)"""
