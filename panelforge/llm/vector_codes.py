"""Vector codes: integer product quantisation by per-dimension value dictionaries.

Vectors are turned into integers and stored once as blocks: for every dimension the block's distinct
integers and each row's place among them. A round tabulates the squared differences of every distinct
integer to all codebook entries; the distances of a part are then gathers from these tables and sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from panelforge.llm.common import few, give_back, written
from panelforge.llm.packing import pack, unpack

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows and components of a block at most (a single row may have more components).
BLOCK_ROWS, BLOCK_NUMBERS = 65_536, 8_000_000
BLOCK = "n int, keys binary, codes binary, wide int, values binary, sizes array<int>"


def kept(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS) -> DataFrame:
    """vec_id, label, vector of the rows whose vector has a length that parts divide and only finite components."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = embeddings.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    return d.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % parts == 0)).where(finite)


def whole_numbers(rows: np.ndarray, scale: int = SCALE, parts: int = PARTS) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; raises where a squared distance could pass 64 bits."""
    x = np.floor(rows * scale)
    limit = 2.0**30 / max(1, rows.shape[-1] // parts)
    if x.size and np.abs(x).max() >= limit:
        raise ValueError(f"components beyond {limit / scale:g} would pass 64 bits in squared distances")
    return x.astype(np.int64)


def _blocks(width: int, scale: int, parts: int):
    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        flat = np.concatenate([b.column("vector").flatten().to_numpy(zero_copy_only=False) for b in batches])
        x = whole_numbers(flat.reshape(t.num_rows, width), scale, parts)
        values, codes = zip(*[np.unique(x[:, j], return_inverse=True) for j in range(width)], strict=True)
        sizes = [len(v) for v in values]
        wide = 2 if max(sizes) <= 1 << 16 else 4
        keys = pack(vec_id=t.column("vec_id").combine_chunks(), label=t.column("label").combine_chunks())
        squeezed = zstandard.ZstdCompressor(level=1).compress(np.array(codes, f"<u{wide}").tobytes())
        row = [t.num_rows], [keys], [squeezed], [wide], [np.concatenate(values).astype("<i8").tobytes()], [sizes]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int32())), strict=True)], names=["n", "keys", "codes", "wide", "values", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, min(BLOCK_ROWS, BLOCK_NUMBERS // width))
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if n + part.num_rows > most:
                    yield block(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield block(held)
        give_back()

    return run


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[dict, list[np.ndarray], np.ndarray]]:
    """(row, distinct integers of every dimension, codes by dimension and row) of each stored block."""
    for row in batch.to_pylist():
        values = np.split(np.frombuffer(row["values"], "<i8"), np.cumsum(row["sizes"])[:-1])
        raw = zstandard.ZstdDecompressor().decompress(row["codes"])
        yield row, values, np.frombuffer(raw, f"<u{row['wide']}").reshape(len(values), row["n"])


def nearest(values: list[np.ndarray], codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) by part and row: tables of squared differences, gathered and added.

    books has the shape parts x entries x positions; of equal distances the lower entry wins.
    """
    parts, entries, width = books.shape
    best, error = np.zeros((parts, codes.shape[1]), np.int64), np.zeros((parts, codes.shape[1]), np.int64)
    for p in range(parts):
        distance = np.zeros((codes.shape[1], entries), np.int64)
        for j in range(width):
            table = (values[p * width + j][:, None] - books[p, :, j]) ** 2
            distance += table[codes[p * width + j]]
        best[p] = distance.argmin(axis=1)
        error[p] = np.take_along_axis(distance, best[p][:, None], 1)[:, 0]
    return best, error


def _sums(books: np.ndarray):
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for _, values, codes in _opened(batch):
                best, _ = nearest(values, codes, books)
                for p in range(parts):
                    count[p] += np.bincount(best[p], minlength=entries)
                    for j in range(width):
                        # rows of one entry and one distinct integer are counted, then weighed: exact sums
                        v = values[p * width + j]
                        pairs = np.bincount(best[p] * len(v) + codes[p * width + j], minlength=entries * len(v))
                        total[p, :, j] += pairs.reshape(entries, len(v)) @ v
        part, entry, at = (x.ravel() for x in np.indices(total.shape))
        rows = [part, entry, at, total.ravel(), np.repeat(count.ravel(), width)]
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["part", "entry", "at", "total", "n"])
        give_back()

    return run


def start(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, scale: int = SCALE) -> np.ndarray:
    """The parts of the smallest vec_ids as codebooks (parts x entries x positions).

    Null vec_ids come last, equal ones in the order of their vectors; fewer rows give fewer entries.
    """
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    rows = [r for r in rows if len(r.vector) == len(rows[0].vector)]
    x = whole_numbers(np.array([r.vector for r in rows], np.float64), scale, parts)
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


def fit(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after so many rounds over all blocks: each entry the floored mean of its parts.

    A task sends one row per number of the codebooks, whatever it has read; the driver sees the sums
    of these, as many numbers as one codebook set has.
    """
    for _ in range(rounds):
        sums = blocks.mapInArrow(_sums(books), "part long, entry long, at long, total long, n long")
        books = books.copy()
        for r in sums.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("n > 0").collect():
            books[r.part, r.entry, r.at] = r.total // r.n
    return books


def _encode(books: np.ndarray, kinds: pa.Schema):
    hexed = np.array([f"{i:02x}" for i in range(books.shape[1])], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, values, codes in _opened(batch):
                best, error = nearest(values, codes, books)
                keys = unpack(row["keys"])
                code = hexed[best[0]]
                for p in range(1, len(best)):
                    code = code + hexed[best[p]]
                columns = [keys.column(c).combine_chunks().cast(kinds.field(c).type) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(code, pa.string()), pa.array(error.sum(axis=0))], names=["vec_id", "label", "code", "error"])
        give_back()

    return run


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[np.ndarray, DataFrame]:
    """(codebooks, (vec_id, label, code, error) of every kept row): fitted on all rows, not on a sample.

    Dropped are rows whose vector is null, empty, holds null or non-finite components, or has another
    length than the smallest kept vec_id's; a length that parts do not divide counts as another one.
    Repeated rows and null vec_ids and labels stay; without a kept row there are no entries and no
    codes. Other columns are not read. Entries number at most 256.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry must fit two hex digits")
    vectors = kept(embeddings, vec_id, vector, label, parts)
    books = start(vectors, entries, parts, scale)
    width = books.shape[0] * books.shape[2]
    kinds = vectors.select("vec_id", "label").schema
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)
    if not width:
        return books, vectors.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    blocks = written(vectors.where(F.size("vector") == width).mapInArrow(_blocks(width, scale, parts), BLOCK), "vectors")
    books = fit(blocks, books, rounds)
    return books, blocks.mapInArrow(_encode(books, to_arrow_schema(kinds)), f"{types}, code string, error long")


def codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row.

    label_error is the error of all rows with the same label, nulls together: summed before it is
    shuffled, and sent back to the rows by a broadcast only while labels are few.
    """
    books, rows = compress(embeddings)
    rows = written(rows, "codes")
    sums = few(written(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "__label"))
    d = rows.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return d.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same for DuckDB: every round is one more pair of table expressions, distances by plain sums."""
    stages = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale}e0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(embedding) % {parts} = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"parts AS MATERIALIZED (SELECT rid, vec_id, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS pv FROM kept, range({parts}) AS _(p))",
        f"book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, pv AS c FROM parts QUALIFY e < {entries})",
    ]
    for k in range(rounds + 1):
        square = "list_sum(list_transform(list_zip(pv, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        stages.append(f"near{k} AS MATERIALIZED (SELECT rid, p, any_value(pv) AS pv, min(CAST({square} AS HUGEINT) * {entries} + e) AS m FROM parts JOIN book{k} USING (p) GROUP BY rid, p)")
        if k < rounds:
            stages += [
                f"mean{k} AS MATERIALIZED (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT p, m % {entries} AS e, i, sum(x) AS s, count(*) AS n FROM (SELECT p, m, unnest(pv) AS x, generate_subscripts(pv, 1) AS i FROM near{k}) GROUP BY ALL) GROUP BY p, e)",
                f"book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, CAST(coalesce(m.c, b.c) AS BIGINT[]) AS c FROM book{k} AS b LEFT JOIN mean{k} AS m ON b.p = m.p AND b.e = m.e)",
            ]
    return f"""WITH {", ".join(stages)},
        coded AS (SELECT rid, string_agg(printf('%02x', CAST(m % {entries} AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY rid),
        books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (rid), books"""
