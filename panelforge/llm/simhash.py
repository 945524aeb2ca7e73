"""SimHash near-duplicates by exact tiled comparison.

Fingerprints are sorted into tiles by their population counts: one count for each quarter of the
64 bits. Two fingerprints within the radius differ by at most the radius in the sum of those counts'
differences, so a tile is held only against tiles that near; all pairs of such tiles are compared
with exclusive-or and bit counts in numpy, which finds every link.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.common import blocks_for, components, few, give_back, written

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints that one comparison task holds at most for each side, on average.
PER_TASK = 1_500_000
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(texts: list[bytes], size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is set if it is set in over half of the shingles' XXH64."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = _WORD.findall(text.translate(_UPPER))
        if not words:
            continue
        flat = memoryview(b" ".join(words))
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        n = max(1, len(words) - size + 1)
        last = ends[min(size, len(words)) - 1 :]
        starts = [0, *ends[: n - 1]]
        hashes.extend([digest(flat[a : b - 1], seed) for a, b in zip(starts, last, strict=True)])
        counts[i] = n
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    all_hashes = np.array(hashes, np.uint64)
    first = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    for bit in range(64):
        ones = np.add.reduceat((all_hashes >> np.uint64(bit)) & np.uint64(1), first)
        out[full] |= (2 * ones.astype(np.int64) > counts[full]).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprints(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                fp = fingerprint([t or b"" for t in part.column("__t").to_pylist()], size, seed)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in part.schema.names if c != "__t"], pa.array(fp.view(np.int64))], names=[*[c for c in part.schema.names if c != "__t"], "__fp"])
        give_back()

    return run


def with_fingerprints(docs: DataFrame, size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, __fp long) of every document; null text counts as empty, fingerprint zero."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("__t"))
    return d.mapInArrow(_fingerprints(size, seed), "doc_id long, __fp long")


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int64)


def _offsets(radius: int) -> np.ndarray:
    """Differences of quarter counts within the radius, one of each opposite pair, zero first."""
    grid = np.array(np.meshgrid(*[np.arange(-radius, radius + 1)] * 4, indexing="ij")).reshape(4, -1).T
    grid = grid[np.abs(grid).sum(1) <= radius]
    return grid[[tuple(g) >= (0, 0, 0, 0) for g in grid.tolist()]]


def _cell(q: np.ndarray) -> np.ndarray:
    return ((q[:, 0] * 17 + q[:, 1]) * 17 + q[:, 2]) * 17 + q[:, 3]


def _deal(radius: int, parts: int, cells: np.ndarray):
    """Sends each tile to itself and to the existing tiles with population counts within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = _offsets(radius)
        for batch in batches:
            for fps, ids, part in zip(batch.column("fps").to_pylist(), batch.column("ids").to_pylist(), batch.column("part").to_pylist(), strict=True):
                fp = np.array(fps, np.int64)
                q = _quarters(fp[:1].view(np.uint64))
                to = q + offsets
                to = to[(to >= 0).all(1) & (to <= 16).all(1)]
                home = _cell(to)
                home = home[np.isin(home, cells)]
                own = _cell(q)[0]
                blob, keys = fp.tobytes(), np.array(ids, np.int64).tobytes()
                rows = [(int(h), p, part, bool(h == own and p == part), blob, keys) for h in home for p in range(parts) if h != own or p >= part]
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)], schema=_DEALT)

    return run


_DEALT = pa.schema([("cell", pa.int64()), ("home_part", pa.int32()), ("away_part", pa.int32()), ("own", pa.bool_()), ("fps", pa.binary()), ("ids", pa.binary())])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links: as many rows as nodes at most, rooted at the smallest id."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[ia], label[ib])
        new = label.copy()
        np.minimum.at(new, label[ia], low)
        np.minimum.at(new, label[ib], low)
        new = new[new]
        if (new == label).all() and (label[ia] == label[ib]).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _near(p: np.ndarray, ip: np.ndarray, q: np.ndarray, iq: np.ndarray, radius: int, step: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked ids of two tiles, some rows of the one against all of the other at a time."""
    if not len(p) or not len(q):
        return
    rows = max(1, step // len(q))
    for at in range(0, len(p), rows):
        i, j = np.nonzero(np.bitwise_count(p[at : at + rows, None] ^ q[None, :]) <= radius)
        i, j = ip[at + i], iq[j]
        keep = i != j
        if keep.any():
            yield _forest(i[keep], j[keep])


def _compare(radius: int):
    """Compares the tiles of each (cell, parts) group; the rows of a group come one after another."""

    def compared(home: list, away: list) -> pa.RecordBatch | None:
        load = lambda rows, k, kind: np.frombuffer(b"".join(r[k] for r in rows), kind)
        x, ix = load(home, 0, np.uint64), load(home, 1, np.int64)
        y, iy = load(away, 0, np.uint64), load(away, 1, np.int64)
        found = [*_near(x, ix, x, ix, radius), *_near(x, ix, y, iy, radius)]
        if not found:
            return None
        a, b = _forest(*(np.concatenate(c) for c in zip(*found, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, home, away = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cell", "home_part", "away_part", "own", "fps", "ids")]
            for cell, p, q, own, fps, ids in zip(*columns, strict=True):
                if (cell, p, q) != at:
                    if home and (out := compared(home, away)) is not None:
                        yield out
                    at, home, away = (cell, p, q), [], []
                (home if own else away).append((fps, ids))
        if home and (out := compared(home, away)) is not None:
            yield out
        home, away = [], []
        give_back()

    return run


def links(classes: DataFrame, radius: int = RADIUS, per_task: int = PER_TASK) -> DataFrame:
    """(a, b): links of classes (rep long, __fp long) within the radius, as spanning forests.

    Every pair of fingerprints within the radius ends in one component of these links; the pairs
    within a group are not listed. Tiles over per_task fingerprints are split by a hash, and their
    parts are compared part by part, so no task grows with the input.
    """
    parts = blocks_for(classes.count(), 10 * per_task)
    q = [F.bit_count(F.shiftrightunsigned("__fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    cell = ((q[0] * 17 + q[1]) * 17 + q[2]) * 17 + q[3]
    tiles = classes.withColumn("cell", cell).withColumn("part", F.pmod(F.xxhash64("__fp"), F.lit(parts)).cast("int"))
    tiles = tiles.groupBy("cell", "part").agg(F.collect_list(F.struct("__fp", "rep")).alias("z")).select("part", F.col("z.__fp").alias("fps"), F.col("z.rep").alias("ids"))
    # At most 17 ** 4 cells exist, whatever the input.
    cells = np.array([r["cell"] for r in classes.select(cell.alias("cell")).distinct().collect()], np.int64)
    dealt = tiles.mapInArrow(_deal(radius, parts, cells), "cell long, home_part int, away_part int, own boolean, fps binary, ids binary")
    if parts > 1:
        # A tile's own part must be present beside every part it is compared with.
        homes = dealt.where("own")
        dealt = dealt.where("not own").unionByName(homes.withColumn("away_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    keys = ("cell", "home_part", "away_part")
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) by document.

    Equal fingerprints form a class with its smallest doc_id; links are sought between classes only,
    so copies are never paired. Null and empty texts have fingerprint zero and are linked like any
    other. Repeated rows give repeated rows. A class without any non-null doc_id is not compared
    and has a null component. Other columns are ignored; an empty table gives no rows.
    """
    d = written(with_fingerprints(docs, size, seed), "fingerprints")
    classes = written(d.groupBy("__fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = components(links(classes.where("rep is not null"), radius))
    classes = classes.join(found, classes["rep"] == found["node"], "left").select("__fp", F.coalesce("component", "rep").alias("component_id"))
    return d.join(classes, "__fp").select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """docs with one document of each component: the one whose doc_id names it.

    Of rows that share that doc_id, the one with the fingerprint of its component and the smallest
    text is kept. Rows with a null doc_id can't be told apart and are all kept. Whole texts are not
    shuffled: the ids that go, and those of repeated rows, meet the documents in a broadcast of a
    checked size (a join beyond it); only repeated rows are sorted.
    """
    found = written(near_duplicates(docs, size, radius, seed).where("doc_id is not null"), "near")
    leads = found.where("doc_id = component_id")
    by_id = written(found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("leads")), "decided")
    gone = by_id.where("not leads").select(F.col("doc_id").alias("__id"))
    twice = by_id.where("leads and n > 1").select(F.col("doc_id").alias("__id"))
    once = by_id.where("not leads or n > 1").select(F.col("doc_id").alias("__id"))
    single = docs.join(few(once), docs["doc_id"] == once["__id"], "left_anti") if not gone.isEmpty() or not twice.isEmpty() else docs
    if twice.isEmpty():
        return single
    rows = docs.join(few(twice), docs["doc_id"] == twice["__id"], "left_semi")
    schema = T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())])
    rows = rows.withColumn("__t", F.col("text").cast("binary")).mapInArrow(_fingerprints(size, seed), schema)
    mark = leads.select(F.col("doc_id").alias("__id"), F.col("fingerprint").alias("__mark")).distinct()
    hexed = F.lower(F.lpad(F.hex("__fp"), 16, "0"))
    rows = rows.join(mark, (rows["doc_id"] == mark["__id"]) & (hexed == mark["__mark"]), "left_semi")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    return single.unionByName(rows.withColumn("__rank", rank).where("__rank = 1").select(*docs.columns))
