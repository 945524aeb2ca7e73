"""Alignment of two tokenizers' tokens, and counts of linked id pairs by external spilling.

Batches of documents are encoded by both tokenizers; an A and a B token are linked where their byte
ranges end together. A batch's (B id, A id, document, times) records are sorted by side B first, dealt
by the low bits of the B id, and spilled as zstd runs. Runs of a radix partition meet in k-way heap
merges, which count each pair; in the last merge all pairs of a B id come one after another and give
its maximum. The counts then go back along the same runs and become sums per document.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import blocks_for, give_back, written
from panelforge.llm.packing import pack, pack_sorted, unpack, unpack_sorted
from panelforge.llm.token_files import encode_texts, row_blocks

#: Radix partitions by the low bits of the B id: a power of two.
RADIX = 64
#: Bytes of text whose records are spilled together, and whose runs meet in one merge, on average.
BATCH_BYTES, GROUP_BYTES = 16_000_000, 128_000_000
#: Merged runs that meet in one merge of the next level.
FAN = 32
#: A pair as one number, side B in the high bits: the order of the runs.
SHIFT = 32

_state: dict = {}


def _spelled(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, bytes) of what each id of a vocabulary stands for, one after another."""
    if path not in _state:
        if path.endswith(".model"):
            model = _pieces(path)
            spelled = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.vocab_size())]
        else:
            from panelforge.llm.token_counts import byte_letters
            from panelforge.llm.token_files import _tokenizer

            byte_of = {c: b for b, c in enumerate(byte_letters())}
            vocabulary = _tokenizer(path).get_vocab(with_added_tokens=True)
            spelled = [b""] * (max(vocabulary.values()) + 1)
            for token, i in vocabulary.items():
                spelled[i] = bytes(byte_of[c] for c in token)
        lengths = np.array([len(s) for s in spelled], np.int64)
        _state[path] = np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(spelled), np.uint8)
    return _state[path]


def _pieces(path: str):
    if (path, "model") not in _state:
        import sentencepiece

        _state[path, "model"] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _state[path, "model"]


def _joined(ids: list[np.ndarray], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all ids, their numbers of bytes, the bytes themselves) of many texts end to end."""
    first, lengths, raw = _spelled(path)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    n = lengths[flat]
    return flat, n, raw[np.repeat(first[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _encoded(texts: list[bytes], path_a: str, path_b: str) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """(which texts both sides spell exactly as space + text, A ids, B ids); texts have a byte at least."""
    spaced = [b" " + t for t in texts]
    a = encode_texts(spaced, path_a, plain=True)
    b = [np.array(x, np.int64) for x in _pieces(path_b).encode([t.decode() for t in texts], num_threads=1)] if texts else []
    right = np.ones(len(texts), bool)
    for ids, path in ((a, path_a), (b, path_b)):
        _, n, raw = _joined(ids, path)
        ends = np.cumsum([0, *[len(x) for x in ids]])
        bytes_to = np.concatenate([[0], np.cumsum(n)])[ends].tolist()
        data = raw.tobytes()
        right &= np.array([data[s:e] == t for s, e, t in zip(bytes_to[:-1], bytes_to[1:], spaced, strict=True)], bool)
    keep = np.flatnonzero(right).tolist()
    return keep, [a[i] for i in keep], [b[i] for i in keep]


def _words(path: str, marks: str) -> dict[str, np.ndarray]:
    """Every id in decimal with each of these marks behind it."""
    if (path, "words") not in _state:
        n = len(_spelled(path)[1])
        _state[path, "words"] = {m: np.array([f"{i}{m}" for i in range(n)], object) for m in marks}
    return _state[path, "words"]


def align_block(texts: list[bytes | None], path_a: str, path_b: str, digests: bool) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """((n_a, n_b, n_groups, n_links, groups) of each text, link pairs, number of the text of each link)."""
    out: list = [(0, 0, 0, 0, "")] * len(texts)
    filled = [i for i, t in enumerate(texts) if t]
    keep, a, b = _encoded([texts[i] for i in filled], path_a, path_b)
    if not keep:
        return out, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    which = np.array(filled)[keep]
    ids_a, len_a, _ = _joined(a, path_a)
    ids_b, len_b, _ = _joined(b, path_b)
    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    in_a, in_b = np.searchsorted(end_a, common), np.searchsorted(end_b, common)
    text_end = np.cumsum([len(texts[i]) + 1 for i in which])
    doc = np.searchsorted(text_end, common)
    pairs = (ids_b[in_b].astype(np.uint64) << np.uint64(SHIFT)) | ids_a[in_a].astype(np.uint64)
    # every token's place in the written form: after all tokens of both sides in earlier groups
    group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    written_out = np.empty(len(ids_a) + len(ids_b), object)
    words_a, words_b = _words(path_a, ",|"), _words(path_b, ",;")
    last_a, last_b = np.zeros(len(ids_a), bool), np.zeros(len(ids_b), bool)
    last_a[in_a], last_b[in_b] = True, True
    before_b = np.concatenate([[0], in_b + 1])[group_a]
    written_out[np.arange(len(ids_a)) + before_b] = np.where(last_a, words_a["|"][ids_a], words_a[","][ids_a])
    written_out[np.arange(len(ids_b)) + (in_a + 1)[group_b]] = np.where(last_b, words_b[";"][ids_b], words_b[","][ids_b])
    at_a, at_b = np.searchsorted(end_a, text_end) + 1, np.searchsorted(end_b, text_end) + 1
    groups = np.searchsorted(common, text_end) + 1
    last = (0, 0, 0)
    for i, now in zip(which.tolist(), zip(at_a.tolist(), at_b.tolist(), groups.tolist(), strict=True), strict=True):
        n_a, n_b, n = (x - y for x, y in zip(now, last, strict=True))
        text = "".join(written_out[last[0] + last[1] : now[0] + now[1]].tolist())[:-1]
        out[i] = n_a, n_b, n, n, hashlib.sha256(text.encode()).hexdigest() if digests else text
        last = now
    return out, pairs, which[doc]


RUN = "batch long, radix int, head binary, tail binary"


def _spill(path_a: str, path_b: str, digests: bool, batch_bytes: int):
    """Batches of documents as rows: radix -1 holds the documents, the others hold runs.

    A run's head has its sorted pairs and their counts, its tail the document and times of each
    record in the same order.
    """
    schema = pa.schema([("batch", pa.int64()), ("radix", pa.int32()), ("head", pa.binary()), ("tail", pa.binary())])

    def rows(batch: int, ids: list[pa.Array], stats: list[tuple], pairs: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups"), zip(*stats, strict=True), strict=True))
        out = [(batch, -1, pack(doc_id=pa.concat_arrays(ids), **{k: list(v) for k, v in columns.items()}), b"")]
        order = np.lexsort((docs, pairs))
        pairs, docs = pairs[order], docs[order]
        new = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (docs[1:] != docs[:-1])])) if len(pairs) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(pairs)))
        pairs, docs = pairs[new], docs[new]
        radix = (pairs >> np.uint64(SHIFT)) & np.uint64(RADIX - 1)
        for r in np.unique(radix).tolist():
            mine = radix == r
            p, d, t = pairs[mine], docs[mine], times[mine]
            starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            records = np.diff(np.append(starts, len(p)))
            head = pack_sorted(p[starts], counts=pa.array(np.add.reduceat(t, starts)))
            out.append((batch, int(r), head, pack(docs=d.astype(np.int32), times=t.astype(np.int32), records=_padded(records, len(d)))))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        names = (TaskContext.get().partitionId() << 32 | k for k in itertools.count())
        ids, stats, pairs, docs, size = [], [], [], [], 0
        for batch in batches:
            for at, n in row_blocks(batch.column("text")):
                part = batch.slice(at, n)
                texts = part.column("text").to_pylist()
                found, p, d = align_block(texts, path_a, path_b, digests)
                pairs.append(p)
                docs.append(d + len(stats))
                ids.append(part.column("doc_id"))
                stats += found
                size += sum(len(t or b"") for t in texts)
                if size >= batch_bytes:
                    yield from rows(next(names), ids, stats, np.concatenate(pairs), np.concatenate(docs))
                    ids, stats, pairs, docs, size = [], [], [], [], 0
        if stats:
            yield from rows(next(names), ids, stats, np.concatenate(pairs), np.concatenate(docs))
        give_back()

    return run


def _padded(x: np.ndarray, n: int) -> np.ndarray:
    """x with zeros behind it: columns of a packed table are of one length."""
    return np.concatenate([x, np.zeros(n - len(x), np.int64)]).astype(np.int32)


def _head(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    table = unpack(blob)
    return unpack_sorted(table), table.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)


def merged(heads: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int]]:
    """(pair, count) in ascending order: a heap of the runs' next pairs, equal ones added up."""
    entries = heapq.merge(*[zip(p.tolist(), n.tolist(), strict=True) for p, n in heads])
    for pair, same in itertools.groupby(entries, key=lambda e: e[0]):
        yield pair, sum(n for _, n in same)


def with_maxima(counted: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, bool]]:
    """(pair, count, whether no pair of its B id counts more): side-major order brings these together."""
    for _, side in itertools.groupby(counted, key=lambda e: e[0] >> SHIFT):
        held = list(side)
        most = max(n for _, n in held)
        for pair, n in held:
            yield pair, n, n == most


def _merge(last: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        entries = merged([_head(b) for b in table.column("head").to_pylist()])
        columns = list(zip(*(with_maxima(entries) if last else entries), strict=True)) or [()] * (3 if last else 2)
        more = {"best": pa.array(columns[2], pa.bool_())} if last else {}
        head = pack_sorted(np.array(columns[0], np.uint64), counts=pa.array(columns[1], pa.int64()), **more)
        give_back()
        return pa.table({"radix": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "head": pa.array([head], pa.binary())})

    return run


def count_pairs(runs: DataFrame, groups: int) -> DataFrame:
    """(radix, head): all pairs of a radix partition with their counts and maxima, from runs in groups.

    Runs of a group are merged, then FAN merged runs at a time until one is left of each radix
    partition: as many levels as the logarithm of the groups, each written to the shared folder.
    """
    level = runs.select("radix", "part", "head")
    while True:
        last = groups == 1
        level = written(level.groupBy("radix", "part").applyInArrow(_merge(last), "radix int, part long, head binary"), "merged")
        if last:
            return level.select("radix", "head")
        groups = -(-groups // FAN)
        level = level.withColumn("part", F.pmod("part", F.lit(groups)))


def _contributions(runs: pa.Table, totals: pa.Table) -> pa.Table:
    """Each run's records as sums per document of its batch: links, of which best, and their counts."""
    batches, blobs = [], []
    for blob in totals.column("head").to_pylist():
        table = unpack(blob)
        pairs = unpack_sorted(table)
        counts, best = (table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("counts", "best"))
        for batch, head, tail in zip(*[runs.column(c).to_pylist() for c in ("batch", "head", "tail")], strict=True):
            mine, _ = _head(head)
            records = unpack(tail)
            docs, times = (records.column(c).to_numpy() for c in ("docs", "times"))
            at = np.repeat(np.searchsorted(pairs, mine), records.column("records").to_numpy()[: len(mine)])
            named, place = np.unique(docs, return_inverse=True)
            sums = np.zeros((2, len(named)), np.int64)
            np.add.at(sums[0], place, times * best[at])
            np.add.at(sums[1], place, times * counts[at])
            batches.append(batch)
            blobs.append(pack(docs=named, n_best=sums[0], count_sum=sums[1]))
    give_back()
    return pa.table({"batch": pa.array(batches, pa.int64()), "sums": pa.array(blobs, pa.binary())})


def _documents(name: str):
    def run(documents: pa.Table, contributions: pa.Table) -> pa.Table:
        """A batch's documents with the sums that its runs brought back."""
        tables = [unpack(blob) for blob in documents.column("head").to_pylist()]
        if not tables:
            raise ValueError("contributions without their batch")
        d = tables[0]
        sums = np.zeros((2, d.num_rows), np.int64)
        for blob in contributions.column("sums").to_pylist():
            t = unpack(blob)
            for i, c in enumerate(("n_best", "count_sum")):
                sums[i, t.column("docs").to_numpy()] += t.column(c).to_numpy()
        give_back()
        out = {"doc_id": d.column("doc_id").cast(pa.int64()), **{c: d.column(c).cast(pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")}}
        out |= {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1]), name: d.column("groups").cast(pa.string())}
        return pa.table(out)

    return run


def _spilled(docs: DataFrame, path_a: str, path_b: str, digests: bool) -> tuple[DataFrame, DataFrame, int]:
    """(documents by batch, runs by radix and part, number of parts) as written to the shared folder."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    groups = blocks_for(d.agg(F.sum(F.octet_length("text"))).first()[0], GROUP_BYTES)
    rows = written(d.mapInArrow(_spill(path_a, path_b, digests, BATCH_BYTES), RUN), "runs")
    part = F.pmod(F.xxhash64("batch"), F.lit(groups))
    return rows.where("radix < 0").select("batch", "head"), rows.where("radix >= 0").withColumn("part", part), groups


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(b, a, n, best) of every linked id pair: how many links hold it, and whether no pair of b has more."""
    _, runs, groups = _spilled(docs, path_a, path_b, True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("head").to_pylist():
                table = unpack(blob)
                pairs = unpack_sorted(table)
                counts, best = (table.column(c).combine_chunks().flatten() for c in ("counts", "best"))
                b, a = (pairs >> np.uint64(SHIFT)).astype(np.int64), (pairs & np.uint64((1 << SHIFT) - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(a), counts, best], names=["b", "a", "n", "best"])

    return count_pairs(runs, groups).select("head").mapInArrow(rows, "b long, a long, n long, best boolean")


def align(docs: DataFrame, path_a: str, path_b: str, digests: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every whole text.

    path_a is a byte-level BPE of the tokenizers library, which gets a space and the text; path_b is a
    sentencepiece model, which adds the space itself. Strings of special tokens are ordinary text.
    groups writes the aligned groups as `a1,a2|b1;a3|b2,b3`; digests puts its SHA-256 in its place, as
    groups_sha256. A text that is null or empty, or that a side does not spell byte for byte, has no
    tokens: zeros and ''. Repeated rows and null doc_ids stay; an empty table gives no rows; other
    columns are not read.

    A task holds one batch of documents, or the runs of one radix partition from about GROUP_BYTES of
    text; even a B id with a third of all links stays within that. Runs grow with the text, and there
    are at most RADIX of them for each batch. Every level is written before it is read.
    """
    documents, runs, groups = _spilled(docs, path_a, path_b, digests)
    totals = count_pairs(runs, groups).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("part", F.col("part").cast("long"))
    sums = written(runs.groupBy("radix", "part").cogroup(totals.groupBy("radix", "part")).applyInArrow(_contributions, "batch long, sums binary"), "sums")
    name = "groups_sha256" if digests else "groups"
    schema = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {name} string"
    return documents.groupBy("batch").cogroup(sums.groupBy("batch")).applyInArrow(_documents(name), schema)
