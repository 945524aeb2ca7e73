"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on doc_id.

Documents are dealt by ranges of doc_id before they are encoded, so every file holds a sorted range,
stripes can be read in parallel, and a look-up by doc_id skips files, stripes and row groups by
their statistics and Bloom filters.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import blocks_for, give_back, shared_dir

END_ID = 0
#: White space beyond ASCII's usual four characters would need the tokenizer's own look-ahead: texts
#: with any of it are encoded whole.
RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Bound on remembered chunks in a worker (about 40 bytes each); beyond it the memory starts afresh.
REMEMBERED = 1_000_000
#: Chunks over so many bytes are not remembered.
LONGEST = 64
BLOCK_BYTES, BLOCK_TEXTS, LEARN_AT_ONCE = 1_000_000, 512, 20_000
#: Bytes of text of a doc_id range, on average: a range is sorted, encoded and written by one task.
RANGE_BYTES = 32_000_000
ROW = "doc_id long, part int, row long, n_tokens long, ids array<int>"

_state: dict = {}
_BASE = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 13]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: What may follow a letter at a cut: ASCII characters that are no letter, digit or control.
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
#: Bytes that RARE's characters have: a text without any of these has none of them.
_SUSPECT = np.zeros(256, bool)
_SUSPECT[[0x0B, 0x0C, *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _tokenizer(path: str, plain: bool = True):
    """The tokenizer; plain takes the strings of special tokens inside texts for ordinary text."""
    if (path, plain) not in _state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = plain
        _state[path, plain] = tokenizer
    return _state[path, plain]


def _special(path: str) -> re.Pattern | None:
    """The strings of added tokens, which the library finds inside texts by default."""
    if (path, "special") not in _state:
        added = [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]
        _state[path, "special"] = re.compile(b"|".join(re.escape(t.encode()) for t in added)) if added else None
    return _state[path, "special"]


def _byte_lengths(path: str) -> np.ndarray:
    """Bytes that each id stands for: a byte-level vocabulary spells every byte as one character."""
    if (path, "bytes") not in _state:
        vocabulary = _tokenizer(path).get_vocab(with_added_tokens=True)
        lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            lengths[i] = len(token)
        _state[path, "bytes"] = lengths
    return _state[path, "bytes"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    if len(_state.get("up", ())) < n:
        size = 1 << max(20, int(n).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _state[name] = np.multiply.accumulate(x)
    return _state["up"], _state["down"]


def cut_places(t: np.ndarray) -> np.ndarray:
    """Where UTF-8 bytes can be cut so that byte-level pre-tokens stay whole.

    Before a single space between two characters that are not white; before and after a single line
    feed between such; before an ASCII mark that follows a letter (ASCII, or Latin-1 by its bytes).
    """
    white = _WHITE[t]
    solid_before, solid_after = np.zeros(len(t), bool), np.zeros(len(t), bool)
    solid_before[1:] = ~white[:-1]
    solid_after[:-1] = ~white[1:]
    lone = white & solid_before & solid_after
    letter = _LETTER[t]
    letter[1:] |= (t[:-1] == 0xC3) & (t[1:] != 0x97) & (t[1:] != 0xB7)
    cut = (lone & (t == 32)) | (feed := lone & (t == 10))
    cut[1:] |= feed[:-1] | (_MARK[t[1:]] & letter[:-1])
    return np.flatnonzero(cut)


class _Known:
    """Remembered chunks: sorted 64-bit hashes and the ids of each chunk, in plain arrays."""

    def __init__(self) -> None:
        self.keys, self.first, self.count, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it is there) of each key."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def add(self, keys: np.ndarray, count: np.ndarray, flat: np.ndarray) -> None:
        """Adds sorted new keys with their numbers of ids and the ids one after another."""
        first = len(self.flat) + np.cumsum(count) - count
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.count = np.insert(self.keys, at, keys), np.insert(self.first, at, first), np.insert(self.count, at, count)
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])


def _learn(path: str, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each chunk, the ids one after another).

    Chunks are encoded end to end in long strings and the ids are cut by the bytes they stand for. A
    chunk that starts without a space gets a line feed before it, which is a token of its own there;
    chunks with white space at an end, but for one leading space, go alone.
    """
    tokenizer, byte_lengths = _tokenizer(path), _byte_lengths(path)
    found: list = [None] * len(chunks)
    edge = b" \t\n\r"
    together = [i for i, c in enumerate(chunks) if c[-1] not in edge and (c[0] not in edge or (c[0] == 32 and c[1] not in edge))]
    alone = sorted(set(range(len(chunks))) - set(together))
    for i, e in zip(alone, tokenizer.encode_batch_fast([chunks[i].decode() for i in alone], add_special_tokens=False), strict=True):
        found[i] = np.array(e.ids, np.int32)
    for a in range(0, len(together), LEARN_AT_ONCE):
        part = together[a : a + LEARN_AT_ONCE]
        text = b"".join(chunks[i] if chunks[i][0] == 32 else b"\n" + chunks[i] for i in part)
        ids = np.array(tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.int32)
        sizes = np.array([len(chunks[i]) for i in part], np.int64)
        ends = np.cumsum(sizes + np.array([chunks[i][0] != 32 for i in part]))
        cuts = np.cumsum(byte_lengths[ids])
        first, last = np.searchsorted(cuts, ends - sizes, "right"), np.searchsorted(cuts, ends, "left") + 1
        if not (cuts[last - 1] == ends).all():
            raise ValueError("ids do not end where their chunks do")
        for i, x, y in zip(part, first.tolist(), last.tolist(), strict=True):
            found[i] = ids[x:y]
    return np.array([len(f) for f in found], np.int32), np.concatenate(found) if found else np.zeros(0, np.int32)


def _gather(first: np.ndarray, count: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The ids at first, first + 1 ... of each entry, one entry after another."""
    return flat[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]


def encode_texts(texts: list[bytes], path: str, plain: bool = False) -> list[np.ndarray]:
    """Ids of whole texts (UTF-8), equal to encoding each at once without begin and end tokens.

    The strings of special tokens inside texts become these tokens, as is the library's default, or
    ordinary text if plain is set; texts that hold any are encoded whole.

    Byte-level pre-tokens do not cross cut_places, so chunks can be encoded on their own; a chunk seen
    before is looked up by its 64-bit hash, and only new ones go to the tokenizer, many at a time.
    """
    out: list = [np.zeros(0, np.int32)] * len(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(x) for x in texts])
    suspect = np.unique(np.searchsorted(ends, np.flatnonzero(_SUSPECT[data]), "right")).tolist()
    rare = {i for i in suspect if RARE.search(texts[i].decode())}
    if not plain and (special := _special(path)):
        rare |= {i for i, x in enumerate(texts) if special.search(x)}
    rare = sorted(rare)
    for i, e in zip(rare, _tokenizer(path, plain).encode_batch_fast([texts[i].decode() for i in rare], add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, np.int32)
    whole = sorted({i for i, x in enumerate(texts) if x} - set(rare))
    if not whole:
        return out
    if rare:
        data = np.frombuffer(b"".join([texts[i] for i in whole]), np.uint8)
    sizes = np.array([len(texts[i]) for i in whole])
    text_starts = np.cumsum(sizes) - sizes
    begins = np.zeros(len(data), bool)
    begins[cut_places(data)] = True
    begins[text_starts] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], len(data))
    up, down = _powers(len(data) + 1)
    h = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    key = (h[ends] - h[starts]) * down[starts]
    key ^= key >> np.uint64(31)
    key *= np.uint64(0xD6E8FEB86659FD93)
    distinct, one, which = np.unique(key, return_index=True, return_inverse=True)
    known = _state.setdefault((path, "known"), _Known())
    if len(known.keys) > REMEMBERED:
        known = _state[path, "known"] = _Known()
    new = np.flatnonzero(~known.find(distinct)[1])
    raw = data.tobytes()
    count, ids = _learn(path, [raw[a:b] for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)])
    known_too = _Known()
    known_too.add(distinct[new], count, ids)
    short = (ends - starts)[one[new]] <= LONGEST
    if short.all():
        known.add(distinct[new], count, ids)
    else:
        known.add(distinct[new][short], count[short], _gather(known_too.first[short], count[short], ids))
    at, there = known.find(distinct)
    at_new, _ = known_too.find(distinct)
    long = ~there
    first = np.where(long, len(known.flat) + (known_too.first[at_new] if len(new) else 0), known.first[at])
    counts = np.where(long, known_too.count[at_new] if len(new) else 0, known.count[at]).astype(np.int64)
    flat = np.concatenate([known.flat, ids]) if long.any() else known.flat
    text_of_chunk = np.searchsorted(starts, text_starts)
    tokens = _gather(first[which], counts[which], flat)
    bounds = np.append(np.concatenate([[0], np.cumsum(counts[which])])[text_of_chunk], len(tokens))
    for i, a, b in zip(whole, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[i] = tokens[a:b]
    return out


def row_blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of blocks of bounded size; a longer text is a block of its own."""
    sizes = [n or 0 for n in pc.binary_length(texts).to_pylist()]
    a = 0
    while a < len(sizes):
        b, total = a, 0
        while b < len(sizes) and b - a < BLOCK_TEXTS and (b == a or total + sizes[b] <= BLOCK_BYTES):
            total += sizes[b]
            b += 1
        yield a, b - a
        a = b


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, row = np.array([end_id], "<i4"), 0
        for batch in batches:
            for at, n in row_blocks(batch.column("text")):
                part = batch.slice(at, n)
                ids = [x for e in encode_texts([t or b"" for t in part.column("text").to_pylist()], path) for x in (e, end)]
                lengths = np.array([len(ids[i]) + 1 for i in range(0, len(ids), 2)], np.int64)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
                rows = pa.array(np.arange(row, row + n))
                row += n
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), rows, pa.array(lengths), lists], names=["doc_id", "part", "row", "n_tokens", "ids"])
        give_back()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, range_bytes: int = RANGE_BYTES) -> None:
    """Encodes every whole text and writes (doc_id, part, row, n_tokens, ids) as ORC to path.

    Null text is an empty text: only the end id. A null doc_id comes first; repeated doc_ids stay as
    repeated rows; an empty table gives an empty dataset; other columns are not written. Ids are
    stored as ORC integers, which are run-length encoded; part numbers the doc_id range, of about
    range_bytes of text, and row the place within it (doc_id, then text by its bytes).
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    amount = d.agg(F.sum(F.octet_length("text"))).first()[0]
    n = max(blocks_for(amount, range_bytes), docs.sparkSession.sparkContext.defaultParallelism)
    d = d.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    d = d.withColumn("part", F.spark_partition_id().cast("int"))
    out = d.mapInArrow(_encode(tokenizer, end_id), ROW)
    (
        out.write.option("compression", "zstd")
        .option("orc.row.index.stride", "1000")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "part", "row", "n_tokens")], pa.array(crc, pa.int64())], names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])
    give_back()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows (doc_id, part, row, n_tokens, ids); filters on doc_id reach the files."""
    return spark.read.schema(ROW).orc(path)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files.

    start adds the tokens of earlier doc_id ranges (one row per range) to a running sum within the
    document's own range, so no task sees more than one range.
    """
    rows = read_tokens(spark, path).mapInArrow(_digest, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")
    lengths = read_tokens(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("__sum"))
    earlier = F.coalesce(F.sum("__sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = lengths.select("part", earlier.alias("__earlier"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    d = rows.withColumn("__own", F.coalesce(own, F.lit(0))).join(parts, "part")
    return d.select("doc_id", (F.col("__earlier") + F.col("__own")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
