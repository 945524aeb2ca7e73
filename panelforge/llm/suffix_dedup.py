"""Removal of repeated 50-byte strings across documents, by suffix arrays.

Every 50-byte window is dealt to a task by the smallest hash of its 24-byte strings (its anchor), so
equal windows always meet; neighbouring windows with one anchor travel as one segment. Four steps,
each bounded by the size of a batch or of a bucket, never by how often a string occurs:

1. batches send each of their anchors once, and learn which occur in more than one document;
2. batches send each distinct segment with such an anchor once, with the smallest doc_id that has it;
3. a bucket of segments is sorted by a two-stage suffix array (only suffixes smaller than their
   successors are sorted directly, the others are induced by bucket scans), adjacent common prefixes
   of 50 bytes or more group equal windows, and each group's smallest doc_id is sent back;
4. batches mark the windows that start in a smaller document and cut them out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import blocks_for, give_back
from panelforge.llm.packing import docs_of, pack, pack_docs, pack_sorted, unpack, unpack_sorted

WINDOW, ANCHOR = 50, 24
#: Bytes of text of a batch, of an anchor bucket and of a segment bucket, on average.
BATCH_BYTES, ANCHOR_BYTES, SEGMENT_BYTES = 16_000_000, 24_000_000, 6_000_000
#: An anchor in more documents than this deals its windows by their whole content instead.
HOT_DOCUMENTS = 5000
_NONE = np.iinfo(np.int64).max
_BLOCK = 200_000
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(1, 2**63, 256, np.uint64)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = b"\xff"  # in no UTF-8 text


# --- suffix arrays ---------------------------------------------------------------------------------


def _words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one big-endian number, zeros behind the end."""
    padded = np.concatenate([t, np.zeros(72, np.uint8)])
    w = np.zeros(len(t) + 64, np.uint64)
    for j in range(8):
        w |= padded[j : j + len(w)].astype(np.uint64) << np.uint64(56 - 8 * j)
    return w


def _sort_directly(at: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the depth bytes from each on; only ties are looked at again."""
    if not len(at):
        return at
    key = w[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.zeros(len(at), np.int32)
    np.cumsum(key[1:] != key[:-1], out=group[1:])
    for d in range(8, depth, 8):
        tied = np.zeros(len(at), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        i = np.flatnonzero(tied)
        if not len(i):
            break
        sub = at[i]
        key = w[np.minimum(sub + d, len(w) - 1)]
        order = np.lexsort((key, group[i]))
        at[i] = sub[order]
        key, g = key[order], group[i]
        # Ties keep one group number only while their next bytes agree.
        differs = np.zeros(len(at), np.int32)
        differs[i[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        group += np.cumsum(differs, dtype=np.int32)
    return at


def suffix_array(t: np.ndarray, depth: int = 56, w: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of the bytes t in order of their first depth bytes at least (an end comes first)."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int32)
    w = _words(t) if w is None else w
    # A suffix is smaller than its successor if the first different byte to come is larger.
    last = np.flatnonzero(np.concatenate([t[1:] != t[:-1], [True]])).astype(np.int32)
    rises = np.concatenate([t[last[:-1]] < t[last[:-1] + 1], [False]])
    smaller = np.repeat(rises, np.diff(last, prepend=np.int32(-1)))
    del last, rises
    direct = _sort_directly(np.flatnonzero(smaller).astype(np.int32), w, depth)
    del smaller
    direct_by = np.searchsorted(t[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[t[n - 1]].append(np.array([n - 1], np.int32))
    out: list[np.ndarray] = []
    for c in range(256):
        scan = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int32)
        parts = [scan]
        while len(scan):
            before = scan[scan > 0] - 1
            scan = before[t[before] == c]
            if len(scan):
                parts.append(scan)
        bucket = np.concatenate([*parts, direct[direct_by[c] : direct_by[c + 1]]])
        induced[c] = []
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[t[before] > c]
        if len(before):
            first = t[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for a, b in zip(cuts, [*cuts[1:], len(before)], strict=True):
                induced[first[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(w: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common, up to limit."""
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for d in range(0, limit, 8):
        x = w[a[alive] + d] ^ w[b[alive] + d]
        same = np.full(len(x), 8, np.int64)
        for k in range(1, 9):
            same -= (x >> np.uint64(64 - 8 * k)) != 0
        out[alive] += same
        alive = alive[same == 8]
        if not len(alive):
            break
    return np.minimum(out, limit)


def smallest_owner(segments: list[bytes], owners: np.ndarray, window: int = WINDOW) -> Iterator[np.ndarray]:
    """For every window of every segment, the smallest owner of a segment that has the same window."""
    t = np.frombuffer(_SEPARATOR.join(segments) + _SEPARATOR, np.uint8)
    lengths = np.array([len(s) for s in segments], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    counts = np.maximum(lengths - window + 1, 0)
    w = _words(t)
    owner_at = np.full(len(t), -1, np.int32)
    owner_at[np.repeat((starts - (np.cumsum(counts) - counts)).astype(np.int32), counts) + np.arange(counts.sum(), dtype=np.int32)] = np.repeat(np.arange(len(segments), dtype=np.int32), counts)
    sa = suffix_array(t, window + 6, w)
    sa = sa[owner_at[sa] >= 0]
    new = np.ones(len(sa), bool)
    for i in range(0, len(sa) - 1, _BLOCK):
        part = sa[i : i + _BLOCK + 1]
        new[i + 1 : i + len(part)] = common_prefixes(w, part[:-1], part[1:], window) < window
    first = np.flatnonzero(new)
    low = np.minimum.reduceat(owners[owner_at[sa]], first) if len(sa) else owners
    del w, owner_at
    group = np.zeros(len(t), np.int32)
    group[sa] = np.cumsum(new, dtype=np.int32) - 1
    for s, c in zip(starts.tolist(), counts.tolist(), strict=True):
        yield low[group[s : s + c]]


# --- anchors and segments --------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _hash_runs(t: np.ndarray, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Hashes of all strings of the given sizes, built from strings of half the length."""
    powers = {1: _BYTE[t]}
    k = 1
    while 2 * k <= max(sizes):
        powers[2 * k] = _joined(powers[k], powers[k], k)
        k *= 2
    out = {}
    for size in sizes:
        h, length = None, 0
        for k in sorted(powers, reverse=True):
            if length + k <= size and size & k:
                h = powers[k] if h is None else _joined(h, powers[k], length)
                length += k
        out[size] = _mixed(h)
    return out


def _joined(x: np.ndarray, y: np.ndarray, shift: int) -> np.ndarray:
    """Hashes of strings made of one hashed in x and, shift bytes on, one hashed in y."""
    n = len(y) - shift
    h = x[:n] * _MUL + y[shift:]
    return h ^ (h >> np.uint64(29))


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(texts):
        b, total = a, 0
        while b < len(texts) and (b == a or total + len(texts[b]) <= _BLOCK):
            total += len(texts[b])
            b += 1
        yield a, b
        a = b


def segments(texts: list[bytes], hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(text number, start, windows, key, content hash) of every segment of every text.

    A segment is a run of windows with one anchor, its key; a window with a hot anchor is a segment of
    its own whose key is the hash of its content.
    """
    out: list[tuple[np.ndarray, ...]] = []
    for a, b in _blocks(texts):
        lengths = np.array([len(x) for x in texts[a:b]])
        t = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        if len(t) < WINDOW:
            continue
        hashes = _hash_runs(t, (ANCHOR, WINDOW) if hot is not None and len(hot) else (ANCHOR,))
        x, width, m = hashes[ANCHOR], WINDOW - ANCHOR + 1, 1
        low = x
        while 2 * m <= width:
            low = np.minimum(low[:-m], low[m:])
            m *= 2
        n = len(t) - WINDOW + 1
        low = np.minimum(low[:n], low[width - m : width - m + n])
        ends = np.cumsum(lengths)
        doc = np.repeat(np.arange(b - a), lengths)[:n]
        whole = np.arange(n) + WINDOW <= ends[doc]
        at, key, doc = np.flatnonzero(whole), low[whole], doc[whole]
        alone = np.zeros(len(at), bool)
        if WINDOW in hashes:
            alone = _member(key, hot)
            key = np.where(alone, hashes[WINDOW][at], key)
        if not len(at):
            continue
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | alone[1:]
        first = np.flatnonzero(new)
        runs = np.diff(np.concatenate([first, [len(at)]]))
        s = at[first]
        # Content hash: sums of byte hashes times powers, taken back to the segment's start.
        up, down = _power(len(t) + 1)
        h = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[t] * up[: len(t)], dtype=np.uint64)])
        content = _mixed((h[s + runs + WINDOW - 1] - h[s]) * down[s] + runs.astype(np.uint64))
        out.append((doc[first] + a, s - (ends - lengths)[doc[first]], runs, key[first], content))
    if not out:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


_powers: dict = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(18, int(n).bit_length())
        for name, base in (("up", int(_MUL)), ("down", pow(int(_MUL), -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which x are in the sorted array."""
    if not len(of):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


# --- the four steps --------------------------------------------------------------------------------


def _edges(buckets: int) -> np.ndarray:
    """The first anchor of every bucket but the lowest, for buckets with equal shares of all anchors.

    An anchor is the smallest of the hashes in a window, so anchors crowd near zero: a position whose hash
    is the share 1 - q of all is one if the runs of larger hashes on both sides fill a window of w, which has
    the chance q^(w-1) * (1 + (w-1) * (1-q)); the integral of that is their distribution.
    """
    w = WINDOW - ANCHOR + 1
    x = np.linspace(0, 1, max(2**16, 16 * buckets) + 1)
    mass = (w + 1) / 2 * ((1 - (1 - x) ** w) - (w - 1) / (w + 1) * (1 - (1 - x) ** (w + 1)))
    cuts = np.interp(np.arange(1, buckets) / buckets, mass, x)
    return (cuts * 2.0**63).astype(np.uint64) << np.uint64(1)


def _anchors(edges: np.ndarray):
    """The anchors of one batch, once each with the number of its documents that have it, by bucket."""

    def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

    def run(packed: pd.DataFrame) -> pd.DataFrame:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for _, texts in docs_of(packed):
            doc, _, _, anchor, _ = segments(texts)
            order = np.lexsort((doc, anchor))
            doc, anchor = doc[order], anchor[order]
            once = np.ones(len(doc), bool)
            once[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
            parts.append(np.unique(anchor[once], return_counts=True))
            if len(parts) >= 16:
                parts = [summed(parts)]
        found, n = summed(parts)
        cuts = np.searchsorted(found, edges)
        rows = []
        for bucket, (x, c) in enumerate(zip(np.split(found, cuts), np.split(n, cuts), strict=True)):
            if len(x):
                rows.append((bucket, int(packed["batch"].iloc[0]), pack_sorted(x, n=pa.array(np.minimum(c, 65535).astype(np.uint16)))))
        give_back()
        return pd.DataFrame(rows, columns=["bucket", "batch", "blob"])

    return run


def _shared(hot_documents: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Every blob holds an anchor once, with the number of its documents that have it.
        found = np.concatenate([unpack_sorted(unpack(b)) for b in pdf["blob"]])
        found.sort()
        found = found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found
        total = np.zeros(len(found), np.int32)
        for blob in pdf["blob"]:
            table = unpack(blob)
            total[np.searchsorted(found, unpack_sorted(table))] += table.column("n")[0].values.to_numpy()
        found, total = found[total >= 2], total[total >= 2]
        out = []
        for batch, rows in pdf.groupby("batch").indices.items():
            own = np.unique(np.concatenate([_shared_of(found, unpack_sorted(unpack(pdf["blob"].iloc[i]))) for i in rows]))
            if len(own):
                out.append((batch, pack_sorted(own, hot=pa.array(total[np.searchsorted(found, own)] > hot_documents))))
        del found, total
        give_back()
        return pd.DataFrame(out, columns=["batch", "blob"])

    return run


def _shared_of(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return keys[_member(keys, found)]


def _learned(replies: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted anchors that a batch shares with others, and the hot ones among them."""
    keys, hot = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for blob in replies["blob"]:
        table = unpack(blob)
        x = unpack_sorted(table)
        keys.append(x)
        hot.append(x[table.column("hot")[0].values.to_numpy(zero_copy_only=False)])
    return np.sort(np.concatenate(keys)), np.sort(np.concatenate(hot))


def _send_segments(buckets: int):
    def run(packed: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        shared, hot = _learned(replies)
        seen: dict[str, list] = {"key": [], "content": [], "owner": [], "text": []}
        for ids, texts in docs_of(packed):
            doc, start, runs, key, content = segments(texts, hot)
            # Windows with a hot anchor have another key: they are all sent.
            keep = _member(key, shared) | _hot_alone(key, runs, shared, hot, texts, doc, start)
            doc, start, runs, key, content = (x[keep] for x in (doc, start, runs, key, content))
            if not len(doc):
                continue
            owner = np.array([_NONE if i is None else i for i in ids], np.int64)[doc]
            order = np.lexsort((owner, content))
            first = order[np.concatenate([[True], content[order][1:] != content[order][:-1]])]
            seen["key"].append(key[first])
            seen["content"].append(content[first])
            seen["owner"].append(owner[first])
            seen["text"] += [texts[d][s : s + r + WINDOW - 1] for d, s, r in zip(doc[first].tolist(), start[first].tolist(), runs[first].tolist(), strict=True)]
        if not seen["key"]:
            return pd.DataFrame({"bucket": np.zeros(0, np.int32), "batch": np.zeros(0, np.int32), "blob": []})
        key, content, owner = (np.concatenate(seen[c]) for c in ("key", "content", "owner"))
        order = np.lexsort((owner, content))
        first = order[np.concatenate([[True], content[order][1:] != content[order][:-1]])]
        bucket = (_mixed(key[first]) % np.uint64(buckets)).astype(np.int32)
        rows = []
        for b in np.unique(bucket):
            i = first[bucket == b]
            blob = pack(content=content[i], owner=owner[i], text=pa.array([seen["text"][k] for k in i.tolist()], pa.large_binary()))
            rows.append((int(b), int(packed["batch"].iloc[0]), blob))
        del seen
        give_back()
        return pd.DataFrame(rows, columns=["bucket", "batch", "blob"])

    return run


def _hot_alone(key, runs, shared, hot, texts, doc, start) -> np.ndarray:
    """Segments that segments() cut out of a hot anchor: single windows keyed by their content."""
    if not len(hot):
        return np.zeros(len(key), bool)
    one = np.flatnonzero((runs == 1) & ~_member(key, shared))
    out = np.zeros(len(key), bool)
    if len(one):
        flat = [texts[d][s : s + WINDOW] for d, s in zip(doc[one].tolist(), start[one].tolist(), strict=True)]
        t = np.frombuffer(b"".join(flat), np.uint8)
        x = _hash_runs(t, (WINDOW,))[WINDOW][::WINDOW]
        out[one] = x == key[one]
    return out


def _smallest(pdf: pd.DataFrame) -> pd.DataFrame:
    content, owner, texts = [], [], []
    for blob in pdf["blob"]:
        table = unpack(blob)
        content.append(table.column("content").to_numpy())
        owner.append(table.column("owner").to_numpy())
        texts.append(table.column("text").combine_chunks())
    base = np.cumsum([0, *[len(c) for c in content]])
    all_content = np.concatenate(content)
    order = np.argsort(all_content, kind="stable")
    ordered = all_content[order]
    lead = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    found, first = ordered[lead], order[lead]
    low = np.minimum.reduceat(np.concatenate(owner)[order], np.flatnonzero(lead))
    del all_content, order, ordered, owner
    which = np.searchsorted(base, first, "right") - 1
    segments_of = [texts[k][int(i - base[k])].as_py() for i, k in zip(first.tolist(), which.tolist(), strict=True)]
    del texts
    answers = list(smallest_owner(segments_of, low))
    out = []
    for batch, rows in pdf.groupby("batch").indices.items():
        own = np.unique(np.concatenate([content[i] for i in rows]))
        values = [answers[i] for i in np.searchsorted(found, own)]
        counts = np.array([len(v) for v in values], np.int32)
        out.append((batch, pack(content=[own.tobytes()], counts=[counts.tobytes()], low=[np.concatenate(values).astype("<i8").tobytes()])))
    del answers, content, segments_of
    give_back()
    return pd.DataFrame(out, columns=["batch", "blob"])


def _cut_out(packed: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    hot = np.zeros(0, np.uint64)
    content, offsets, low = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    done = 0
    for kind, blob in zip(replies["kind"], replies["blob"], strict=True):
        table = unpack(blob)
        if kind == 0:
            x = unpack_sorted(table)
            hot = np.concatenate([hot, x[table.column("hot")[0].values.to_numpy(zero_copy_only=False)]])
            continue
        counts = np.frombuffer(table.column("counts")[0].as_py(), np.int32).astype(np.int64)
        content.append(np.frombuffer(table.column("content")[0].as_py(), np.uint64))
        low.append(np.frombuffer(table.column("low")[0].as_py(), "<i8"))
        offsets.append(done + np.cumsum(counts) - counts)
        done += counts.sum()
    hot = np.sort(hot)
    content, offsets, low = np.concatenate(content), np.concatenate(offsets), np.concatenate(low)
    order = np.argsort(content)
    content, offsets = content[order], offsets[order]
    out = []
    for ids, texts in docs_of(packed):
        doc, start, runs, _, own = segments(texts, hot)
        keep = _member(own, content)
        doc, start, runs, own = doc[keep], start[keep], runs[keep], own[keep]
        ids_of = np.array([np.iinfo(np.int64).min if i is None else i for i in ids], np.int64)
        base = np.cumsum([0, *[len(t) for t in texts]])
        # Every window of every segment: its place in the block, and whether a smaller document has it.
        inside = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        smaller = low[np.repeat(offsets[np.searchsorted(content, own)], runs) + inside] < np.repeat(ids_of[doc], runs) if len(doc) else np.zeros(0, bool)
        at = (np.repeat(base[doc] + start, runs) + inside)[smaller] if len(doc) else np.zeros(0, np.int64)
        edges = np.bincount(at, minlength=base[-1] + 1).astype(np.int64) - np.bincount(at + WINDOW, minlength=base[-1] + 1)[: base[-1] + 1]
        covered = np.cumsum(edges)[: base[-1]] > 0
        for k, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
            gone = covered[base[k] : base[k + 1]]
            removed = int(gone.sum())
            spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if removed else 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if removed else text
            out.append((doc_id, len(text), removed, spans, kept))
    found = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    found["doc_id"] = found["doc_id"].astype("Int64")
    del out, low, content, offsets
    give_back()
    return found


def _digests(packed: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
    found = _cut_out(packed, replies)
    found["kept_sha256"] = [hashlib.sha256(k).hexdigest() for k in found.pop("kept")]
    return found


def remove_repeats(docs: DataFrame, digests: bool = False, hot_documents: int = HOT_DOCUMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) of every document.

    Removed are all bytes covered by a 50-byte string that also starts in a document with a smaller
    doc_id; strings are judged on the input and never cross documents. Null text is empty; texts under 50
    bytes keep everything; rows with one doc_id do not remove each other's bytes; a null doc_id is
    smaller than none and loses nothing; other columns are ignored, an empty table gives no rows.
    digests=True returns kept_sha256 (lowercase hex) in place of the kept bytes.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("__t"))
    total = d.agg(F.sum(F.octet_length("__t"))).first()[0]
    batches, anchors, buckets = (blocks_for(total, x) for x in (BATCH_BYTES, ANCHOR_BYTES, SEGMENT_BYTES))
    d = d.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.octet_length("__t")), F.lit(batches)).cast("int"))
    # A block's number is its partition: hashed, several blocks would share a task while others idle.
    packed = d.mapInArrow(pack_docs, "batch int, docs binary").repartitionById(batches, "batch").groupBy("batch")
    sent = packed.applyInPandas(_anchors(_edges(anchors)), "bucket int, batch int, blob binary")
    shared = sent.repartitionById(anchors, "bucket").groupBy("bucket").applyInPandas(_shared(hot_documents), "batch int, blob binary")
    pieces = packed.cogroup(shared.repartitionById(batches, "batch").groupBy("batch")).applyInPandas(_send_segments(buckets), "bucket int, batch int, blob binary")
    lows = pieces.repartitionById(buckets, "bucket").groupBy("bucket").applyInPandas(_smallest, "batch int, blob binary")
    replies = shared.withColumn("kind", F.lit(0)).unionByName(lows.withColumn("kind", F.lit(1)))
    kind = "kept_sha256 string" if digests else "kept binary"
    return packed.cogroup(replies.repartitionById(batches, "batch").groupBy("batch")).applyInPandas(_digests if digests else _cut_out, f"doc_id long, n_bytes long, n_removed long, n_spans long, {kind}")
