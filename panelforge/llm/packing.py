"""Many rows as one compressed value: what batches and buckets send each other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard


def pack(**columns: np.ndarray | list) -> bytes:
    """Columns of equal length as a compressed Arrow stream."""
    table = pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def unpack(blob: bytes) -> pa.Table:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)) as stream:
        return stream.read_all()


def pack_sorted(x: np.ndarray, **columns) -> bytes:
    """Sorted numbers as differences, byte by byte."""
    gaps = np.diff(np.concatenate([np.zeros(1, np.uint64), x]))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(x) else 1
    raw = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return pack(gaps=[raw], width=[width], **{k: pa.array([v], pa.list_(v.type)) if isinstance(v, pa.Array) else [v] for k, v in columns.items()})


def unpack_sorted(table: pa.Table) -> np.ndarray:
    width, raw = table.column("width")[0].as_py(), np.frombuffer(table.column("gaps")[0].as_py(), np.uint8)
    full = np.zeros((len(raw) // width, 8), np.uint8)
    full[:, :width] = raw.reshape(width, -1).T
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


def pack_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, docs): the doc_id and __t of many rows of one batch as one value."""
    kind = None
    held: dict[int, list] = {}
    size: dict[int, int] = {}

    def row(key: int, docs: list) -> pa.RecordBatch:
        blob = pack(doc_id=pa.array([d[0] for d in docs], kind), text=pa.array([d[1] for d in docs], pa.large_binary()))
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([blob], pa.binary())], names=["batch", "docs"])

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for key, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("batch", "doc_id", "__t")], strict=True):
            held.setdefault(key, []).append((doc_id, text))
            size[key] = size.get(key, 0) + len(text)
            if size[key] > 2_000_000:
                yield row(key, held.pop(key))
                size[key] = 0
    for key, docs in held.items():
        yield row(key, docs)


def docs_of(packed: pd.DataFrame) -> Iterator[tuple[list, list]]:
    """(doc_ids, texts) of each packed value."""
    for blob in packed["docs"]:
        table = unpack(blob)
        yield table.column("doc_id").to_pylist(), table.column("text").to_pylist()
