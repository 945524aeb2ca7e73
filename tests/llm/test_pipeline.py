"""The five stages from raw tables to read-back, each held against brute force on what it was given."""

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from panelforge.llm import decontaminate, simhash, toxicity
from panelforge.llm.common import table
from panelforge.llm.queries import fold

pytestmark = pytest.mark.filterwarnings("ignore")


def _tables(path, docs):
    pq.write_table(docs, path / "documents.parquet")
    for t in ("labels", "benchmark"):
        pd.read_parquet(f"/root/testdata/sf0.001/{t}.parquet").to_parquet(path / f"{t}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(-1, None, "en", "a"), (-2, "", None, None), (-3, "word " * 20_000, "en", "b"), (-4, docs.text[3], "en", None), (-4, docs.text[3], "en", None), (-5, docs.text[5], None, "a")]
    frame = pd.concat([docs, pd.DataFrame(odd, columns=["doc_id", "text", "lang", "source"])], ignore_index=True)
    frame["size"], frame["component_id"], frame["n_tokens"] = 7, "x", 0.5
    return _tables(tmp_path_factory.mktemp("raw"), pa.Table.from_pandas(frame, preserve_index=False))


def _targets(sizes):
    """Shares by weight, capped at twice a source's size, the excess reshared until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    targets, left, budget = {}, set(names), 1.5 * sum(sizes.values())
    while left:
        share = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        if not over:
            return targets | share
        for s in over:
            targets[s] = 2.0 * sizes[s]
            budget -= targets[s]
        left -= over
    return targets


def test_stages_against_brute_force(spark, raw, tmp_path):
    docs = table(spark, raw, "documents")
    columns, outs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, raw).write.parquet(path)
        docs = spark.read.parquet(path)
        outs.append(docs)
        assert name == "tokens" or docs.columns == columns
    key = lambda r: (r.doc_id, r.text)
    before = table(spark, raw, "documents").collect()
    model = toxicity.fit(table(spark, raw, "documents").where(fold(5) != 0), table(spark, raw, "labels").where(fold(5) != 0))
    clean = [r for r in before if model.score((r.text or "").encode()) < 0.5]
    assert sorted(map(str, map(key, outs[0].collect()))) == sorted(str(key(r)) for r in clean) and 0 < len(clean)

    fps = simhash.fingerprint([(r.text or "").encode() for r in clean])
    lead = list(range(len(clean)))

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(clean)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 4) + i + 1:
            a, b = sorted((root(i), root(int(j))), key=lambda k: clean[k].doc_id)
            lead[b] = a
    groups: dict = {}
    for i, r in enumerate(clean):
        groups.setdefault(root(i), set()).add(r.doc_id)
    single = outs[1].collect()
    assert sorted(r.doc_id for r in single) == sorted(min(g) for g in groups.values())

    items = [set(decontaminate.shingles(r.text)) for r in table(spark, raw, "benchmark").collect()]
    free = [r for r in single if not any(s and len(s & set(decontaminate.shingles(r.text))) >= 0.8 * len(s) for s in items)]
    assert sorted(map(str, map(key, outs[2].collect()))) == sorted(str(key(r)) for r in free)

    mixed = outs[3].collect()
    times: dict = {}
    for r in mixed:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) <= {r.doc_id for r in free} and max(times.values()) <= 2
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    sizes: dict = {}
    for r in free:
        sizes.setdefault(r.source, []).append(size(r))
    taken = {s: 0 for s in sizes}
    for r in mixed:
        taken[r.source] += size(r)
    for source, target in _targets({s: sum(n) for s, n in sizes.items()}).items():
        total, reachable = sum(sizes[source]), 1
        for n in sizes[source]:
            reachable |= reachable << n
        rest = round(target) - (int(target // total) if total else 0) * total
        best = min(abs(x - rest) for x in range(total + 1) if reachable >> x & 1)
        assert abs(taken[source] - target) <= best + 1

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted, start = [], 0
    for r in sorted(mixed, key=lambda r: (r.doc_id, (r.text or "").encode())):
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        wanted.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in outs[4].collect()) == sorted(wanted)


def test_an_empty_table_runs_through(spark, tmp_path):
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").slice(0, 0)
    assert corpus_pipeline.run(spark, _tables(tmp_path, docs)).count() == 0
