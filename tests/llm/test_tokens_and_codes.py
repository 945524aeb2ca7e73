"""Operators 11 to 13 against plain loops over the libraries, and their edge cases."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelforge.llm import alignment, language_id, token_counts, token_files, vector_codes
from panelforge.llm.queries import oracle_sql

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens long, head string, batch int"
ODD = ["", " ", "\n\n a\t", "a▁b", "before <|endoftext|> after<|endoftext|>", "<s> x</s> <unk> <0x41>", "\x00a", "½ ² Ⅷ ﬁ é", "漢字かな交じり文", "՘x \U0001e6c0", "\xa0 　x", "don't 'S we'll", "a" * 5000, "\r\n\r\n  x  \n", "👩‍👩‍👧 🏳️‍🌈"]
ROWS = [(1, "the cat sat on the mat", 1, "h", 1), (2, None, None, None, None), (None, "x", 1, "h", 1), (3, "the cat sat on the mat", 1, "h", 1), (3, "the cat sat on the mat", 1, "h", 1), *[(10 + i, t, 1, "h", 1) for i, t in enumerate(ODD)], (99, "le chat l'été 1234 " * 20_000, 1, "h", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain_alignment(rows):
    """{row number: (groups, links)} by a loop over ends, and all counts."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {c: i for i, c in enumerate(token_counts.byte_letters())}
    out, counts = [], Counter()
    for _, text in rows:
        if not text:
            out.append(None)
            continue
        side_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        side_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (side_a, side_b)):
            out.append(None)
            continue
        ends = []
        for side in (side_a, side_b):
            at, mine = 0, {}
            for i, x in side:
                at += len(x)
                mine[at] = i
            ends.append(mine)
        links = [(ends[0][e], ends[1][e]) for e in sorted(ends[0].keys() & ends[1].keys())]
        cuts, written = sorted(ends[0].keys() & ends[1].keys()), []
        for mine in ends:
            parts, cut = defaultdict(list), iter(cuts)
            edge = next(cut)
            for e in sorted(mine):
                while e > edge:
                    edge = next(cut)
                parts[edge].append(str(mine[e]))
            written.append(parts)
        counts.update(links)
        out.append((";".join(",".join(written[0][c]) + "|" + ",".join(written[1][c]) for c in cuts), links, len(side_a), len(side_b)))
    return out, counts


def test_alignment_against_plain_loops(spark, docs, small, monkeypatch):
    both = docs.select("doc_id", "text").unionByName(small.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in both.collect()]
    found, counts = plain_alignment(rows)
    most = Counter()
    for (a, b), n in counts.items():
        most[b] = max(most[b], n)
    wanted = Counter()
    for (doc_id, _), x in zip(rows, found, strict=True):
        if x is None:
            wanted[doc_id, 0, 0, 0, 0, 0, 0, ""] += 1
        else:
            best, total = sum(counts[p] == most[p[1]] for p in x[1]), sum(counts[p] for p in x[1])
            wanted[doc_id, x[2], x[3], len(x[1]), len(x[1]), best, total, hashlib.sha256(x[0].encode()).hexdigest()] += 1
    assert sum(x is None for x in found) >= 3
    for batch, group, fan in ((20_000, 60_000, 3), (16_000_000, 128_000_000, 32)):
        for name, size in (("BATCH_BYTES", batch), ("GROUP_BYTES", group), ("FAN", fan)):
            monkeypatch.setattr(alignment, name, size)
        assert Counter(map(tuple, alignment.align(both, A, B, digests=True).collect())) == wanted
    pairs = {(r.a, r.b): (r.n, r.best) for r in alignment.pair_counts(both, A, B).collect()}
    assert pairs == {p: (n, n == most[p[1]]) for p, n in counts.items()}
    texts = {r.doc_id: r.groups for r in alignment.align(docs, A, B).collect()}
    assert texts[1].count("|") == texts[1].count(";") + 1 and texts[2] == ""
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_token_counts_against_the_library(spark, docs, small):
    library = Tokenizer.from_file(A)
    both = docs.select("doc_id", "text").unionByName(small.select("doc_id", "text"))
    rows = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in both.collect())
    found = token_counts.count_tokens(both, A, limit=100).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == rows
    assert all(r.over_limit == (r.n_tokens > 100) for r in found) and {r.over_limit for r in found} == {True, False}
    assert token_counts.count_tokens(docs.limit(0), A).count() == 0
    assert token_counts.count_tokens(docs, A).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_token_counts_of_odd_strings():
    library, own, rng = Tokenizer.from_file(A), token_counts.counter(A), random.Random(5)
    letters = [chr(c) for c in range(0x250)] + list("漢あ 　​﻿½²Ⅷ́՘\U0001f469‍ '’") + ["'ll", "<|endoftext|>", "<|", "  ", "\n\n", " the", "ing"]
    for _ in range(5000):
        text = "".join(rng.choices(letters, k=rng.randrange(1, 30)))
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    assert 45_000 < len(own.whole) < 50_257
    assert all(library.encode(w, add_special_tokens=False).tokens[0] for w in list(own.whole)[:100])


def test_letters_are_classed_as_the_library_does():
    """Every code point between letters, digits and marks: the pattern cuts where the library cuts, or the text goes to it whole."""
    library, own = Tokenizer.from_file(A), token_counts.counter(A)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not own.unsure[chr(c)]]
    for at in range(0, len(points), 20_000):
        text = "".join(f"\n\na{chr(c)}1{chr(c)}!{chr(c)}\n\n" for c in points[at : at + 20_000])
        assert [o for _, o in library.pre_tokenizer.pre_tokenize_str(text)] == [m.span() for m in own.pattern.finditer(text)]


def test_special_strings_in_token_files():
    library = Tokenizer.from_file(A)
    texts = [*ODD, "<|endoftext|>", "x<|endoftext|>y z"]
    for plain in (True, False):
        library.encode_special_tokens = plain
        found = token_files.encode_texts([t.encode() for t in texts], A, plain)
        assert [x.tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def plain_codes(rows):
    """Codes, errors and codebooks by direct distances."""
    x = np.array([np.floor(np.array(v, np.float64) * 4096) for _, v, _ in rows]).astype(np.int64)
    ids = [r[0] for r in rows]
    cut = x.reshape(len(x), 8, -1)
    order = sorted(range(len(rows)), key=lambda i: (ids[i] is None, ids[i] or 0, rows[i][1]))[:16]
    books = cut[order].transpose(1, 0, 2).copy()
    for turn in range(7):
        distance = ((cut[:, :, None, :] - books[None]) ** 2).sum(-1)
        best = distance.argmin(2)
        if turn < 6:
            for p in range(8):
                for e in range(books.shape[1]):
                    mine = cut[best[:, p] == e, p]
                    if len(mine):
                        books[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    error = distance.min(2).sum(1)
    by_label = Counter()
    for (_, _, label), e in zip(rows, error.tolist(), strict=True):
        by_label[label] += e
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return Counter((i, "".join(f"{k:02x}" for k in b), e, by_label[r[2]], sha) for i, b, e, r in zip(ids, best.tolist(), error.tolist(), rows, strict=True))


def test_vector_codes_against_direct_distances(spark, sf_dir, monkeypatch):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", "embedding", "label").collect()]
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 90)
    assert Counter(map(tuple, vector_codes.codes(table).collect())) == plain_codes(rows)
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert Counter(con.execute(oracle_sql()["op12_vector_codes"]).fetchall()) == plain_codes(rows)


def test_vector_codes_at_the_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, code string, n int"
    good = [(i, [float((i * 7 + j * 3) % 11) / 4 - 1 for j in range(16)], None if i % 3 == 0 else i % 3, "c", 1) for i in range(40)]
    bad = [(50, None, 1, "c", 1), (51, [], 1, "c", 1), (52, [float("nan")] * 16, 1, "c", 1), (53, [float("inf")] * 16, 1, None, None), (-54, [1.0] * 15 + [None], 1, "c", 1), (55, [1.0] * 8, 1, "c", 1), (56, [1.0] * 17, 1, "c", 1)]
    more = [(None, [0.5] * 16, 7, "c", 1), (7, good[7][1], 1, "c", 1)]
    df = spark.createDataFrame(good + bad + more, schema)
    found = vector_codes.codes(df)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, found.collect())) == plain_codes([r[:3] for r in good + more])
    few = spark.createDataFrame(good[:5] + bad, schema)
    assert Counter(map(tuple, vector_codes.codes(few).collect())) == plain_codes([r[:3] for r in good[:5]])
    assert vector_codes.codes(df.limit(0)).count() == 0 and vector_codes.codes(spark.createDataFrame(bad[:5], schema)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.whole_numbers(np.array([[1e9] * 16]))


def test_a_language_needs_a_letter():
    net = language_id.train(["the cat sat " * 20, "die katze sass " * 20], ["en", "de"])
    names = [name for name, _ in net.predict(["½ ²", "Ⅷ", "12 _ -- 漢".replace("漢", ""), "a", "漢", None, ""])]
    assert names[:3] == ["und"] * 3 and "und" not in names[3:5] and names[5:] == ["und"] * 2
