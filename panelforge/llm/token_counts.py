"""Token counts of whole texts by the whole-token shortcut.

Before any text is read, every vocabulary string is encoded on its own; those that come back as the one
token they are, and that the pre-tokenizer leaves in one piece, are proven: a pre-token of a text that
equals one of them counts one, without a merge. Byte-level pre-tokens are merged one by one and
without regard to their neighbours, so what holds alone holds everywhere. Only the rest is merged.
"""

from __future__ import annotations

import itertools
import json
import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import give_back
from panelforge.llm.token_files import row_blocks

#: Fixed value: the pre-token pattern of byte-level vocabularies with use_regex.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that are looked at together: bounds what a very long text needs.
TOGETHER = 100_000
#: Bound on remembered counts of merged pre-tokens in a worker; longer pre-tokens are not remembered.
REMEMBERED, LONGEST = 500_000, 64

_state: dict = {}


class _Letters(dict):
    """Whether a character is one that Unicode 3.2 had not assigned, asked once for each.

    Two libraries may class later characters differently, so texts with any go to the tokenizer whole.
    A test compares all code points.
    """

    def __missing__(self, c: str) -> bool:
        self[c] = unsure = unicodedata.ucd_3_2_0.category(c) == "Cn"
        return unsure


class _Counter:
    """What a worker knows of one tokenizer: proven strings, the pattern, and remembered merges."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        said = json.loads(self.library.to_str())
        pre, added = said["pre_tokenizer"] or {}, said["added_tokens"]
        if said["model"]["type"] != "BPE" or said["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"{path} is no byte-level BPE without a normalizer")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} has added tokens that look at their neighbours")
        self.pattern, self.unsure, self.remembered = regex.compile(PRE_TOKEN), _Letters(), {}
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.whole = self.proven()

    def proven(self) -> frozenset[str]:
        """The vocabulary strings that are one pre-token and that the library encodes as one token."""
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        strings = {}
        for token, i in vocabulary.items():
            try:
                strings[i] = bytes(byte_of[c] for c in token).decode()
            except (UnicodeDecodeError, KeyError):
                continue
        ids = list(strings)
        alone = self.library.encode_batch_fast([strings[i] for i in ids], add_special_tokens=False)
        return frozenset(strings[i] for i, e in zip(ids, alone, strict=True) if e.ids == [i] and self.pattern.fullmatch(strings[i]) and self.pattern.match(strings[i]).end() == len(strings[i]))

    def count(self, text: str) -> int:
        """As many tokens as the library gives for the whole text, without begin or end tokens."""
        if not text.isascii() and any(map(self.unsure.__getitem__, set(text))):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        parts = self.special.split(text) if self.special else [text]
        n = len(parts) - 1
        for part in parts:
            found = self.pattern.finditer(part)
            while pieces := [m[0] for m in itertools.islice(found, TOGETHER)]:
                rest = [p for p in pieces if p not in self.whole]
                n += len(pieces) - len(rest) + self.merged(rest)
        return n

    def merged(self, pieces: list[str]) -> int:
        """Tokens of pre-tokens that are none themselves; what is new goes to the library in one batch."""
        known = self.remembered
        new = list({p for p in pieces if p not in known})
        lengths = dict(zip(new, (len(e.ids) for e in self.library.encode_batch_fast(new, add_special_tokens=False)), strict=True)) if new else {}
        n = sum(lengths[p] if p in lengths else known[p] for p in pieces)
        if len(known) + len(lengths) > REMEMBERED:
            known.clear()
        known.update((p, k) for p, k in lengths.items() if len(p) <= LONGEST)
        return n


def byte_letters() -> list[str]:
    """The character that spells each byte in a byte-level vocabulary: itself if printable, else one after U+00FF."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = itertools.count(256)
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def counter(path: str) -> _Counter:
    if path not in _state:
        _state[path] = _Counter(path)
    return _state[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in row_blocks(batch.column("text")):
                part = batch.slice(at, n)
                texts = part.column("text")
                counts = [counter(path).count(t) if t else 0 for t in texts.to_pylist()]
                sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
        give_back()

    return run


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    tokenizer is the path of a byte-level BPE in the tokenizers library's format; its added tokens
    count as the library takes them inside texts. Null and empty texts have no bytes and no tokens;
    repeated rows and null doc_ids stay; an empty table gives no rows; other columns are not read. A
    document is counted where it is read: nothing is shuffled.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = d.mapInArrow(_count(tokenizer), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
