"""Trees of hashes over files, against hashlib on the whole bytes."""

import hashlib
import random

import pytest

from panelforge.sources import hashtree


def _sha(x: bytes) -> bytes:
    return hashlib.sha256(x).digest()


def _root(data: bytes, fan: int) -> tuple[int, str]:
    runs = data.split(b"\n")
    if runs[-1] == b"":
        runs.pop()
    level = [_sha(r) for r in runs]
    while level:
        level = [_sha(b"".join(level[i : i + fan])) for i in range(0, len(level), fan)]
        if len(level) == 1:
            break
    top = level[0] if level else _sha(b"")
    return len(runs), hashlib.sha256(f"{len(data)}:{len(runs)}:".encode() + top).hexdigest()


def _dataset(roots: dict[str, str]) -> str:
    nodes: dict[str, list] = {}
    for name, root in sorted(roots.items()):
        nodes.setdefault(hashlib.sha256(name.encode()).hexdigest()[: hashtree.DEAL], []).append(_sha(f"{name}\n{root}".encode()))
    return _sha(b"".join(_sha(b"".join(x)) for _, x in sorted(nodes.items()))).hex()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, at = random.Random(5), tmp_path_factory.mktemp("tree")
    held = {
        "noise.bin": rng.randbytes(60_000),
        "feeds.txt": b"\n" * 700,
        "lines.csv": b"".join(b"%d,%d\r\n" % (i, i * i) for i in range(2_000)),
        "open end.txt": b"one\ntwo",
        "closed.txt": b"one\ntwo\n",
        "single": b"x",
        "bad utf8.txt": b"\xff\xfe\n\xc3\n\x00\x00\n",
    }
    for name, data in {**held, "empty.bin": b""}.items():  # an empty file is no row
        (at / name).write_bytes(data)
    return at, held


@pytest.mark.parametrize("fan", [2, 7, hashtree.FAN])
def test_roots_against_whole_files(spark, folder, fan):
    at, held = folder
    rows = hashtree.file_roots(spark, str(at), fan).collect()
    got = {r.file.rsplit("/", 1)[1].replace("%20", " "): (r.length, r.runs, r.root) for r in rows}
    assert got == {name: (len(data), *_root(data, fan)) for name, data in held.items()}


def test_split_files_keep_their_roots(spark, folder):
    """Blocks of 4 KB cut the files into dozens of tasks; every root stays."""
    at, held = folder
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = hashtree.snapshot_tree(spark, str(at), fan=16).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert {r.name.replace("%20", " "): r.root for r in rows} == {n: _root(d, 16)[1] for n, d in held.items()}
    assert {r.dataset_root for r in rows} == {_dataset({r.name: r.root for r in rows})}


def test_one_byte_or_name_changes_the_dataset(spark, tmp_path):
    def whole(**files):
        at = tmp_path / str(len(list(tmp_path.iterdir())))
        (at / "deep").mkdir(parents=True)
        for name, data in files.items():
            (at / "deep" / name).write_bytes(data)
        return hashtree.snapshot_tree(spark, str(at / "deep"), base=at.name).select("name", "dataset_root").distinct().collect()

    first, moved, other, renamed = whole(a=b"1\n2", b=b"3"), whole(a=b"1\n2", b=b"3"), whole(a=b"1\n2\n", b=b"3"), whole(a=b"1\n2", c=b"3")
    assert sorted(r.name for r in first) == ["deep/a", "deep/b"]
    assert first[0].dataset_root == moved[0].dataset_root
    assert len({first[0].dataset_root, other[0].dataset_root, renamed[0].dataset_root}) == 3


def test_a_node_needs_two_children(spark, tmp_path):
    with pytest.raises(ValueError):
        hashtree.file_roots(spark, str(tmp_path), 1)
