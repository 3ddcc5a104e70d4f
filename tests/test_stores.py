"""Ranges of lines, hashes and copies of files, held against whole texts."""

import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from colloquy.sources import readers as R
from colloquy.sources import stores as S

ENDS = [b"\n", b"\r\n", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\xc2\x85", b"\xe2\x80\xa8", b"\xe2\x80\xa9"]


def odd_bytes(seed, n):
    """Lines of every end, some empty or long, characters of two to four bytes, and bytes that aren't UTF-8."""
    rng = random.Random(seed)
    parts = [b"a", b"word ", "é".encode(), "€".encode(), "😀".encode(), b"\xff", b"\xe2\x80", b"\xc2", b"\x80", b"\x85", *ENDS]
    return b"".join(rng.choices(parts, k=n)) + (rng.choice(ENDS) if seed % 2 else b"x")


def plain_lines(data):
    """By a plain walk over the bytes."""
    out, start, i = [], 0, 0
    while i < len(data):
        end = next((e for e in (b"\r\n", *ENDS) if data.startswith(e, i)), None)
        if end:
            out.append(data[start:i])
            i = start = i + len(end)
        else:
            i += 1
    return out + ([data[start:]] if start < len(data) else [])


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_ranges_hold_each_line_once(block):
    for seed in range(60):
        data = odd_bytes(seed, 80)
        want = plain_lines(data)
        for size in (1, 2, 3, 7, 8, 50, 10_000):
            file = io.BytesIO(data)
            got = [line for start in range(0, len(data), size) for line in S.owned_lines(file, start, min(start + size, len(data)), block)]
            assert got == want, (seed, size)


def test_a_long_line_is_read_in_blocks():
    data = b"a" * 3_000_000 + b"\r\n" + b"b" * 10
    assert [len(x) for x in S.owned_lines(io.BytesIO(data), 0, len(data), 1000)] == [3_000_000, 10]


@pytest.fixture
def folder(tmp_path):
    top = tmp_path / "in"
    (top / "sub").mkdir(parents=True)
    (top / "a.txt").write_bytes(odd_bytes(1, 900))
    (top / "sub" / "b.txt").write_bytes(odd_bytes(2, 400))
    (top / "empty.txt").write_bytes(b"")
    (top / "one.md").write_bytes("последняя".encode())
    (top / "_SUCCESS").write_bytes(b"")
    return top


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_same_rows_as_the_reader_of_whole_files(spark, folder, size):
    key = lambda df: sorted((r["doc_id"].split("/in/")[1], r["line_no"], r["text"]) for r in df.collect())
    want = key(R.read_lines(spark, f"{folder}/*.*")) + key(R.read_lines(spark, f"{folder}/sub"))
    got = S.read_line_ranges(spark, str(folder), size)
    assert key(got) == sorted(want)
    assert key(S.read_line_ranges(spark, f"file://{folder}/one.md", size)) == [("one.md", 1, "последняя")]


def test_small_ranges_share_a_task(folder, monkeypatch):
    pieces = [p for part in S.LineRangeReader(str(folder), 64).partitions() for p in part.pieces]
    assert len(pieces) > 10 and len(S.LineRangeReader(str(folder), 64).partitions()) == 1
    monkeypatch.setattr(S, "TASK_BYTES", 200)
    parts = [p.pieces for p in S.LineRangeReader(str(folder), 64).partitions()]
    assert [p for part in parts for p in part] == pieces and all(sum(b - a for _, a, b in part) <= 200 for part in parts)
    assert S.LineRangeReader(str(folder / "empty.txt"), 64).partitions()[0].pieces == []


def test_hashes_and_copies(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 13)
    files = [p for p in folder.iterdir() if p.is_file() and p.name[0] != "_" and p.stat().st_size]  # Spark's listing leaves out empty files
    want = {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in files}
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in S.file_hashes(spark, str(folder)).collect()}
    assert got == want
    assert S.file_hashes(spark, str(folder), (".md",)).count() == 1
    assert {r["path"]: r["sha256"] for r in S.file_hashes(spark, str(folder)).collect()} == {r["path"]: r["sha256"] for r in R.file_hashes(spark, f"{folder}/*.*").collect()}
    listed = R.list_files(spark, str(folder), (".txt",))
    todo = listed.select("path", F.concat(F.lit(f"file://{tmp_path}/out/x/"), F.regexp_extract("path", "([^/]*)$", 1)).alias("target"))
    for _ in range(2):  # a second run copies again
        rows = S.copy_files(todo).collect()
        assert {r["target"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in rows} == {k: v for k, v in want.items() if k.endswith(".txt")}
        assert sorted(p.name for p in (tmp_path / "out" / "x").iterdir()) == ["a.txt"]
        assert (tmp_path / "out" / "x" / "a.txt").read_bytes() == (folder / "a.txt").read_bytes()


def test_a_failed_copy_leaves_nothing(tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"x" * 100)

    def broken(path):
        yield b"x" * 10
        raise OSError("lost")

    monkeypatch.setattr(S, "blocks", broken)
    with pytest.raises(OSError):
        S.copied(str(tmp_path / "a"), str(tmp_path / "out" / "b"))
    assert list((tmp_path / "out").iterdir()) == []
