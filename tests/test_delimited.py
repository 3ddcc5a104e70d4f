"""Delimited files, held against the standard library's reader."""

import csv
import io
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.sources import delimited as D
from colloquy.sources import readers as R


def plain(text, separator="\t"):
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=separator) if r]


def found(spark, texts, separator="\t"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {i: [] for i in range(len(texts))}
    for r in D.records(D.raw_lines(df), separator).orderBy("doc_id", "record_no").collect():
        out[r["doc_id"]].append(r["cells"])
        assert r["record_no"] == len(out[r["doc_id"]])
    return [out[i] for i in range(len(texts))]


ODD = [
    "", "\n", "\n\n", "a", "a\tb\n", 'a\t"b\tc"\td\n', '"a\nb"\tc\n"d', '"x""y"\t""\t""""\n', 'a"b\tc"\n"d"e"f\tg\n', '"a"b"c\nd"\te\n',
    "a\r\nb\rc\n\r\nd", '"a\r\nb\rc"\td\r\n', "\t\t\n\t\n", " \n", '"\n"\n"\n', '"never\nclosed\tat all\n\n', '\x0b"a\x85b c"\x0b\n', '""\n""""\n"""\n"', 'é"\t"é\n"\n',
]


def test_odd_files(spark):
    assert found(spark, ODD) == [plain(t) for t in ODD]


def test_random_files(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choices(['"', '""', "\t", "\n", "\r\n", "\r", "a", "é", " ", "\x0b"], k=rng.randrange(60))) for _ in range(1500)]
    assert found(spark, texts) == [plain(t) for t in texts]


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.lists(st.text(alphabet='a",;\t\n\r\x0b b', max_size=6), min_size=1, max_size=5), max_size=6), min_size=1, max_size=40))
def test_what_a_writer_made_comes_back(spark, files):
    texts = []
    for rows in files:
        out = io.StringIO(newline="")
        csv.writer(out, delimiter=";", lineterminator="\n").writerows(rows)
        texts.append(out.getvalue())
    assert found(spark, texts, ";") == [plain(t, ";") for t in texts]


def manifest(spark, *texts):
    rows = [(f"/w/manifest_chunk_{chr(65 + i)}.tsv", t) for i, t in enumerate(texts)]
    return R.manifests_of(D.raw_lines(spark.createDataFrame(rows, "doc_id string, text string")))


def test_headers_with_repeated_empty_and_missing_names(spark):
    out = manifest(
        spark,
        "topic\ttopic\tblock_file\na\tb\tf\na\t\tf2\n",  # the last of a repeated name counts, filled or not
        "block_file\ttopic\t\t\nf\tx\ty\tz\n",  # two empty names
        "\t\n1\t2\n",
        "block_file\ttopic\nonly\nf\tx\ttoo\tmany\n\n\nlast\tone\n",
        "topic\ttitle\n \told\n",
    )
    rows = [(r["chunk_id"], r["row_no"], r["block_file"], r["topic"]) for r in out.orderBy("chunk_id", "row_no").collect()]
    assert rows == [
        ("A", 1, "f", "b"), ("A", 2, "f2", None), ("B", 1, "f", "x"), ("C", 1, None, None),
        ("D", 1, "only", None), ("D", 2, "f", "x"), ("D", 3, "last", "one"), ("E", 1, None, "old"),
    ]


@pytest.mark.parametrize("columns", [40, 200, 3000])
def test_many_columns(spark, columns):
    names = [f"c{k}" for k in range(columns)]
    names[columns // 2], names[-1] = "topic", "cases"
    cells = [f'"v\t{k}\n"' for k in range(columns)]
    out = manifest(spark, "\t".join(names) + "\n" + "\t".join(cells) + "\n" + "\t".join(["x"] * (columns // 2 + 1)) + "\n").orderBy("row_no").collect()
    assert [(r["topic"], r["cases"]) for r in out] == [(f"v\t{columns // 2}\n", f"v\t{columns - 1}\n"), ("x", None)]


def test_long_cells_with_many_quotes_and_lines(spark):
    text = '"' + 'say ""hi""\n' * 30_000 + '"\tend\n'
    ((cells,),) = found(spark, [text])
    assert [len(c) for c in cells] == [len('say "hi"\n') * 30_000, 3]


def test_as_dict_reader(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        header = rng.choices(["topic", "block_file", "names", "cases", "", "title"], k=rng.randrange(1, 6))
        rows = [[rng.choice(['x', 'two\nlines', 'a "q"', "", "t\tb"]) for _ in range(rng.randrange(1, 7))] for _ in range(5)]
        out = io.StringIO(newline="")
        csv.writer(out, delimiter="\t", lineterminator="\r\n").writerows([header, *rows])
        texts.append(out.getvalue())
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = D.by_name(D.raw_lines(df), {"topic": ("topic", "title"), "names": ("names",)}).select("doc_id", "row_no", "topic", "names")
    want = []
    for i, t in enumerate(texts):
        for k, row in enumerate(csv.DictReader(io.StringIO(t, newline=""), delimiter="\t"), 1):
            want.append((str(i), k, row.get("topic") or row.get("title") or None, row.get("names") or None))
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert got.filter(F.lit(False)).count() == 0
