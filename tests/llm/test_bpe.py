import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import bpe
from colloquy.llm.common import table
from colloquy.llm.queries import op2_bpe

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
MODEL = bpe.Model(open(PATH, "rb").read())
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aaabcdehinorst'’0129 .,!?-\n\t\x1c\x85  ΣσςéÉéİßﬁ中文😀👍<|>endoftext_", max_size=60))
def test_encodes_like_the_library(text):
    flat, starts = MODEL.encode([text, None, text])
    assert flat[starts[0] : starts[1]].tolist() == ids(text) == flat[starts[2] : starts[3]].tolist()
    assert starts[1] == starts[2]


def test_every_code_point_is_read_as_the_library_reads_it():
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    odd = {c for r in (bpe.NO_LETTERS, bpe.NO_NUMBERS, bpe.UNKNOWN_MARKS, bpe.NEW_CAPITALS, bpe.THEIR_SMALL) for c in bpe.code_points(r)}
    plain = [c for c in every if c not in odd]
    for at in range(0, len(plain), 50_021):  # a stretch of each 50,021 code points; all of them agreed when the ranges were made
        text = " ".join(f"a{chr(c)}b 1{chr(c)}!" for c in plain[at : at + 3000])
        assert MODEL.encode([text])[0].tolist() == ids(text)
    for c in sorted(odd)[:: 7]:
        text = f"a{chr(c)}b 1{chr(c)}! {chr(c)}{chr(c)}a\u0301{chr(c)}\u0323"
        assert MODEL.encode([text])[0].tolist() == ids(text), hex(c)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([chr(c) for r in (bpe.UNKNOWN_MARKS, bpe.NEW_CAPITALS) for c in bpe.code_points(r)] + list("ae1Σ \u0301\u0323\u0327\u0345") + [chr(0x11935), chr(0x11938), chr(0x1100), chr(0x1161), chr(0x11A8)]), max_size=12))
def test_marks_and_capitals_of_newer_unicode(chars):
    text = "".join(chars)
    assert MODEL.encode([text])[0].tolist() == ids(text)


def test_long_words_and_runs():
    rng = random.Random(2)
    for text in ("a" * 5000, "ha" * 3000, "abc" * 70_000, "".join(rng.choice("abcdeintro") for _ in range(20_000)), "!" * 999, "é" * 500, "<|endoftext|>" * 3 + "x<|startoftext|>"):
        assert MODEL.encode([text])[0].tolist() == ids(text)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    monkeypatch.setattr(bpe, "MOST_STATES", 2)
    for text in ("one two three four five", "five four three two one", "one one six"):
        assert MODEL.encode([text])[0].tolist() == ids(text)


def test_columns_nulls_and_clashes(spark):
    df = spark.createDataFrame([(1, "Hello  world", "k"), (2, None, "k"), (3, "", None), (1, "Hello  world", "k")], "doc_id long, text string, _needs_0 string")
    coded = bpe.encode(df, PATH)
    got = sorted((r["doc_id"], r["ids"]) for r in coded.collect())
    assert got == [(1, ids("hello world"))] * 2 + [(2, []), (3, [])]
    back = bpe.decode(coded.withColumn("decoded", F.lit("old")), PATH)
    assert {r["doc_id"]: r["decoded"] for r in back.collect()} == {1: LIBRARY.decode(ids("hello world"), skip_special_tokens=False), 2: "", 3: ""}
    odd = spark.createDataFrame([([320, None, 10**6, -5, 518],), (None,)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd, PATH).collect()] == ["a</w> the</w>", ""]
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_query_against_the_library(spark, sf_dir):
    import hashlib

    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    rows = op2_bpe(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = ids(docs[r["doc_id"]] or "")
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        bpe.Model(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())
