"""Collocations: against a plain count of everything, the hash levels and their filters, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import collocations


def plain(rows, min_count, most_words, top):
    """The collocations of (text, lang) rows, by counting every phrase in dictionaries."""
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        kept = []
        for p, a in candidates.items():
            inside = [b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= 80 * a for b in inside):
                continue
            score, _, left, right = min((2_000_000 * a // (counts[p[:c]] + counts[p[c:]]), c, counts[p[:c]], counts[p[c:]]) for c in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "γάμμα", "delta", "É", "é", "x\x00y", "　", "\x1c", "\x1f\x85", "\xa0", "of", "the", "the", "the"]
    phrase = ["alpha beta γάμμα delta", "of the É", "\tthe\t the"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", ";", "!?", "\x0b", "\x0c"]
    out = []
    for _ in range(n):
        text = "".join((rng.choice(phrase) if rng.random() < 0.2 else rng.choice(words)) + rng.choice(marks) for _ in range(rng.randrange(40)))
        out.append((rng.choice([text, text, text, None, ""]) if rng.random() < 0.1 else text, rng.choice(["en", "en", "en", "de", None])))
    return out


@pytest.mark.parametrize(("seed", "min_count", "top"), [(1, 3, 2000), (2, 8, 7)])
def test_equal_to_counting_everything(spark, seed, min_count, top):
    rows = texts(seed)
    want = plain(rows, min_count, 4, top)
    assert {len(r[2].split(" ")) for r in want} >= {2, 3} and {r[0] for r in want} >= {"en", "und"}
    docs = spark.createDataFrame([(t, g, 1) for t, g in rows], "text string, lang string, f int").repartition(3)
    got = collocations.mine(docs, min_count=min_count, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == want


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    rows = texts(3)
    monkeypatch.setattr(collocations, "FILTER_BYTES", 8)  # nearly every hash seems to be in it
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, collocations.mine(docs, min_count=4).collect())) == plain(rows, 4, 4, 2000)


def test_filter_holds_its_hashes(spark):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    found = collocations.filter_of(spark.createDataFrame([(int(h),) for h in hashes], "h long")).value
    assert found.has(hashes.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 2**64, 100_000, np.uint64)
    assert found.has(others).mean() < 0.03
    assert not collocations.filter_of(spark.createDataFrame([], "h long")).value.has(others).any()


def test_exact_scores_beyond_64_bits(spark):
    big = 5_000_000_000_000
    rows = [("en", "a", 1, 2 * big + 1), ("en", "b", 1, 3 * big), ("en", "a b", 2, big + 3)]
    out = collocations.scored(spark.createDataFrame(rows, "group string, phrase string, k int, f long")).collect()
    assert [(r.l, r.r, r.score) for r in out] == [(2 * big + 1, 3 * big, 2_000_000 * (big + 3) // (5 * big + 1))]


def test_ties_and_cuts(spark):
    rows = [("en", p, len(p.split()), f) for p, f in [("a", 40), ("b", 40), ("c", 40), ("a b", 40), ("b c", 40), ("a b c", 40)]]
    levels = spark.createDataFrame(rows, "group string, phrase string, k int, f long")
    out = {r.phrase: tuple(r)[2:] for r in collocations.scored(levels).collect()}
    assert out == {"a b": (40, 40, 40, 1_000_000), "b c": (40, 40, 40, 1_000_000), "a b c": (40, 40, 40, 1_000_000)}
    assert {(r.phrase, r.longer) for r in collocations.absorbing(levels).collect()} == {("a b", 40), ("b c", 40)}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "en"), ("", None), (" .;\t\n", "de"), ("rare words", "en")], "text string, lang string")
    assert collocations.mine(docs).count() == 0
    assert collocations.mine(docs.limit(0)).count() == 0
    same = spark.createDataFrame([("New York " * 20000, None), ("new york.", None), ("new york.", None)], "text string, lang string")
    out = collocations.mine(same).collect()
    assert {r.lang for r in out} == {"und"} and {r.n for r in out} == {40004}
    assert sorted(map(tuple, out)) == plain([tuple(r) for r in same.collect()], 30, 4, 2000)


def test_phrases_that_share_a_hash_stay_apart():
    own = collocations.Coded("en", [b"a b a b c a b a c b a b" * 3])
    for k in (1, 2, 3):
        at = np.flatnonzero(own.whole(k))
        want = Counter(tuple(own.numbers[i : i + k].tolist()) for i in at.tolist())
        for hashes in (own.grams(own.ids(), k)[at], np.zeros(len(at), np.uint64), own.grams(own.ids(), k)[at] % np.uint64(2)):
            first, n = collocations.distinct(own, at, hashes, k)
            assert {tuple(own.numbers[i : i + k].tolist()): c for i, c in zip(first.tolist(), n.tolist(), strict=True)} == want
        rows = own.phrases(first, n, k).to_pylist()
        assert {r["phrase"]: r["f"] for r in rows} == {" ".join(own.words[i].as_py() for i in g): c for g, c in want.items()}


def test_hashes_of_words_differ():
    import pyarrow as pa

    words = [f"{c}{i}" for i in range(20_000) for c in ("", "a", "é")] + ["", "a", "aa", "aaa", "ab", "ba"]
    found = collocations.word_hashes(pa.array(words, pa.large_string()))
    assert len(set(found.tolist())) == len(set(words))
    assert (collocations.word_hashes(pa.array(words, pa.large_string())[100:300]) == found[100:300]).all()
