"""Periodic runs: against a plain search of every lag, the query against a plain version, odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import periodic_runs
from colloquy.llm.common import table
from colloquy.llm.queries import op11_periodic_runs


def plain_runs(words):
    """Every maximal stretch of every lag, smallest lag first."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((start, length, q) for (start, length), q in found.items()), key=lambda r: (r[0], r[2]))


def ids(words):
    return periodic_runs.numbered([str(w).encode() for w in words])


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9), st.integers(0, 200), st.sampled_from([1, 2, 3, 20]))
def test_runs_equal_a_plain_search(seed, n, vocabulary):
    rng = random.Random(seed)
    words = [rng.randrange(vocabulary) for _ in range(n)]
    for _ in range(rng.randrange(4) if n else 0):
        a, p, most = rng.randrange(n), rng.randint(1, 20), rng.randint(0, 120)
        for i in range(a, min(n, a + most)):
            words[i] = words[a + (i - a) % p]
    assert periodic_runs.runs_of(ids(words)) == plain_runs(words)


def test_counts_of_heavy_and_light_words():
    rng = np.random.default_rng(5)
    words = rng.zipf(1.3, 6000) % 400
    counts = periodic_runs.lag_counts(ids(words.tolist()))
    assert all(counts[q] == (words[:-q] == words[q:]).sum() for q in range(1, 2001))


def test_long_texts_with_probed_islands():
    rng = np.random.default_rng(6)
    words = rng.integers(0, 60, 9000)
    words[1000:3000] = words[1000 + np.arange(2000) % 400]  # five periods
    words[5000:8000] = words[5000 + np.arange(3000) % 7]
    words[8100:8500] = words[8100 + np.arange(400) % 200]  # two periods: no run
    words = words.tolist()
    found = periodic_runs.runs_of(ids(words))
    assert [(s // 10, q) for s, _, q in found] == [(100, 400), (500, 7)] or [q for *_, q in found] == [400, 7]
    assert found == plain_runs(words)


def test_strongest_by_exact_exponent():
    assert periodic_runs.strongest([(5, 30, 10), (0, 27, 9), (40, 24, 8)]) == (0, 27, 9)
    assert periodic_runs.strongest([(0, 30, 10), (0, 24, 8)]) == (0, 24, 8)
    assert periodic_runs.strongest([]) is None


def test_odd_rows(spark):
    rows = [(None, None, 1), (1, "", 2), (2, " \t\n ", 3), (3, "a " * 24, 4), (3, "a " * 24, 4), (4, "a " * 23, 5), (5, "é b " * 30, 6), (6, "x y " * 60000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    out = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert out[None].runs == [] and out[None].collapsed == "" and out[None].n_words == 0 and out[None].strongest is None
    assert out[1].runs == out[2].runs == out[4].runs == []
    assert [tuple(r) for r in out[3].runs] == [(0, 24, 1)] and out[3].collapsed == "a"
    assert tuple(out[5].strongest) == (0, 30, 1) and out[5].collapsed == "é b"
    assert tuple(out[6].strongest) == (0, 120000, 2) and out[6].collapsed == "x y"
    assert periodic_runs.periodic_runs(docs).count() == len(rows)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_the_query_against_a_plain_version(spark, sf_dir):
    found = {r.doc_id: tuple(r)[1:] for r in op11_periodic_runs(spark, sf_dir).collect()}
    docs = table(spark, sf_dir, "documents").collect()
    assert len(found) == len(docs)
    planted = 0
    for doc in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", doc.text or "")
        n, h = len(words), zlib.crc32(str(doc.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            planted += 1
        if n > 1200:  # the plain search takes n * n steps
            continue
        runs = plain_runs(words)
        gone = {i for start, length, q in runs for i in range(start + q, start + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        expected = (
            len(runs),
            *best,
            1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
        )
        assert found[doc.doc_id] == expected, doc.doc_id
    assert planted > 5
