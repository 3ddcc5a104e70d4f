import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import near_duplicates as N
from colloquy.llm.components import components

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed=4, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))
    docs = []
    for i in range(n):
        base = [word() for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            docs.append((len(docs) * 3 + 1, rng.choice([" ", "\n", "\t "]).join(copy if rng.random() < 0.8 else [w.upper() for w in copy])))
    return docs


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_against_brute_force(spark):
    docs = corpus()
    out = N.near_duplicates(spark.createDataFrame(docs, SCHEMA))
    assert result(out) == brute(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "SET_BLOCK", 3)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(60):
        copy = list(base)
        for k in rng.sample(range(200), rng.randint(0, 8)):
            copy[k] = f"x{rng.random()}"
        docs.append((i, " ".join(copy)))
    assert result(N.near_duplicates(spark.createDataFrame(docs, SCHEMA))) == brute(docs)


def test_nulls_empties_repeats_clashes(spark):
    docs = [(5, "a b c d e f"), (5, "a b c d e f"), (9, "A  b c d e\nf"), (2, None), (3, ""), (4, " \n"), (7, "one two"), (8, "ONE two"), (None, "a b c d e f")]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("signature", F.lit("x")).withColumn("node", F.lit(0))
    rows = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(df).collect()), key=str)
    want = [(False, 5, 2, 5, True)] * 2 + [(False, 9, 2, 5, False), (False, 2, 0, 2, True), (False, 3, 0, 3, True), (False, 4, 0, 4, True), (False, 7, 1, 7, True), (False, 8, 1, 7, False), (True, 0, 2, None, True)]
    assert rows == sorted(want, key=str)
    kept = N.keep(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 4, 5, 7]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 2000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:1600], rng.integers(0, 2**63, 400).astype(np.uint64)]))
    s = N.signatures([a, b, a])
    assert (s[0] == s[2]).all() and abs((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12


def test_links_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(30)]
    common = N.intersections(sets)
    for i, j in combinations(range(30), 2):
        assert common[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(200, 200 + i) for i in range(1, 40)]
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
