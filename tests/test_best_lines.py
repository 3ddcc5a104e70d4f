"""The best line of a topic, against a plain search, and how many rows its joins make."""

import random
import re

import pytest

from colloquy.functions import text as X
from colloquy.operators import appendix as AP


def plain(topics, lines, tokens):
    out = {}
    for work, topic in topics:
        scores = [(-len(tokens[topic] & tokens[line]), pos, line) for w, pos, line in lines if w == work and tokens[topic] & tokens[line]]
        if scores:
            less, _, line = min(scores)
            out[work, topic] = (line, -less)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_topics(spark, seed):
    rng = random.Random(seed)
    words = ["common", "often", "often2"] * 6 + [f"word{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(words, k=rng.randrange(1, n)))
    lines = [(rng.choice(["v", "w"]), i, text(12)) for i in range(150)]
    topics = [(rng.choice(["v", "w"]), text(9)) for _ in range(60)] + [("v", "common"), ("w", "nowhere else"), ("w", "common often"), ("v", "")]
    t = spark.createDataFrame(topics + topics[:3], "work_id string, topic string")
    every = spark.createDataFrame([(x,) for x in {x for _, x in topics} | {x for *_, x in lines}], "text string")
    tokens = {r["text"]: set(r["tokens"]) for r in every.select("text", X.topic_tokens("text").alias("tokens")).collect()}
    got = {(r["work_id"], r["topic"]): (r["line"], r["score"]) for r in AP.best_lines(t, spark.createDataFrame(lines, "work_id string, pos long, line string")).collect()}
    assert got == plain(topics, lines, tokens)


def test_a_word_that_all_lines_share_is_not_joined(spark, monkeypatch):
    """5000 lines and 50 topics share a word: all pairs on tokens would be over 250,000 rows."""
    lines = spark.createDataFrame([("w", i, f"shared line number{i} filler{i % 7}") for i in range(5000)], "work_id string, pos long, line string")
    topics = spark.createDataFrame([("w", f"shared number{100 * i} filler{(100 * i) % 7}") for i in range(50)], "work_id string, topic string")
    sizes = {}
    kept = AP.kept
    monkeypatch.setattr(AP, "kept", lambda df, name: sizes.setdefault(name, kept(df, name)))
    found = AP.best_lines(topics, lines).collect()
    assert {(r["topic"].split()[1], re.sub("[^0-9]", "", r["line"].split()[2])) for r in found} == {(f"number{100 * i}", str(100 * i)) for i in range(50)}
    assert sizes["counts"].count() < 50_000


def test_words_that_most_lines_share_are_not_joined(spark, monkeypatch):
    """5000 lines and 50 topics share two words; a bound on the best score leaves only the rarest token of a topic."""
    lines = spark.createDataFrame([("w", i, f"shared also number{i} filler{i % 7}") for i in range(5000)], "work_id string, pos long, line string")
    topics = spark.createDataFrame([("w", f"also shared number{100 * i} filler{(100 * i) % 7}") for i in range(50)], "work_id string, topic string")
    sizes = {}
    kept = AP.kept
    monkeypatch.setattr(AP, "kept", lambda df, name: sizes.setdefault(name, kept(df, name)))
    found = {r["topic"].split()[2]: (r["line"].split()[2], r["score"]) for r in AP.best_lines(topics, lines).collect()}
    assert found == {f"number{100 * i}": (f"number{100 * i}", 4) for i in range(50)}
    assert sizes["counts"].count() < 10_000


def test_long_tokens_are_the_tokens_of_topics_but_for_stop_words(spark):
    rows = [("Это этого ЭТИМИ слово_слова abc abcd ab1 a1b2c3 éabcdé 12345-123",), (None,), ("",), ("abcd" * 50,)]
    got = spark.createDataFrame(rows, "t string").select(X.topic_tokens("t").alias("a"), X.long_tokens("t").alias("b")).collect()
    for r in got:
        assert r["a"] == [w for w in r["b"] if w not in ("этого", "этими")]
