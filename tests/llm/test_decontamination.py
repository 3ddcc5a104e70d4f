import random
import time

from pyspark.sql import functions as F

from colloquy.llm import decontamination as D
from colloquy.llm.common import table
from colloquy.llm.queries import op3_decontamination

ITEMS = "item_id long, text string"
DOCS = "doc_id long, text string"
W = [f"w{i}" for i in range(2000)]


def words(rng, n):
    return [rng.choice(W) for _ in range(n)]


def brute(doc, item, least):
    """Greedy tiling by trying all pairs of positions for every length."""
    marked_d, marked_i, out = set(), set(), []
    for length in range(len(item), least - 1, -1):
        for i in range(len(doc) - length + 1):
            for j in range(len(item) - length + 1):
                d, t = range(i, i + length), range(j, j + length)
                if doc[i : i + length] == item[j : j + length] and not marked_d & set(d) and not marked_i & set(t):
                    marked_d |= set(d)
                    marked_i |= set(t)
                    out.append(length)
    return sum(out)


def test_tiles_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        item = [rng.randint(1, 4) for _ in range(rng.randint(3, 12))]
        doc = [rng.randint(1, 4) for _ in range(rng.randint(0, 25))]
        tiles = D.tile(doc, item, 3)
        assert all(doc[i : i + n] == item[j : j + n] and n >= 3 for i, j, n in tiles)
        covered = [p for _, j, n in tiles for p in range(j, j + n)]
        assert len(covered) == len(set(covered)) == brute(doc, item, 3)


def test_planted_passages(spark):
    rng = random.Random(7)
    items = [(k, " ".join(words(rng, 40))) for k in range(20)]
    text = dict(items)
    filler = lambda: " ".join(words(rng, 120))
    half = lambda k: text[k].split()
    docs = [
        (1, f"{filler()} {text[3]} {filler()}"),
        (2, f"{filler()} {' '.join(half(4)[20:])} {filler()} {' '.join(half(4)[:20])}"),
        (3, text[5].upper().replace(" ", ", ")),
        (4, f"{filler()} {' '.join(half(6)[:12])} {filler()}"),
        (5, filler()),
        (6, None),
        (7, ""),
        (8, f"{text[8]} {text[9]} {text[8]}"),
        (8, f"{text[8]} {text[9]} {text[8]}"),
    ]
    d = spark.createDataFrame(docs, DOCS).withColumn("found", F.lit("x"))
    b = spark.createDataFrame([*items, (98, None), (99, ""), (100, "w1 w2")], ITEMS).withColumn("doc_id", F.lit(1))
    want = [(1, 3, 1, 40), (2, 4, 2, 40), (3, 5, 1, 40), (8, 8, 1, 40), (8, 8, 1, 40), (8, 9, 1, 40), (8, 9, 1, 40)]
    for block in (D.BLOCK_SEEDS, 90):  # in one block and in several
        rows = D.matches(d, b, block_seeds=block).filter("item_id < 98").collect()
        assert sorted((r["doc_id"], r["item_id"], r["n_tiles"], r["covered_words"]) for r in rows) == want
    kept = D.clean(d, b.filter("item_id < 98"), block_seeds=90)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 7]


def test_short_items_are_found_whole(spark):
    b = spark.createDataFrame([(1, "Alpha beta!")], ITEMS)
    d = spark.createDataFrame([(1, "x alpha, BETA y"), (2, "alpha y beta")], DOCS)
    assert [r["doc_id"] for r in D.matches(d, b).collect()] == [1]


def test_empty_tables_and_very_long_texts(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "a b c d e f " * 60_000)], DOCS)
    assert D.matches(none, items).count() == D.matches(one, items).count() == 0
    assert D.clean(one, items).count() == 1
    assert D.matches(one, spark.createDataFrame([(1, "a b c d e f a b")], ITEMS)).first()["coverage"] == 1.0


def plain_matches(docs, items):
    """Every document against every item: greedy tiling by its definition, longest runs first, then first in the document."""
    out = []
    for doc_id, text in docs:
        doc = D.words_of(text)
        for item_id, item_text in items:
            item = D.words_of(item_text)
            least = min(D.MIN_MATCH, len(item))
            grams = {tuple(item[j : j + least]) for j in range(len(item) - least + 1)}
            if not item or not any(tuple(doc[i : i + least]) in grams for i in range(len(doc) - least + 1)):
                continue
            marked_d, marked_i, tiles = set(), set(), []
            for length in range(len(item), least - 1, -1):
                places = {}
                for j in range(len(item) - length + 1):
                    places.setdefault(tuple(item[j : j + length]), []).append(j)
                for i in range(len(doc) - length + 1):
                    for j in places.get(tuple(doc[i : i + length]), ()):
                        d, t = set(range(i, i + length)), set(range(j, j + length))
                        if not marked_d & d and not marked_i & t:
                            marked_d |= d
                            marked_i |= t
                            tiles.append(length)
            if sum(tiles) >= D.COVERAGE * len(item):
                out.append((doc_id, item_id, len(tiles), sum(tiles), len(item)))
    return sorted(out)


def rows_of(found):
    return sorted((r["doc_id"], r["item_id"], r["n_tiles"], r["covered_words"], r["item_words"]) for r in found.collect())


def test_query_against_all_pairs(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = plain_matches([tuple(r) for r in d.select("doc_id", "text").collect()], [tuple(r) for r in b.select("item_id", "text").collect()])
    assert want and rows_of(op3_decontamination(spark, sf_dir)) == want
    assert rows_of(D.matches(d, b, block_seeds=3000)) == want
    gone = {r[0] for r in want}
    for block in (D.BLOCK_SEEDS, 3000):
        assert {r["doc_id"] for r in D.clean(d, b, block_seeds=block).select("doc_id").collect()} == {r["doc_id"] for r in d.select("doc_id").collect()} - gone


def test_random_texts_of_few_words_against_all_pairs(spark):
    rng = random.Random(21)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(rng.randint(0, n)))
    docs, items = [(i, text(60)) for i in range(60)], [(i, text(24)) for i in range(40)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = plain_matches(docs, items)
    assert len(want) > 100
    for block in (D.BLOCK_SEEDS, 100):
        assert rows_of(D.matches(d, b, block_seeds=block)) == want


def test_a_stem_of_twenty_thousand_items():
    rng = random.Random(22)
    stem = words(rng, 9)
    items = [(k, [w.encode() for w in [*stem, *words(rng, 20)]]) for k in range(20_000)] + [(k, [w.encode() for w in [*stem, f"x{k}"]]) for k in range(20_000, 40_000)]
    index, ids = D.Index(items), D.Ids()
    array = lambda w: ids.array([x.encode() for x in w])
    start = time.process_time()
    for doc in (stem * 160, stem, [*words(rng, 500), *stem, *words(rng, 500)]):
        found = D.judged(index, array(doc))
        assert [m[0] for m in found] == list(range(20_000, 40_000)) and {m[1:] for m in found} == {(1, 9, 10)}
    assert time.process_time() - start < 10
    start = time.process_time()
    index = D.Index(items[:20_000])
    for k in range(200):  # a common stem alone is too little of any item
        assert D.judged(index, array([*words(rng, 300), *stem])) == []
    assert time.process_time() - start < 5
    whole = D.judged(index, array([*words(rng, 50), *[w.decode() for w in items[7][1]], *words(rng, 50)]))
    assert [(m[0], m[2]) for m in whole] == [(7, 29)]


def test_one_word_over_and_over():
    index, ids = D.Index([(1, [b"a"] * 40), (2, [b"a"] * 20 + [b"b"] * 20)]), D.Ids()
    start = time.process_time()
    assert [(m[0], m[2]) for m in D.judged(index, ids.array([b"a"] * 300_000))] == [(1, 40), (2, 20)]
    assert time.process_time() - start < 20
