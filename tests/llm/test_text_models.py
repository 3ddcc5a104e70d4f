"""Language ID, quality model, quality rules and licenses."""

import random
import re
import zlib

import numpy as np
import xxhash
import zstandard
from pyspark.sql import functions as F

from colloquy.llm import language_id as LI
from colloquy.llm import licenses as LC
from colloquy.llm import quality_model as QM
from colloquy.llm import quality_rules as QR
from colloquy.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], SCHEMA)


# Language ID


def test_language_held_out_accuracy(spark):
    d = table(spark, SF, "documents")
    rows = LI.identify(d).join(d.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    d = table(spark, SF, "documents")
    odd = docs(spark, None, "", "123 !? 45", "\n\t", "x" * 500_000, "é").withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("lang", F.lit(None).cast("string"))
    both = d.unionByName(odd).unionByName(odd).withColumn("score", F.lit("clash")).withColumn("ambiguous", F.lit(1))
    got = [r for r in LI.identify(both).collect() if r["doc_id"] >= 10**6]
    assert len(got) == 12
    for r in got:
        assert (r["lang_pred"] == "und") == (r["doc_id"] - 10**6 < 4) and (r["score"] == 0) == (r["doc_id"] - 10**6 < 4)
    kept = LI.keep(both)
    assert kept.columns == both.columns and {r["doc_id"] for r in kept.filter("doc_id >= 1000000").select("doc_id").collect()} <= {10**6 + 4, 10**6 + 5}
    assert kept.filter("doc_id < 1000000").count() == d.count()


def test_numbers_that_look_like_letters_are_none(spark):
    model = LI.fitted(table(spark, SF, "documents"), ~LI.is_held_out())
    for text in ("½ ²", "① Ⅳ", "٣ 5 _", "½ ² x"):
        assert (model.predict([text])[0][0] == "und") == ("x" not in text)


def test_sample_is_the_smallest_keys_whatever_the_tasks(spark):
    rng = random.Random(8)
    rows = [(i % 700, " ".join(rng.choices(["ab", "cd", "ef", "gh"], k=6)), "de" if i % 9 else "en", "s", None) for i in range(9000)]
    d = spark.createDataFrame(rows, SCHEMA)
    one, many_tasks = LI.fitted(d.coalesce(1), F.lit(True)), LI.fitted(d.repartition(13), F.lit(True))
    assert (one.weights == many_tasks.weights).all() and (one.bias == many_tasks.bias).all()


def test_language_without_labels(spark):
    none = docs(spark, "hello there").withColumn("lang", F.lit(None).cast("string"))
    assert LI.identify(none).first()["lang_pred"] == "und"
    assert LI.identify(none.limit(0)).count() == 0


def test_more_than_64_languages_are_learnt(spark):
    rng = random.Random(2)
    rows = []
    for k in range(80):
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(8)]
        rows += [(100 * k + i, " ".join(rng.choices(words, k=40)), f"l{k:02}", "s", None) for i in range(10 + k % 7)]
    d = spark.createDataFrame(rows, SCHEMA)
    model = LI.fitted(d, F.lit(True))
    assert model.languages == [f"l{k:02}" for k in range(80)]
    right = [model.predict([text])[0][0] == lang for _, text, lang, *_ in rows]
    assert sum(right) >= 0.95 * len(rows)
    assert all(len({tuple(r) for r in LI.codewords(n)}) == n for n in (65, 300, 3000))


def many(spark, lang, ids, texts):
    return spark.createDataFrame([(i, t, lang, "s", None) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def test_languages_with_shared_or_null_ids_are_learnt(spark):
    rng = random.Random(5)
    text = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(30))
    de, en = [text("abcdefg") for _ in range(5000)], [text("tuvwxyz") for _ in range(1000)]
    for ids in ([7] * 5000, [None] * 5000):
        d = many(spark, "de", ids, de).unionByName(many(spark, "en", range(1000), en))
        model = LI.fitted(d, ~LI.is_held_out() | F.lit(True))
        assert model.languages == ["de", "en"] and [model.predict([t])[0][0] for t in (de[0], en[0])] == ["de", "en"]
    # One row that repeats very often neither crowds out the others of its language nor other languages.
    d = many(spark, "de", [7] * 4000, de[:1] * 4000).unionByName(many(spark, "de", range(100, 160), de[:60])).unionByName(many(spark, "zz", range(200, 230), en[:30]))
    model = LI.fitted(d, F.lit(True))
    assert model.languages == ["de", "zz"] and [model.predict([t])[0][0] for t in (de[99], en[99])] == ["de", "zz"]


def plain_language_id(rows):
    """The same classifier in plain loops and float64: sample, training and decoding written out anew."""

    def hashed(data, seed):
        return xxhash.xxh64_intdigest(data, seed)

    def key(i, t):
        h = hashed(b"language", 42)
        h = hashed(str(i).encode(), h) if i is not None else h
        h = hashed(t.encode(), h)
        return h - 2**64 if h >= 2**63 else h

    def vector(t):
        t = "".join(c if ("a" <= c <= "z") or ord(c) >= 128 else " " for c in t.lower())
        data = (" " + " ".join(re.sub("[ ]+", " ", t).strip(" ").split(" ")) + " ").encode() if t.strip(" ") else b" "
        out = np.zeros(LI.DIMENSIONS)
        for n, factors in ((2, (0x9E3779B1, 0x85EBCA77)), (3, None)):
            for i in range(len(data) - n + 1):
                two = data[i] * 0x9E3779B1 + data[i + 1] * 0x85EBCA77
                g = (two if n == 2 else two % 2**32 * 0xC2B2AE3D + data[i + 2] * 0x27D4EB2F) % 2**32
                g = (g ^ g >> 15) * 0x2C1B3C6D % 2**32
                out[g >> 20] += 1
        out = np.sqrt(out)
        return out / max(np.linalg.norm(out), 1e-12)

    def is_held(i):
        return zlib.crc32(str("null" if i is None else i).encode()) % 4 == 2

    langs = sorted({lang for i, t, lang in rows if lang and t is not None and not is_held(i)})
    most = min(LI.PER_LANGUAGE, max(LI.LEAST_ROWS, LI.SAMPLE_ROWS // len(langs)))
    sample = [(g, x) for g in langs for _, x in sorted({key(i, t): t for i, t, lang in rows if lang == g and t is not None and not is_held(i)}.items())[:most]]
    codes = LI.codewords(len(langs)).astype(float)
    x = np.array([vector(t).astype(np.float16).astype(float) for _, t in sample])
    y = np.array([langs.index(g) for g, _ in sample])
    w, b = np.zeros((LI.DIMENSIONS, codes.shape[1])), np.zeros(codes.shape[1])
    sw, sb = w + 1e-6, b + 1e-6
    rng = np.random.default_rng(6)
    share = {k: len(y) / len(langs) / (y == k).sum() for k in set(y.tolist())}
    for _ in range(LI.EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), LI.BATCH):
            gw, gb, chosen = 0, 0, order[at : at + LI.BATCH]
            for i in chosen:
                pull = -codes[y[i]] / (1 + np.exp(codes[y[i]] * (x[i] @ w + b))) * share[y[i]]
                gw, gb = gw + np.outer(x[i], pull), gb + pull
            gw, gb = gw / len(chosen), gb / len(chosen)
            sw, sb = sw + gw**2, sb + gb**2
            w, b = w - LI.RATE * gw / np.sqrt(sw), b - 0.1 * gb / np.sqrt(sb)
    out = {}
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            out[i] = ("und", 0.0, 0.0)
            continue
        loss = np.log1p(np.exp(-(vector(t) @ w + b)[None, :] * codes)).sum(1)
        p = np.exp(loss.min() - loss)
        out[i] = (langs[int(loss.argmin())], float(p.max() / p.sum()), float(np.sort(loss)[1] - loss.min()) if len(loss) > 1 else 1e9)
    return out


def test_language_query_against_plain_loops(spark):
    d = table(spark, SF, "documents").filter("doc_id < 260").select("doc_id", "text", "lang")
    want = plain_language_id([tuple(r) for r in d.collect()])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in LI.identify(d).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 0.01 for i in want)


def test_codewords_differ():
    for n in range(2, 12):
        c = LI.codewords(n)
        assert len({tuple(r) for r in c}) == n and all(abs(col.sum()) < n for col in c.T) if n <= 5 else len({tuple(r) for r in c}) == n


# Quality model


def test_quality_held_out(spark):
    d, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = QM.classify(d, labels).join(labels, "doc_id").filter("held_out").collect()
    right = [sum(r["predicted"] == q for r in rows if r["quality"] == q) / sum(r["quality"] == q for r in rows) for q in (0, 1)]
    assert min(right) >= 0.8 and all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def plain_quality(rows, labels):
    """The same machine in plain loops and float64: features, sample, training and scores written out anew; pairs are summed one by one."""

    def hashed(data, seed=42):
        return xxhash.xxh64_intdigest(data, seed)

    def signed(h):
        return h - 2**64 if h >= 2**63 else h

    def features(text, n_chars):
        words, data = (text or "").encode().split(), (text or "").encode()
        counts = {}
        for w in words:
            k = xxhash.xxh3_64_intdigest(w.lower(), 20240607) % QM.WORDS
            counts[k] = counts.get(k, 0) + 1
        norm = sum(counts.values()) ** 0.5
        out = {k: n**0.5 / norm for k, n in counts.items()}
        bins = [*QM.structure(text or "", words), 0 if n_chars is None else min(QM.BINS - 1, 1 + min(QM.BINS - 1, int(np.log2(max(n_chars, 0) / 4 + 1))))]
        assert len(data) == len((text or "").encode())
        return out | {QM.WORDS + j * QM.BINS + b: 1.0 for j, b in enumerate(bins)}

    told = {}
    for i, q in labels:
        if i is not None and q in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            told[i] = min(q, told.get(i, 1))
    key = lambda i: signed(xxhash.xxh64_intdigest((92).to_bytes(4, "little"), hashed(str(i).encode())))
    texts = {}
    for i, t, n in rows:
        if i in told:
            texts.setdefault(i, (t, n))
    picked = [i for q in (0, 1) for i in sorted((i for i in told if told[i] == q), key=key)[: QM.PER_CLASS] if i in texts]
    picked.sort()
    x, y = [features(*texts[i]) for i in picked], np.array([told[i] for i in picked])
    rng = np.random.default_rng(9)
    w, v, bias = np.zeros(QM.FEATURES), rng.normal(0, 0.02, (QM.FEATURES, QM.RANK)).astype(np.float32).astype(float), 0.0
    sw, sv = w + 1e-2, v * 0 + 1e-2
    weight = [len(y) / 2 / (y == q).sum() for q in (0, 1)]

    def raw(f):
        out = bias
        items = list(f.items())
        for a, (k, value) in enumerate(items):
            out += w[k] * value
        ks, vs = np.array([k for k, _ in items]), np.array([value for _, value in items])
        gram = (v[ks] @ v[ks].T) * np.outer(vs, vs)
        return out + (gram.sum() - np.trace(gram)) / 2

    for _ in range(QM.EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), QM.BATCH):
            gw, gv, gb = {}, {}, 0.0
            for i in order[at : at + QM.BATCH]:
                pull = (1 / (1 + np.exp(-np.clip(raw(x[i]), -30, 30))) - y[i]) * weight[y[i]]
                gb += pull
                total = sum(v[k] * value for k, value in x[i].items())
                for k, value in x[i].items():
                    gw[k] = gw.get(k, 0) + pull * value
                    gv[k] = gv.get(k, 0) + pull * value * (total - v[k] * value)
            bias -= 0.01 * gb
            for k in gw:
                g, gk = gw[k] + QM.DECAY * w[k], gv[k] + QM.DECAY * v[k]
                sw[k] += g * g
                w[k] -= QM.RATE * g / np.sqrt(sw[k])
                sv[k] += gk * gk
                v[k] -= QM.RATE * gk / np.sqrt(sv[k])
    return {i: 1 / (1 + np.exp(-np.clip(raw(features(t, n)), -30, 30))) for i, t, n in rows}


def test_quality_query_against_plain_loops(spark):
    d = table(spark, SF, "documents").filter("doc_id < 130").select("doc_id", "text", "n_chars")
    labels = table(spark, SF, "labels").filter("doc_id < 130")
    rows = [tuple(r) for r in d.collect()]
    assert len({i for i, _, _ in rows}) == len(rows)
    want = plain_quality(rows, [(r["doc_id"], r["quality"]) for r in labels.collect()])
    got = {r["doc_id"]: r["score"] for r in QM.classify(d, labels).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 0.02
    assert max(want.values()) - min(want.values()) > 0.5


def test_rows_that_share_an_id_are_picked_alike(spark):
    rows = [(i // 2, f"{'good words here' if i % 2 else '### $$$'} {i}", "en", "s", None) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    d = spark.createDataFrame(rows, SCHEMA)
    models = [QM.fitted(x, labels, F.lit(True)) for x in (d.coalesce(1), d.repartition(7), d.orderBy(F.desc("text")))]
    assert all((m.w == models[0].w).all() and m.bias == models[0].bias for m in models)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = QM.Machine(0.3, rng.normal(size=QM.FEATURES).astype(np.float32), rng.normal(size=(QM.FEATURES, QM.RANK)).astype(np.float32))
    k, x = np.array([3, 77, 901, 5000]), rng.normal(size=4).astype(np.float32)
    pairs = sum(m.v[k[i]] @ m.v[k[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
    assert abs(m.raw(k, x) - (0.3 + m.w[k] @ x + pairs)) < 1e-3


def test_quality_edges(spark):
    labels = table(spark, SF, "labels")
    d = table(spark, SF, "documents")
    odd = docs(spark, None, "", "word " * 200_000).withColumn("doc_id", F.when(F.col("doc_id") == 0, None).otherwise(F.col("doc_id") + 10**6))
    both = d.unionByName(odd).withColumn("k", F.lit(1)).withColumn("quality", F.lit("clash"))
    rows = QM.classify(both, labels.unionByName(labels.limit(1))).collect()
    assert len(rows) == d.count() + 3 and all(0 <= r["score"] <= 1 for r in rows)
    assert QM.classify(odd, labels.limit(0)).first()["score"] == 0.5
    assert QM.classify(odd.limit(0), labels).count() == 0
    one = QM.classify(odd.drop("n_chars"), labels.filter("quality = 1"))
    assert {r["predicted"] for r in one.collect()} == {1}


# Quality rules


R = random.Random(1)


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = {g for g in grams if grams.count(g) > 1}
    repeat = {i + k for i, g in enumerate(grams) if g in often for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(repeat) > 30 * len(w)
    data = text.encode()
    ratio = len(zstandard.ZstdCompressor(level=3).compress(data)) / len(data) if data else None
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat), failed, ratio


def brute_kept(text):
    """The verdict by its definition: the base rule, the whole text's band, and the share of bytes in chunks out of their band."""
    data, z = (text or "").encode(), zstandard.ZstdCompressor(level=3)
    if not data or brute_rules(text)[5]:
        return False
    ratio = len(z.compress(data)) / len(data)
    low, high = [(a, b) for below, a, b in QR.BANDS if len(data) < below][0]
    bad = 0
    for c in [data[i : i + 4096] for i in range(0, len(data), 4096)]:
        lo, hi = (0.43, 0.75) if len(c) >= 2048 else [(a, b) for below, a, b in QR.BANDS if len(c) < below][0]
        bad += 0 if lo <= len(z.compress(c)) / len(c) <= hi else len(c)
    return low <= ratio <= high and bad / len(data) <= 0.3


def test_the_last_bytes_are_judged(spark):
    clean = " ".join(r["text"] for r in table(spark, SF, "documents").orderBy("doc_id").limit(40).collect()).encode()[:4096].decode(errors="ignore")
    rng = random.Random(4)
    junk = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=n))
    texts = [clean, clean + " " + junk(2000), clean[:3000] + " " + junk(1500), clean + " " + clean[:1500][::-1], clean + " " + "ha " * 650]
    rows = QR.apply_rules(docs(spark, *texts)).orderBy("doc_id").collect()
    assert [r["kept"] for r in rows] == [brute_kept(t) for t in texts]
    assert [r["kept"] for r in rows][:2] == [True, False] and rows[1]["chunk_share_out"] > 0.3


def test_rules_against_brute_force(spark):
    texts = [None, "", "a", "ä b\n\nä b\n \nä b", "x # * $ % & | < > [ ]", "one two three four five six seven eight " * 3, " ".join("".join(R.choices("abcdefghinorstu", k=R.randint(2, 9))) for _ in range(300)), "слово " * 40, "a b c d e f g h\x1ci \x85 j k " * 5, "aaaa " * 50_000]
    rows = {r["doc_id"]: r for r in QR.apply_rules(docs(spark, *texts).withColumn("kept", F.lit("clash"))).collect()}
    for i, t in enumerate(texts):
        r, want = rows[i], brute_rules(t) if i < 9 else None
        if want:
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio")) == want
        assert not (r["base_failed"] and r["kept"])
    assert rows[6]["kept"] and not rows[9]["kept"]


def test_rules_on_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = QR.apply_rules(d).collect()
    for r in rows:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio")) == brute_rules(r["text"])
        assert r["kept"] == brute_kept(r["text"])
    kept = QR.keep(d)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in rows if r["kept"]}
    assert QR.keep(d.limit(0)).count() == QR.apply_rules(d.limit(0)).count() == 0


def test_bands_reject_both_ends(spark):
    rng = np.random.default_rng(0)
    noise = " ".join("".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 6)) for _ in range(400))
    same = " ".join(f"{'ab' * (i % 7)}c" for i in range(3000))
    rows = QR.apply_rules(docs(spark, noise, same)).orderBy("doc_id").collect()
    assert not rows[0]["kept"] and rows[0]["ratio"] > 0.6 and not rows[1]["kept"]


def test_long_documents_with_a_little_repetition(spark):
    rows = table(spark, "/root/testdata/sf0.1", "documents").filter("lang in ('de', 'es') and length(text) > 800").orderBy("doc_id").select("lang", "text").collect()
    z, ids = zstandard.ZstdCompressor(level=QR.LEVEL), QR.Ids()
    for lang in ("de", "es"):
        long = "\n".join(dict.fromkeys(r["text"] for r in rows if r["lang"] == lang and QR.judged(r["text"].encode(), ids, z)[-1])).encode()[:1_000_000]
        for size in (200_000, 1_000_000):
            assert QR.compression(z, long[:size])[2] and QR.compression(z, long[:size] + long[: size * 6 // 100])[2]
            assert not QR.compression(z, long[:size] + long[:size])[2]
        assert QR.judged(long + long[:60_000], ids, z)[-1]


# Licenses


def brute_licenses(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    places = [(i, label) for phrase, label in LC.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.encode().split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None, "", "MIT", "the MIT License, and mit-license; MIT licensed", "cc by cc-by CC BY-NC 4.0", "gnu general gnu general public license general public license",
    "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its associated documentation files", "word " * 100_000 + "apache license", "É mit license é",
]


def test_licenses_against_brute_force(spark):
    df = docs(spark, *TEXTS).withColumn("labels", F.lit("clash")).withColumn("template", F.lit(1))
    rows = {r["doc_id"]: r for r in LC.scan(df).collect()}
    for i, t in enumerate(TEXTS):
        r = rows[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licenses(t)
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
    assert "apache-2.0" in rows[6]["labels"] and "gpl-3.0" in rows[7]["labels"] and "mit-notice" in rows[8]["labels"] and "cc-by-nc-4.0" not in rows[3]["labels"]


def test_licenses_repeated_rows_and_null_ids(spark):
    df = docs(spark, "mit license", "mit license").withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs(spark, "cc by", "x").withColumn("doc_id", F.lit(3)))
    rows = sorted((str(r["doc_id"]), r["n_base"], r["labels"]) for r in LC.scan(df.unionByName(df)).collect())
    assert rows == sorted([("None", 1, "mit")] * 4 + [("3", 1, "cc-by")] * 2 + [("3", 0, "")] * 2)
    assert LC.scan(df.limit(0)).count() == 0


def test_licenses_on_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in LC.scan(d).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licenses(texts[r["doc_id"]])


EDITED = [
    ("released under an MIT license", "mit-release"), ("Licensed under the terms of the Apache License, Version 2.0", "apache-2.0"), ("All rights reserved.", "all-rights-reserved"),
    ("released under licence, released under the mit license", "mit-release"), ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0", "mpl-2.0"),
]
OTHERS = [
    ("licensed under cc by nc 4 0", "cc-by-4.0"), ("licensed under cc by nd 4 0", "cc-by-4.0"), ("licensed under cc by nc sa 4 0", "cc-by-nc-4.0"), ("licensed under cc by nc sa 4 0", "cc-by-sa-4.0"),
    ("licensed under the apache license version 1 1", "apache-2.0"), ("this work is licensed under the gnu lesser general public license version 3", "gpl-3.0"),
    ("this work is licensed under the gnu general public license version 2", "gpl-3.0"), ("licensed under cc by 3 0", "cc-by-4.0"), ("released under the bsd license", "mit-release"),
]


def test_short_notices_with_an_inserted_word(spark):
    inserted = [
        (" ".join([*w[:i], "word", *w[i:]]), label)
        for notice, label in LC.NOTICES
        if 3 < len(w := notice.split()) <= 12
        for i in range(1, len(w))
    ]
    cases = EDITED + inserted
    rows = {r["doc_id"]: r["labels"].split(",") for r in LC.scan(docs(spark, *[t for t, _ in cases + OTHERS])).collect()}
    assert len(inserted) > 50 and [c for i, c in enumerate(cases) if c[1] not in rows[i]] == []
    assert [c for i, c in enumerate(OTHERS, len(cases)) if c[1] in rows[i]] == []


def brute_labels(text):
    """The labels by their definition, in plain loops over words: which chains of equal words cover enough of a notice."""
    words = [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]
    found = {x for x in brute_licenses(text)[4].split(",") if x}
    for notice, label in LC.NOTICES:
        t = notice.split()
        short = len(t) <= LC.SHORT_WORDS
        k = 1 if short else LC.NOTICE_K
        hits, places, barred = set(), set(), set()
        for p in range(len(words)):
            for q in range(len(t)):
                if not short:
                    if words[p : p + 4] == t[q : q + 4] and q + 4 <= len(t):
                        hits.add((p, q))
                        places.add(q)
                    continue
                for step in (1, 2):
                    if q + 1 < len(t) and words[p] == t[q] and words[p + step : p + step + 1] == t[q + 1 : q + 2]:
                        hits |= {(p, q), (p + step, q + 1)}
                        places.add(q)
                for x in (x for name, xs in LC.BARRED.items() if name in t for x in xs if q + 1 < len(t)):
                    if words[p] == t[q] and words[p + 1 : p + 2] == [x] and t[q + 1] != x:
                        barred.add(p + 1)
                    if words[p] == x and words[p + 1 : p + 2] == [t[q + 1]] and t[q] != x:
                        barred.add(p)
        if len(places) * (2 if short else 4) < LC.SHARE * len(t):
            continue
        telling = [short and (x.isdigit() or x in LC.TELLING) for x in t]
        order, best = sorted(hits), 0.0
        for start in order:
            if any(telling[: start[1]]):
                continue
            covered = {start: k}
            for at in order:
                if at > start and at[0] + k - start[0] <= LC.STRETCH * len(t):
                    ways = [
                        c + min(k, at[1] - b, at[0] - a)
                        for (a, b), c in covered.items()
                        if a < at[0] and b < at[1] and abs(at[0] - at[1] - a + b) <= LC.NEIGHBOURS and not any(telling[b + k : at[1]]) and not any(a + k <= x < at[0] for x in barred)
                    ]
                    if ways:
                        covered[at] = max(ways)
            best = max([best, *[c / len(t) for (a, b), c in covered.items() if not any(telling[b + k :])]])
        if best >= (LC.SHORT_SHARE if short else LC.SHARE):
            found.add(label)
    return ",".join(sorted(found))


def test_labels_against_plain_loops(spark):
    rng = random.Random(31)
    texts = [t for t, _ in EDITED + OTHERS] + [t for t in TEXTS if t is None or len(t) < 1000]
    for notice, _ in LC.NOTICES * 4:
        w = notice.split()
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(w))
            change = rng.random()
            w = [*w[:at], *([] if change < 0.3 else [rng.choice(["word", "nc", "the", "2", "lesser", w[at]])] if change < 0.6 else [rng.choice(["and", "mit"]), w[at]]), *w[at + 1 :]] or ["x"]
        texts.append(" ".join([*rng.choices(["a", "the", "license", "cc", "by"], k=3), *w, "end"]))
    rows = {r["doc_id"]: r["labels"] for r in LC.scan(docs(spark, *texts)).collect()}
    assert [(t, rows[i], want) for i, t in enumerate(texts) if rows[i] != (want := brute_labels(t))] == []
    assert sum(bool(x) for x in rows.values()) > 40


def test_labels_of_documents_against_plain_loops(spark):
    d = table(spark, SF, "documents").filter("length(text) < 3000")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    rows = {r["doc_id"]: r["labels"] for r in LC.scan(d).collect()}
    some = [i for i, t in texts.items() if "icense" in t or "cc by" in t.lower() or "rights reserved" in t.lower()]
    assert len(some) > 10 and all(rows[i] == brute_labels(texts[i]) for i in some) and sum(bool(x) for x in rows.values()) == sum(bool(brute_labels(texts[i])) for i in some)


NAMED = [
    ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "lgpl-2.1"), ("Eclipse Public License - v 2.0", "epl-2.0"), ("GNU Affero General Public License, version 3", "agpl-3.0"),
    ("Creative Commons Attribution 4.0 International", "cc-by-4.0"), ("Mozilla Public License Version 2.0", "mpl-2.0"), ("Boost Software License - Version 1.0", "bsl-1.0"),
]


def test_licenses_by_their_titles(spark):
    others = [("GNU Lesser General Public License version 2.1", "gpl-2.0"), ("Creative Commons Attribution ShareAlike 4.0 International", "cc-by-4.0"), ("Eclipse Public License v 1.0", "epl-2.0")]
    rows = {r["doc_id"]: r["labels"] for r in LC.scan(docs(spark, *[t for t, _ in NAMED + others])).collect()}
    assert [label in rows[i].split(",") for i, (_, label) in enumerate(NAMED + others)] == [True] * len(NAMED) + [False] * len(others)
    assert all(rows[i] == brute_labels(t) for i, (t, _) in enumerate(NAMED + others))


def brute_covered(text, license_text):
    """The share by its definition: every stretch, every pair of equal 4-grams."""
    w, t = LC.words_of(text.encode()), LC.words_of(license_text.encode())
    most, best = int(1.5 * len(t)), 0
    pairs = [(p, q) for p in range(len(w) - 3) for q in range(len(t) - 3) if w[p : p + 4] == t[q : q + 4]]
    for start in {p for p, _ in pairs}:
        best = max(best, len({x for p, q in pairs if start <= p and p + 4 <= start + most for x in range(q, q + 4)}))
    return best / len(t)


def test_whole_licenses_with_edited_paragraphs(spark):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("grant", "work", "notice", "term", "party") for b in ("", "s", "ed", "ing", "or")]
    paragraph = lambda n: " ".join(rng.choices(vocabulary, k=n))
    given = {f"license-{k}": [paragraph(rng.randrange(30, 60)) for _ in range(6)] for k in range(3)}
    given["license-0b"] = [*given["license-0"][:5], paragraph(40)]
    whole = {k: ". ".join(v) for k, v in given.items()}
    texts = [None, "", "short text", whole["license-1"], "before " * 50 + whole["license-1"].upper() + " after" * 50]
    for v in given.values():
        texts += ["\n\n".join(random.Random(1).sample(v, 6)), ". ".join([v[0], paragraph(50), *v[1:]]), ". ".join(v[1:]), ". ".join(v[:3]), ". ".join([*v[:3], paragraph(400), *v[3:]])]
        w = whole_words = ". ".join(v).split()
        texts.append(" ".join(x if rng.random() > 0.05 else "edited" for x in w))
        texts.append(" ".join(x if rng.random() > 0.4 else "edited" for x in whole_words))
    table_rows = [(k, t) for k, t in whole.items()] + [("license-1", whole["license-1"]), (None, "x y z w"), ("none", None), ("tiny", "one two")]
    templates = spark.createDataFrame(table_rows, "label string, text string")
    df = docs(spark, *texts).unionByName(docs(spark, whole["license-2"]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = LC.scan(df.unionByName(df.filter("doc_id = 3")), templates).collect()
    assert len(rows) == len(texts) + 2
    want = {i: sorted(k for k, t in whole.items() if x and brute_covered(x, t) >= 0.7) for i, x in enumerate(texts)}
    got = {r["doc_id"]: [x for x in r["labels"].split(",") if x.startswith("license-")] for r in rows}
    assert {i: got[i] for i in want} == want and got[None] == ["license-2"]
    assert sum(bool(x) for x in want.values()) > 15 and ["license-0", "license-0b"] in want.values()
    plain = {r["doc_id"]: r["labels"] for r in LC.scan(df).collect()}
    assert all(plain[i] == ",".join(x for x in r["labels"].split(",") if not x.startswith("license-")) for r in rows for i in [r["doc_id"]])
    assert LC.scan(df, templates.limit(0)).count() == len(texts) + 1


def test_a_table_of_licenses_is_not_forced_to_be_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = " ".join(f"w{i}" for i in range(300))
        out = LC.scan(docs(spark, text, "other " * 300), spark.createDataFrame([("long", text)], "label string, text string")).collect()
        assert {r["doc_id"]: r["labels"] for r in out} == {0: "long", 1: ""}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
