"""License scans by diagonal voting.

All rolling word k-gram hashes of every text are joined by Spark with the places of the templates' k-grams. A match at
word p of the text and place q of a template votes for the diagonal p - q. Votes are collected per diagonal, chains of
votes over neighbouring diagonals (insertions and deletions shift them) are spans, and a span counts if its votes cover
enough of the template's words without being much longer than it. The places of a span are then verified: the text is
read again, and only places whose words are the template's, word by word, go on counting.

Templates are phrases, which must stand whole (every vote on one diagonal; these are the base places), and notices. Short
notices have 2-grams, also with a word between, so that an edit costs a word and not all votes; their TELLING words must be
covered, and no word of BARRED may stand between, which makes it another license.
Their table is fixed, under 1000 rows, and the one side of their join that is broadcast.

Whole license texts come as a table (label, text). Their 4-grams are found by Spark too, and joined by hash as Spark sees fit:
a table of many licenses is not forced to be broadcast. Here all diagonals are neighbours, as paragraphs may be inserted, left
out and moved: a text has the license if some stretch of it, up to STRETCH times as long, covers SHARE of the license's
words by 4-grams that are the license's, word by word.

Votes are few. They are counted before they are shuffled, then everything about a text is brought together by (doc_id,
hash of the text) and written once for all steps to come; each text also votes once for a marker, so that texts without
any match keep their row, and as often as rows repeat. Only the ids of texts that may hold a notice are joined back to
the documents (broadcast by Spark while they are few), and only these texts are read in Python again.

Defined results: null or empty texts have no words and labels; a null doc_id keeps its row; repeated rows get a row each;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import Ids, bounded_batches, released, slices, windows, written

#: Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Openings of well-known notices and their labels, found where most of the words stand in order.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl-notice"),
    ("released under the mit license", "mit-release"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-notice"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-notice"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-notice"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu lesser general public license version 2 1", "lgpl-2.1"),
    ("gnu lesser general public license version 3", "lgpl-3.0"),
    ("gnu affero general public license version 3", "agpl-3.0"),
    ("eclipse public license v 1 0", "epl-1.0"),
    ("eclipse public license v 2 0", "epl-2.0"),
    ("mozilla public license version 2 0", "mpl-2.0"),
    ("boost software license version 1 0", "bsl-1.0"),
    ("creative commons attribution 4 0 international", "cc-by-4.0"),
    ("all rights reserved", "all-rights-reserved"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
)
PHRASE_K, NOTICE_K = 2, 4
#: Notices of up to so many words are short.
SHORT_WORDS = 12
#: The steps between diagonals of a span; the share of a long or short notice's words that a span needs; its length against the notice's.
NEIGHBOURS, SHARE, SHORT_SHARE, STRETCH = 3, 0.7, 0.8, 1.5
#: Words that a span of a short notice needs wherever the notice has them, beside numbers; words that make it another license.
TELLING = frozenset("apache mit cc by nc sa gnu lesser affero general public unencumbered eclipse mozilla boost creative commons attribution".split())
BARRED = {"cc": ("nc", "nd", "sa"), "gnu": ("lesser", "library", "affero"), "attribution": ("noncommercial", "noderivatives", "noderivs", "sharealike")}
#: Added to a notice's number where a k-gram has a barred word at its second or first place.
BARRED_AFTER, BARRED_BEFORE = 1000, 2000
#: Added to it for 2-grams with a word between, which have a width and a hash of their own.
SKIPPED, SKIP_K, SKIP_HASH = 3000, 3, np.uint64(0x5851F42D4C957F2D)
MARKER = -1
#: The number of the first license that is given; the others go down from it.
FIRST_GIVEN = -2
#: Lower-cases A-Z; ASCII other than digits and letters separates words.
_TABLE = bytes(i + 32 if 0x41 <= i <= 0x5A else i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def grams(ids: np.ndarray) -> np.ndarray:
    """The hashes of all word 2-grams, then of all 4-grams, then of all 2-grams with a word between."""
    skipped = np.empty(max(len(ids) - 2, 0), np.uint64)
    skipped[::2], skipped[1::2] = windows(ids[::2], PHRASE_K), windows(ids[1::2], PHRASE_K)
    return np.concatenate([windows(ids, PHRASE_K), windows(ids, NOTICE_K), skipped ^ SKIP_HASH])


def template_rows() -> tuple[list[tuple[int, int, int, int]], list[tuple[int, str, bool, int, int, int]]]:
    """(hash, template, place, k) of all template k-grams, and (template, label, phrase, words, k, k-grams of a whole one)."""
    places, templates = [], []
    ids = Ids()

    def hashes(words: list[bytes], k: int) -> list[int]:
        return windows(ids.array(words), k).view(np.int64).tolist()

    for number, (text, label) in enumerate([*PHRASES, *NOTICES]):
        phrase = number < len(PHRASES)
        words = words_of(text.encode())
        k = PHRASE_K if phrase or len(words) <= SHORT_WORDS else NOTICE_K
        own = hashes(words, k)
        places += [(h, number, q, k) for q, h in enumerate(own)]
        templates.append((number, label, phrase, len(words), k, len(own)))
        if phrase or k == NOTICE_K:
            continue
        places += [(h, SKIPPED + number, q, SKIP_K) for q, h in enumerate((np.array(own).view(np.uint64) ^ SKIP_HASH).view(np.int64).tolist())]
        for x in (x.encode() for name, barred in BARRED.items() if name.encode() in words for x in barred):
            for q in range(len(words) - 1):
                if words[q + 1] != x:
                    places += [(hashes([words[q], x], k)[0], BARRED_AFTER + number, q, k)]
                if words[q] != x:
                    places += [(hashes([x, words[q + 1]], k)[0], BARRED_BEFORE + number, q, k)]
    marker = np.uint64(1).view(np.int64).item()
    return [*places, (marker, MARKER, 0, PHRASE_K)], templates


def best_span(hits: list[tuple[int, int]], barred: set[int], words: list[bytes], k: int) -> tuple[float, int] | None:
    """The largest share of a notice's words that a span of (word, place) hits of k words covers, and its diagonal; None if none counts."""
    short = k == 1
    n, most = len(words), STRETCH * len(words)
    telling = [0]  # how many telling words stand before each place
    for x in words:
        telling.append(telling[-1] + (short and (x.isdigit() or x.decode() in TELLING)))
    hits = sorted(set(hits))
    # Per hit: the words covered by the chain that ends in it, by the chain's first hit.
    chains: list[dict[tuple[int, int], int]] = []
    best = None
    low = 0
    for j, (p, q) in enumerate(hits):
        own: dict[tuple[int, int], int] = {}
        if not telling[q]:
            own[p, q] = k
        while p + k - hits[low][0] > most:
            chains[low] = {}
            low += 1
        for i in range(low, j):
            a, b = hits[i]
            if a == p or b >= q or abs((p - q) - (a - b)) > NEIGHBOURS or telling[q] > telling[min(b + k, q)]:
                continue
            if barred and any(x in barred for x in range(a + k, p)):
                continue
            for start, covered in chains[i].items():
                if p + k - start[0] <= most:
                    own[start] = max(own.get(start, 0), covered + min(k, q - b, p - a))
        chains.append(own)
        if telling[n] == telling[min(q + k, n)]:
            for (a, b), covered in own.items():
                share = covered / n
                if share >= (SHORT_SHARE if short else SHARE) and (best is None or share > best[0]):
                    best = (share, a - b)
    return best


def gram_arrays(docs: DataFrame) -> DataFrame:
    """doc_id, _key (a hash of the text), n_words and all k-gram hashes of each text, the marker last."""
    bounded_batches(docs.sparkSession)
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = state.setdefault("ids", Ids())
        for part in (p for b in batches for p in slices(b, "text", 2 << 20)):
            counts, arrays = [], []
            for text in part.column("text").to_pylist():
                words = words_of(text)
                counts.append(len(words))
                arrays.append(np.append(grams(ids.array(words)), np.uint64(1)).view(np.int64))
            starts = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(arrays)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_key"), pa.array(counts, pa.int64()), lists], names=["doc_id", "_key", "n_words", "grams"])

    text = F.col("text").cast("string")
    source = docs.select("doc_id", F.xxhash64(text).alias("_key"), F.encode(text, "utf-8").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(released(run), f"doc_id {kind}, _key long, n_words long, grams array<long>")


def votes(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """doc_id, _key, n_words, template, diagonal, places, votes: matches counted per diagonal."""
    places, _ = template_rows()
    templates = F.broadcast(spark.createDataFrame(places, "gram long, template int, place long, k int"))  # under 1000 rows, fixed
    every = gram_arrays(docs).select("doc_id", "_key", "n_words", F.posexplode("grams").alias("at", "gram"))
    hits = every.join(templates, "gram")
    twos = F.greatest(F.col("n_words") - (PHRASE_K - 1), F.lit(0))
    fours = F.greatest(F.col("n_words") - (NOTICE_K - 1), F.lit(0))
    word = F.when(F.col("k") == PHRASE_K, F.col("at")).when(F.col("k") == NOTICE_K, F.col("at") - twos).otherwise(F.col("at") - twos - fours)
    # The three kinds of k-grams have different hashes, so that the template tells which of the lists `at` counts in.
    hits = hits.select("doc_id", "_key", "n_words", "template", (word - F.col("place")).alias("diagonal"), word.alias("word"))
    marked = F.col("template") == MARKER
    by = ["doc_id", "_key", "n_words", "template", F.when(marked, F.lit(0)).otherwise(F.col("diagonal")).alias("diagonal"), F.when(marked, F.lit(0)).otherwise(F.col("word")).alias("word")]
    # Rows that repeat a document are counted before any shuffle; then all votes of a text go to one place, for every step to come.
    once = hits.select(*by).groupBy("doc_id", "_key", "n_words", "template", "diagonal", "word").agg(F.count("*").alias("_rows")).repartition("doc_id", "_key")
    return once.groupBy("doc_id", "_key", "n_words", "template", "diagonal").agg(F.collect_list(F.col("word") - F.col("diagonal")).alias("places"), F.count("*").alias("votes"), F.max("_rows").alias("_rows"))


def verified_hits(found: list[dict], words: list[bytes], template: list[bytes], k: int) -> tuple[list[tuple[int, int]], set[int]]:
    """The (word, place) hits of a notice whose words are its own in the text, and the places of barred words.

    Long notices have hits of k words. Short ones go on with single words, those of their 2-grams.
    """
    hits, barred = [], set()
    for group in found:
        kind, diagonal = group["_kind"], group["diagonal"]
        for q in group["places"]:
            p = diagonal + q
            if kind in (BARRED_AFTER, BARRED_BEFORE):
                barred.add(p + (kind == BARRED_AFTER))
            elif k == NOTICE_K:
                if words[p : p + k] == template[q : q + k]:
                    hits.append((p, q))
            else:
                step = 2 if kind == SKIPPED else 1
                if words[p : p + 1] == template[q : q + 1] and words[p + step : p + step + 1] == template[q + 1 : q + 2]:
                    hits += [(p, q), (p + step, q + 1)]
    return hits, barred


def verified(candidates: DataFrame, docs: DataFrame, notices: dict[int, tuple[list[bytes], int]]) -> DataFrame:
    """The candidates (doc_id, _key, template, hits) that hold a span in their text: with its share and diagonal."""
    wanted = written(candidates, "candidates")
    few = wanted.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_hash"))  # ids alone, so that as many as can be are broadcast
    text = F.col("text").cast("string")
    texts = docs.select("doc_id", F.xxhash64(text).alias("_key"), F.encode(text, "utf-8").alias("text"))
    texts = texts.join(few, texts["doc_id"].eqNullSafe(F.col("_id")) & (texts["_key"] == F.col("_hash")), "left_semi")
    both = texts.withColumnsRenamed({"doc_id": "_id", "_key": "_hash"}).join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("_key")))
    kept = ["doc_id", "_key", "n_words", "template", "label", "phrase", "_rows"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.select(*kept).schema.fields) + ", share double, diagonal long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], tuple[float, int] | None] = {}  # texts that repeat are verified once
        for part in (p for b in batches for p in slices(b, "text", 1 << 20)):
            spans, here = [], {}
            for key, number, text, found in zip(*[part.column(c).to_pylist() for c in ("_key", "template", "text", "hits")], strict=True):
                if (key, number) not in known:
                    if len(known) > 50_000:
                        known.clear()
                    if key not in here:
                        here = {key: words_of(text)}
                    template, k = notices[number]
                    hits, barred = verified_hits(found, here[key], template, k)
                    known[key, number] = best_span(hits, barred if k != NOTICE_K else set(), template, k if k == NOTICE_K else 1)
                spans.append(known[key, number])
            good = pa.array([x is not None for x in spans])
            share = pa.array([x[0] if x else None for x in spans], pa.float64())
            diagonal = pa.array([x[1] if x else None for x in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], share, diagonal], names=[*kept, "share", "diagonal"]).filter(good)

    bounded_batches(docs.sparkSession)
    return both.select(*kept, "hits", "text").mapInArrow(released(run), schema).dropDuplicates(["doc_id", "_key", "template"])


def spans(voted: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified spans: doc_id, _key, n_words, template, label, phrase, diagonal, share, _rows; markers among them."""
    _, rows = template_rows()
    told = F.broadcast(docs.sparkSession.createDataFrame(rows, "template int, label string, phrase boolean, words int, k int, whole int"))
    own = F.when(F.col("template") >= BARRED_AFTER, F.col("template") % BARRED_AFTER).otherwise(F.col("template"))
    known = voted.withColumn("_kind", F.when(F.col("template") >= BARRED_AFTER, F.col("template") - own).otherwise(0)).withColumn("template", own).join(told, "template", "left")
    phrases = known.filter("phrase and votes = whole").withColumn("share", F.lit(1.0))
    hits = known.filter("not phrase").groupBy("doc_id", "_key", "n_words", "template", "label", "phrase", "words", "k").agg(
        F.collect_list(F.struct("_kind", "diagonal", "places")).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("_kind").isin(0, SKIPPED), F.col("places"))))).alias("_places"),
        F.max("_rows").alias("_rows"),
    )
    notices = {number: (words_of(text.encode()), k) for (number, _, phrase, _, k, _), (text, _) in zip(rows, [*PHRASES, *NOTICES], strict=True) if not phrase}
    # Each k-gram covers k words at most; few texts have places enough to be looked at.
    enough = F.size("_places") * F.col("k") >= SHARE * F.col("words")
    merged = verified(hits.filter(enough).drop("words", "k", "_places"), docs, notices)
    out = ["doc_id", "_key", "n_words", "template", "label", "phrase", "diagonal", "share", "_rows"]
    return phrases.select(*out).unionByName(merged.select(*out)).unionByName(known.filter(F.col("template") == MARKER).withColumn("share", F.lit(0.0)).select(*out))


def numbered(templates: DataFrame) -> DataFrame:
    """Whole licenses (label, text) as a written table with a number each, below all others'. Nulls and repeated rows go."""
    own = templates.select(F.col("label").cast("string").alias("label"), F.encode(F.col("text").cast("string"), "utf-8").alias("license")).dropna().distinct()
    return written(own.withColumn("template", F.lit(FIRST_GIVEN) - F.monotonically_increasing_id()), "licenses")


def four_grams(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, n_words, at and gram: the hashes of all word 4-grams of each text (bytes)."""
    bounded_batches(texts.sparkSession)
    own = texts.select(*keys, F.col(text).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name != "text") + ", n_words long, grams array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids()
        for part in (p for b in batches for p in slices(b, "text", 2 << 20)):
            words = [words_of(t) for t in part.column("text").to_pylist()]
            arrays = [windows(ids.array(w), NOTICE_K).view(np.int64) for w in words]
            starts = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keys], pa.array([len(w) for w in words], pa.int64()), lists], names=[*keys, "n_words", "grams"])

    return own.mapInArrow(released(run), schema).select(*keys, "n_words", F.posexplode("grams").alias("at", "gram"))


def covered(words: list[bytes], template: list[bytes]) -> tuple[float, int]:
    """The largest share of a license's words that 4-grams of a stretch of STRETCH times its length cover, and where that starts."""
    n, most = len(template), int(STRETCH * len(template))
    places: dict[tuple[bytes, ...], list[int]] = {}
    for q in range(n - NOTICE_K + 1):
        places.setdefault(tuple(template[q : q + NOTICE_K]), []).append(q)
    hits = [(p, places[g]) for p in range(len(words) - NOTICE_K + 1) if (g := tuple(words[p : p + NOTICE_K])) in places]
    times, now, best, low = [0] * n, 0, (0, 0), 0
    for p, own in hits:
        for x in (x for q in own for x in range(q, q + NOTICE_K)):
            now += times[x] == 0
            times[x] += 1
        while p + NOTICE_K - hits[low][0] > most:
            for x in (x for q in hits[low][1] for x in range(q, q + NOTICE_K)):
                times[x] -= 1
                now -= times[x] == 0
            low += 1
        if now > best[0]:
            best = (now, hits[low][0])
    return best[0] / n, best[1]


def whole_licenses(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, _key, label, share: the whole licenses that stand in each different text."""
    licenses = numbered(templates)
    text = F.col("text").cast("string")
    once = docs.select(F.xxhash64(text).alias("_key"), F.encode(text, "utf-8").alias("text")).filter(F.col("text").isNotNull())
    told = four_grams(licenses, ["template"], "license").select("template", F.col("n_words").alias("words"), "gram", F.col("at").alias("place"))
    hits = four_grams(once, ["_key"], "text").join(told, "gram")
    # Votes by diagonal, counted before they are shuffled; then how many of a license's places a text has at all.
    voted = hits.groupBy("_key", "template", "words", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    enough = voted.groupBy("_key", "template", "words").agg(F.sum(F.size("places")).alias("_votes")).filter(F.col("_votes") * NOTICE_K >= SHARE * F.col("words"))
    wanted = written(enough.select(F.col("_key").alias("_hash"), "template"), "licensed")
    texts = once.join(wanted.select("_hash").distinct(), F.col("_key") == F.col("_hash"), "left_semi").dropDuplicates(["_key"])
    both = texts.join(wanted, F.col("_key") == F.col("_hash")).join(licenses, "template").select("_key", "text", "label", "license")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in slices(b, "text", 1 << 20)):
            shares = [covered(words_of(t), words_of(x))[0] for t, x in zip(part.column("text").to_pylist(), part.column("license").to_pylist(), strict=True)]
            made = pa.RecordBatch.from_arrays([part.column("_key"), part.column("label"), pa.array(shares, pa.float64())], names=["_key", "label", "share"])
            yield made.filter(pa.array([x >= SHARE for x in shares], pa.bool_()))

    return both.mapInArrow(released(run), "_key long, label string, share double").groupBy("_key", "label").agg(F.max("share").alias("share"))


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """n_words, base places and labels of each document; see the module's text. templates: whole licenses (label, text)."""
    found = spans(written(votes(docs, docs.sparkSession), "votes"), docs)
    if templates is not None:
        found = written(found, "spans")
        whole = whole_licenses(docs, templates).withColumnsRenamed({"label": "_label", "share": "_share"})
        rows = found.filter(F.col("template") == MARKER).join(whole, "_key")
        rows = rows.withColumns({"template": F.lit(FIRST_GIVEN), "label": F.col("_label"), "share": F.col("_share"), "phrase": F.lit(False)})
        found = found.unionByName(rows.select(*found.columns))
    base, marker = F.col("phrase") & (F.col("template") != MARKER), F.col("template") == MARKER

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(labels), ",")

    per_text = found.groupBy("doc_id", "_key", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).alias("last_word"),
        joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
        F.max(F.when(marker, F.col("_rows"))).alias("_times"),
    )
    rows = per_text.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
