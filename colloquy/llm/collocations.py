"""Phrase collocation mining in level-wise Apriori passes.

Texts are lower-cased (A-Z), split into pieces, and these into words; everything is counted per group (a language).

1. Level 1 counts all words of each group. Words with at least MIN_COUNT occurrences are frequent.
2. Level k (2, 3, 4) emits a k-gram only where both its (k-1)-grams are frequent; what is emitted is a 64-bit hash with its
   count, so that a level shuffles 16 bytes a gram. Sums of at least MIN_COUNT are the level's frequent hashes.
3. The frequent (k-1)-grams are broadcast as a bit filter: two probes of each hash, 16 bits a gram, at most FILTER_BYTES,
   whatever the corpus. A full filter lets more grams through, which their counts then end; it never loses one.
4. A last pass writes the phrases of the frequent hashes and counts them exactly, by their words: a collision of hashes
   can't join two phrases, it only lets one through to be counted here.
5. Each candidate's cuts meet the level tables for the counts of both parts; the lowest score is the candidate's (exact
   integer arithmetic in decimals). Candidates inside a longer one that has nearly all their occurrences go.

Each pass is a map over Arrow batches; a worker adds up to HELD hashes before it hands them on, and the sums are combined
before each shuffle, so that very frequent grams are few rows. The first 2000 of a group are found in PARTS parts of the
group first, so no task sorts all candidates of one. Nothing is capped or sampled.

Defined results: null and empty texts hold no words; a null group counts as GROUP_OF_NULL; repeated rows count each; a text
without any frequent phrase, an empty table, or one without candidates gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import bounded_batches, dropped, mix64, released, slices, written

MIN_COUNT, MOST_WORDS, TOP = 30, 4, 2000
#: A candidate goes if a longer one has at least SHARE / 100 of its occurrences.
SHARE = 80
SCALE = 2_000_000
GROUP_OF_NULL = "und"
FILTER_BYTES, BITS_A_GRAM = 64 << 20, 16
HELD = 1 << 20
PARTS = 64
#: A-Z to a-z; what ends a piece to a full stop; a tab to a blank.
_TABLE = bytes(0x2E if i in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if i == 0x09 else i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))
_STOP = b"."
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: pa.LargeStringArray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of its mixed bytes and places, mixed."""
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    if not len(words):
        return np.empty(0, np.uint64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    ends = ends - ends[0]
    sizes = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1], sizes)
    mixed = mix64(data * _FACTOR + place.astype(np.uint64))
    total = np.append(np.uint64(0), np.cumsum(mixed))  # modulo 2**64, as its differences are
    return mix64(total[ends[1:]] - total[ends[:-1]] + sizes.astype(np.uint64))


class Coded:
    """The words of a group's texts in order as numbers, with a full stop (which no word is) between pieces, and the different words."""

    def __init__(self, group: str, texts: list[bytes]) -> None:
        data = b" . ".join(t.translate(_TABLE).replace(_STOP, b" . ") for t in texts)
        coded = pc.ascii_split_whitespace(pa.array([data], pa.large_string())).values.dictionary_encode()
        self.group, self.words = group, coded.dictionary
        self.numbers = coded.indices.to_numpy()
        stop = pc.is_in(self.words, pa.array(["", _STOP.decode()], pa.large_string())).to_numpy(zero_copy_only=False)  # an empty one stands at most at either end
        self.stops = stop[self.numbers]

    def ids(self) -> np.ndarray:
        return word_hashes(self.words)[self.numbers]

    def phrases(self, first: np.ndarray, n: np.ndarray, k: int) -> pa.RecordBatch:
        """(group, phrase, f) rows of the k-grams that start at these places."""
        words = [self.words.take(pa.array(self.numbers[first + j])) for j in range(k)]
        joined = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if k > 1 else words[0]
        group = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([self.group])).cast(pa.string())
        return pa.RecordBatch.from_arrays([group, joined.cast(pa.string()), pa.array(n, pa.int64())], names=["group", "phrase", "f"])

    def grams(self, ids: np.ndarray, k: int) -> np.ndarray:
        """A hash for each run of k words, of the words one after another, starting with the group's."""
        n = max(len(ids) - k + 1, 0)
        out = np.full(n, salt(self.group))
        for j in range(k):
            out = mix64(out * _FACTOR + ids[j : j + n])
        return out

    def whole(self, k: int) -> np.ndarray:
        """Where k words stand without the end of a piece between."""
        n = max(len(self.stops) - k + 1, 0)
        out = np.ones(n, bool)
        for j in range(k):
            out &= ~self.stops[j : j + n]
        return out


def grouped(part: pa.RecordBatch) -> Iterator[Coded]:
    """The words of each group's texts in a batch (text: bytes, group)."""
    texts: dict[str, list[bytes]] = {}
    for group, text in zip(part.column("group").to_pylist(), part.column("text").to_pylist(), strict=True):
        if text:
            texts.setdefault(group, []).append(text)
    for group, own in texts.items():
        yield Coded(group, own)


class Bits:
    """A filter of 64-bit hashes: two bits for each."""

    def __init__(self, size: int, places: np.ndarray, values: np.ndarray) -> None:
        self.words = np.zeros(size, np.uint64)
        self.words[places] = values

    def has(self, hashes: np.ndarray) -> np.ndarray:
        n = np.uint64(64 * len(self.words) - 1)
        found = np.ones(len(hashes), bool)
        for at in (hashes & n, (hashes >> np.uint64(31)) & n):
            found &= self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1
        return found


def filter_of(hashes: DataFrame) -> Broadcast:
    """The filter of a table's hashes (h: long), broadcast. Bits are put together by Spark; at most FILTER_BYTES come back."""
    n = hashes.count()
    bits = 1 << max(10, min((FILTER_BYTES * 8).bit_length() - 1, (BITS_A_GRAM * n - 1).bit_length() if n else 10))
    probes = F.explode(F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 31).bitwiseAND(bits - 1)))
    at = hashes.select(probes.alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("place")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("value"))
    got = words.toArrow()
    made = Bits(bits // 64, got["place"].to_numpy(), got["value"].to_numpy().view(np.uint64))
    return hashes.sparkSession.sparkContext.broadcast(made)


def salt(group: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(group.encode(), 7))


def word_counts(texts: DataFrame) -> DataFrame:
    """(group, phrase, f) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in (c for b in batches for p in slices(b, "text") for c in grouped(p)):
            words, first, n = np.unique(own.numbers, return_index=True, return_counts=True)
            kept = ~own.stops[first]
            yield own.phrases(first[kept], n[kept], 1)

    rows = texts.mapInArrow(released(run), "group string, phrase string, f long")
    return rows.groupBy("group", "phrase").agg(F.sum("f").alias("f"))


def hashes_of(words: DataFrame) -> DataFrame:
    """(h) of the words of a level-1 table (group, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts = np.array([salt(g) for g in batch.column("group").to_pylist()], np.uint64)
            own = word_hashes(batch.column("phrase").cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([pa.array(mix64(salts * _FACTOR + own).view(np.int64))], names=["h"])

    return words.select("group", "phrase").mapInArrow(released(run), "h long")


def gram_counts(texts: DataFrame, k: int, frequent: Broadcast) -> DataFrame:
    """(h, f) of the k-grams whose two (k-1)-grams the filter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flushed() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "f"])

        for part in (p for b in batches for p in slices(b, "text")):
            for own in grouped(part):
                ids = own.ids()
                shorter = own.grams(ids, k - 1)
                there = own.whole(k - 1)
                there[there] = frequent.value.has(shorter[there])
                fits = np.flatnonzero(own.whole(k) & there[:-1] & there[1:])
                held.append(mix64(shorter[fits] * _FACTOR + ids[fits + k - 1]))  # the k-gram's, of its first k - 1 words'
            if sum(map(len, held)) > HELD:
                yield flushed()
        if held:
            yield flushed()

    return texts.mapInArrow(released(run), "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))


def phrase_counts(texts: DataFrame, levels: dict[int, Broadcast]) -> DataFrame:
    """(group, phrase, f) of the k-grams whose hash the filter of level k has, by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in (c for b in batches for p in slices(b, "text") for c in grouped(p)):
            ids = own.ids()
            for k, frequent in levels.items():
                hashes, fits = own.grams(ids, k), own.whole(k)
                fits[fits] = frequent.value.has(hashes[fits])
                first, n = distinct(own, np.flatnonzero(fits), hashes[fits], k)
                if len(n):
                    yield own.phrases(first, n, k)

    return texts.mapInArrow(released(run), "group string, phrase string, f long").groupBy("group", "phrase").agg(F.sum("f").alias("f"))


def distinct(own: Coded, at: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different k-gram at these places, and how often it stands there; the words decide, not the hashes."""
    order = np.argsort(hashes)
    hashes, at = hashes[order], at[order]
    new = np.append(True, hashes[1:] != hashes[:-1])[: len(at)]
    again = np.flatnonzero(~new)
    if all((own.numbers[at[again] + j] == own.numbers[at[again - 1] + j]).all() for j in range(k)):
        first = np.flatnonzero(new)
        return at[first], np.diff(np.append(first, len(at)))
    code = own.numbers[at].astype(np.int64)  # two phrases share a hash: number them word by word
    for j in range(1, k):
        _, code = np.unique(code * len(own.words) + own.numbers[at + j], return_inverse=True)
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    return at[first], n


def first_words(phrase: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), 1, n), " ")


def last_words(phrase: Column, behind: Column) -> Column:
    parts = F.split(phrase, " ")
    return F.array_join(F.slice(parts, behind + 1, F.size(parts)), " ")


def scored(levels: DataFrame) -> DataFrame:
    """Candidates (group, phrase, a, l, r, score) of the level table (group, phrase, k, f): the lowest cut of each."""
    cuts = levels.filter("k > 1").select("group", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", first_words(F.col("phrase"), F.col("cut")).alias("_left"), last_words(F.col("phrase"), F.col("cut")).alias("_right"))
    left = levels.select("group", F.col("phrase").alias("_left"), F.col("f").alias("l"))
    right = levels.select("group", F.col("phrase").alias("_right"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["group", "_left"]).join(right, ["group", "_right"])
    score = F.expr(f"cast(a as decimal(20, 0)) * {SCALE} div (cast(l as decimal(20, 0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("_low")
    return cuts.groupBy("group", "phrase").agg(F.first("a").alias("a"), lowest).select("group", "phrase", "a", "_low.l", "_low.r", "_low.score")


def absorbing(levels: DataFrame) -> DataFrame:
    """(group, phrase, longer): the most occurrences of a longer candidate that holds the phrase."""
    parts = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda at: F.array_join(F.slice(parts, at, n), " "))))
    inside = levels.filter("k > 2").select("group", F.explode(spans).alias("phrase"), F.col("f").alias("longer"))
    return inside.groupBy("group", "phrase").agg(F.max("longer").alias("longer"))


def mine(docs: DataFrame, text: str = "text", group: str = "lang", min_count: int = MIN_COUNT, most_words: int = MOST_WORDS, top: int = TOP) -> DataFrame:
    """(group, rank, phrase, a, l, r, n, score): the first `top` collocations of each group."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.encode(F.col(f"`{text}`").cast("string"), "utf-8").alias("text"), F.coalesce(F.col(f"`{group}`").cast("string"), F.lit(GROUP_OF_NULL)).alias("group"))
    every = written(word_counts(texts), "words")
    words = every.filter(F.col("f") >= min_count)
    filters = {1: filter_of(hashes_of(words))}
    for k in range(2, most_words + 1):
        level = written(gram_counts(texts, k, filters[k - 1]).filter(F.col("f") >= min_count).select("h"), "grams")
        filters[k] = filter_of(level)
        dropped(level)
    filters.pop(1).destroy()
    phrases = phrase_counts(texts, filters).filter(F.col("f") >= min_count)
    levels = words.unionByName(phrases) if filters else words
    levels = written(levels.withColumn("k", F.size(F.split("phrase", " "))), "levels")
    for f in filters.values():
        f.destroy()
    kept = scored(levels).join(absorbing(levels), ["group", "phrase"], "left")
    kept = kept.filter(f"longer IS NULL OR 100 * cast(longer as decimal(20, 0)) < {SHARE} * cast(a as decimal(20, 0))")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = Window.partitionBy("group", F.pmod(F.hash("phrase"), F.lit(PARTS))).orderBy(*order)
    kept = kept.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    totals = every.groupBy("group").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "group").select(F.col("group").alias(group), "rank", "phrase", "a", "l", "r", "n", "score")
