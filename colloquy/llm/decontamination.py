"""Benchmark decontamination by greedy string tiling.

Words of documents and items are compared without case and punctuation. Seeds are runs of MIN_MATCH words; every
document's seeds are joined with the items' seeds in a map pass over the documents, against a broadcast index of the
items. An item goes on only if the words under its shared seeds could cover enough of it, which is counted for all items
at once before any pair is built. Then running Karp-Rabin finds the longest common runs of unmarked words, marks them,
and goes on with shorter ones. As each item word is in one tile at most and tiles may stand anywhere, reordered passages
count in full. A document is contaminated by an item if the tiles cover at least COVERAGE of the item's words.

Very common seeds (a stem that thousands of items share) cost a document one vectorised count: items that share the same
words with it are tiled once together, and the counts of documents that share the same seeds are remembered.

A benchmark of at most BLOCK_SEEDS words is one block: one broadcast, one map pass, nothing shuffled. A larger one goes
through in groups of GROUP_BLOCKS blocks: a pass over the documents keeps those with a seed of the group (a Bloom filter
of FILTER_BYTES is broadcast), which are written; each block then goes over these alone, one broadcast after the other.
So no broadcast grows with the benchmark, and any benchmark is compared as a whole.

Defined results: null or empty texts (documents or items) match nothing; an item of fewer than MIN_MATCH words is found
as a whole; repeated items are separate items; repeated documents are judged alike; other columns are ignored (`matches`)
or kept (`clean`).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import Ids, bounded_batches, keep_where, mix64, slices, windows, written

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_SEEDS = 1_000_000
GROUP_BLOCKS, FILTER_BYTES, PROBES = 16, 64 << 20, 4
#: Sets of shared seeds whose counts a worker remembers.
MOST_KNOWN = 512
#: Everything in ASCII but digits and letters separates words.
_TABLE = bytes(i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256))
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_TABLE).split() if text else []


Item = tuple[int, list[bytes]]


class Index:
    """The seeds of a block of items: sorted hashes, and for each the places (in all items' words, one after another)."""

    def __init__(self, items: list[Item], coverage: float = COVERAGE) -> None:
        ids = Ids(1 << 60)
        own = [(item, ids.array(w)) for item, w in items if w]
        self.ids = [item for item, _ in own]
        self.size = np.array([len(w) for _, w in own], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1].astype(np.int64)
        self.words = np.concatenate([w for _, w in own]) if own else np.empty(0, np.uint64)
        self.width = np.minimum(MIN_MATCH, self.size)
        self.item = np.repeat(np.arange(len(own)), self.size)
        seeds = [windows(w, min(MIN_MATCH, len(w))) for _, w in own]
        every = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        place = np.concatenate([at + np.arange(len(s)) for at, s in zip(self.start, seeds, strict=True)]) if seeds else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.place = place[order]
        self.hashes, self.first = np.unique(every[order], return_index=True)
        self.end = np.append(self.first[1:], len(every))
        self.widths = sorted(set(self.width.tolist()))
        self.least = np.maximum(coverage * self.size, 1)
        self.known: dict[bytes, list] = {}

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in a document where a seed of the items stands, the seed's number, and its width."""
        at, seed, width = [], [], []
        for n in self.widths:
            own = windows(words, n)
            if not len(own) or not len(self.hashes):
                continue
            k = np.searchsorted(self.hashes, own)
            found = np.flatnonzero(self.hashes[np.minimum(k, len(self.hashes) - 1)] == own)
            if len(found):
                at.append(found)
                seed.append(k[found])
                width.append(np.full(len(found), n))
        if not at:
            none = np.empty(0, np.int64)
            return none, none, none
        return np.concatenate(at), np.concatenate(seed), np.concatenate(width)

    def groups(self, seeds: np.ndarray) -> list[tuple[list[int], int, list[int]]]:
        """Items that these distinct seeds can cover enough of, by the words they cover: (words, width, items).

        The words are in order, with a separator (a negative number, equal to nothing) where words are left out.
        """
        key = seeds.tobytes()
        if key in self.known:
            return self.known[key]
        count = self.end[seeds] - self.first[seeds]
        places = self.place[np.repeat(self.first[seeds] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        places.sort()
        item = self.item[places]
        covers = np.minimum(self.width[item], np.diff(places, append=1 << 60))
        edge = np.flatnonzero(np.diff(item, prepend=-1))
        covered = np.add.reduceat(covers, edge)
        enough = np.flatnonzero(covered >= self.least[item[edge]])
        found: dict[tuple[int, ...], tuple[int, list[int]]] = {}
        stops = np.append(edge[1:], len(places))
        for k in enough.tolist():
            own = places[edge[k] : stops[k]]
            i = int(item[edge[k]])
            words = joined(segments(self.words, own, int(self.width[i])), -(1 << 40))
            found.setdefault(tuple(words), (int(self.width[i]), []))[1].append(i)
        if len(self.known) >= MOST_KNOWN:
            self.known.clear()
        self.known[key] = out = [(list(words), width, items) for words, (width, items) in found.items()]
        return out


def segments(words: np.ndarray, at: np.ndarray, width: int) -> list[tuple[int, ...]]:
    """The stretches of words under windows of `width` words that start at the places `at`, which are sorted."""
    cut = np.flatnonzero(np.diff(at) > width) + 1
    starts, ends = at[np.append(0, cut)], at[np.append(cut, len(at)) - 1] + width
    return [tuple(words[a:b].tolist()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def joined(parts: list[tuple[int, ...]], separator: int) -> list[int]:
    """The parts with separators between, each of them another number: separator, separator - 1, ..."""
    out: list[int] = []
    for k, part in enumerate(parts):
        if k:
            out.append(separator - k)
        out += part
    return out


def rolling(values: list[int], length: int) -> list[int]:
    """Karp-Rabin hashes of all runs of `length` values."""
    if len(values) < length:
        return []
    top, h = pow(_BASE, length - 1, _MOD), 0
    for v in values[:length]:
        h = (h * _BASE + v) % _MOD
    out = [h]
    for gone, v in zip(values, values[length:], strict=False):
        h = ((h - gone * top) * _BASE + v) % _MOD
        out.append(h)
    return out


def free_runs(marked: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """Unmarked stretches of at least `length`."""
    start = 0
    for i in range(len(marked) + 1):
        if i == len(marked) or marked[i]:
            if i - start >= length:
                yield start, i
            start = i + 1


def tile(doc: list[int], item: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, length) of tiles, longest first, none overlapping another.

    For each search length, from the item's length down, the unmarked runs of both texts are hashed (Karp-Rabin) and
    equal ones are checked word by word. Lengths without a match are skipped by halving: a run of length s implies runs
    of every shorter length. Of the runs of one length those that come first are marked first.
    """
    doc_marked, item_marked = [False] * len(doc), [False] * len(item)
    tiles: list[tuple[int, int, int]] = []

    def matches(length: int) -> Iterator[tuple[int, int]]:
        """Pairs of places in order, for as long as both runs are unmarked when they come up."""
        table: dict[int, list[int]] = defaultdict(list)
        for a, b in free_runs(item_marked, length):
            for k, h in enumerate(rolling(item[a:b], length)):
                table[h].append(a + k)
        if not table:
            return
        for a, b in free_runs(doc_marked, length):
            taken = a  # the run's words before it are marked
            for k, h in enumerate(rolling(doc[a:b], length)):
                i = a + k
                places = table.get(h)
                if not places or i < taken:
                    continue
                for j in places:
                    if not any(item_marked[j : j + length]) and doc[i : i + length] == item[j : j + length]:
                        yield i, j
                        if doc_marked[i]:
                            taken = i + length
                            break
                table[h] = [j for j in places if not any(item_marked[j : j + length])]

    low, high = min_match, len(item)
    while low <= high and next(matches(low), None):
        best, bottom, top = low, low + 1, high
        while bottom <= top:  # the longest length with a match
            middle = (bottom + top) // 2
            if next(matches(middle), None):
                best, bottom = middle, middle + 1
            else:
                top = middle - 1
        for i, j in matches(best):
            doc_marked[i : i + best] = [True] * best
            item_marked[j : j + best] = [True] * best
            tiles.append((i, j, best))
        high = best
    return tiles


def near(words: np.ndarray, at: np.ndarray, width: int, most: int) -> list[int]:
    """A document's words at shared seeds, separated where words are left out.

    Of equal stretches the first `most` are kept: as many tiles as there can be find room in them.
    """
    seen: Counter = Counter()
    parts = []
    for part in segments(words, at, width):
        seen[part] += 1
        if seen[part] <= most:
            parts.append(part)
    return joined(parts, -1)


def judged(index: Index, words: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(item_id, tiles, covered words, item words) of the items that contaminate a document."""
    at, seed, width = index.hits(words)
    if not len(at):
        return []
    out = []
    for item_words, own_width, items in index.groups(np.unique(seed)):
        own = windows(np.array([w if w >= 0 else 0 for w in item_words], np.uint64), own_width)
        k = np.searchsorted(index.hashes, own)
        k = np.minimum(k, len(index.hashes) - 1)
        these = np.unique(k[index.hashes[k] == own])
        places = np.sort(at[np.isin(seed, these) & (width == own_width)])
        tiles = tile(near(words, places, own_width, len(item_words) // own_width), item_words, own_width)
        covered = sum(length for _, _, length in tiles)
        out += [(index.ids[i], len(tiles), covered, int(index.size[i])) for i in items if covered >= index.least[i]]
    return sorted(out, key=lambda m: (m[0] is None, m))


def blocks(benchmark: DataFrame, most: int) -> Iterator[list[Item]]:
    """The items in blocks of at most `most` words (a longer item is a block of its own), read through an iterator."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        words = words_of(row["text"])
        if held and size + len(words) > most:
            yield held
            held, size = [], 0
        held.append((row["item_id"], words))
        size += len(words)
    if held:
        yield held


class Filter:
    """A Bloom filter of seeds, of a fixed size."""

    def __init__(self, size: int = FILTER_BYTES) -> None:
        self.bits, self.widths = np.zeros(size, np.uint8), set()

    def probe(self, seeds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The byte and bit of the k-th probe of each seed."""
        h = mix64(seeds + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(8 * len(self.bits))
        return (h >> np.uint64(3)).astype(np.int64), np.uint8(1) << (h & np.uint64(7)).astype(np.uint8)

    def add(self, items: list[Item]) -> None:
        ids = Ids(1 << 60)
        for _, words in items:
            if words:
                width = min(MIN_MATCH, len(words))
                self.widths.add(width)
                own = windows(ids.array(words), width)
                for k in range(PROBES):
                    np.bitwise_or.at(self.bits, *self.probe(own, k))

    def finds(self, words: np.ndarray) -> bool:
        """Whether a document may hold a seed."""
        for width in self.widths:
            left = windows(words, width)
            for k in range(PROBES):
                at, bit = self.probe(left, k)
                left = left[self.bits[at] & bit != 0]
            if len(left):
                return True
        return False


FOUND = ("item_id", "n_tiles", "covered_words", "item_words")


def found_by(docs: DataFrame, block: list[Item], coverage: float) -> DataFrame:
    """doc_id, the digest of the text and a match, for each document (doc_id, _text_key, text) and item of one block."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_SEEDS words, or one longer item
    kind = docs.schema["doc_id"].dataType.simpleString()
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not state:
            state.update(index=Index(shared.value, coverage), ids=Ids())
        for part in (p for b in batches for p in slices(b, "text")):
            rows = [judged(state["index"], state["ids"].array(words_of(t))) for t in part.column("text").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
            made = [pa.array([m[k] for r in rows for m in r], pa.int64()) for k in range(len(FOUND))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("_text_key").take(at), *made], names=["doc_id", "_text_key", *FOUND])

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, f"doc_id {kind}, _text_key string, " + ", ".join(f"{c} long" for c in FOUND))


def all_found(docs: DataFrame, benchmark: DataFrame, coverage: float, block_seeds: int) -> DataFrame:
    """found_by of every block. Beyond one block, only documents with a seed of a group of blocks go to its blocks."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    docs = docs.select("doc_id", F.md5(F.encode(text, "utf-8")).alias("_text_key"), text.alias("text"))
    every = blocks(benchmark, block_seeds)
    first, second = next(every, []), next(every, None)
    if second is None:
        return found_by(docs, first, coverage)
    waiting: Iterator[list[Item]] = (b for some in ([first, second], every) for b in some)
    out = None
    while (group := written_blocks(spark, waiting))[0]:
        paths, seen = group
        shared = spark.sparkContext.broadcast(seen)
        state: dict = {}

        def may_match(texts: list[str | None], shared=shared, state=state) -> list[bool]:
            ids = state.setdefault("ids", Ids())
            return [shared.value.finds(ids.array(words_of(t))) for t in texts]

        near_docs = written(keep_where(docs, may_match), "seeded")
        for path in paths:
            block = [(r["item_id"], r["words"]) for r in spark.read.parquet(path).toLocalIterator()]
            part = written(found_by(near_docs, block, coverage), "found")
            out = part if out is None else out.unionByName(part)
        shared.destroy()
    return out


def written_blocks(spark, waiting: Iterator[list[Item]]) -> tuple[list[str], Filter]:
    """The next GROUP_BLOCKS blocks, written into the shared folder one by one, and the filter of their seeds."""
    paths, seen = [], Filter()
    for block in waiting:
        seen.add(block)
        df = spark.createDataFrame(pa.table({"item_id": pa.array([i for i, _ in block], pa.int64()), "words": pa.array([w for _, w in block], pa.list_(pa.binary()))}))
        paths.append(written(df, "block")._written_to)
        if len(paths) == GROUP_BLOCKS:
            break
    return paths, seen


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """A row for each document and item that contaminates it."""
    found = all_found(docs, benchmark, coverage, block_seeds)
    return found.select("doc_id", *FOUND, (F.col("covered_words") / F.col("item_words")).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """docs without the contaminated ones, with the columns of docs."""
    every = blocks(benchmark, block_seeds)
    first, second = next(every, []), next(every, None)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)
        state: dict = {}

        def good(texts: list[str | None]) -> list[bool]:
            if not state:
                state.update(index=Index(shared.value, coverage), ids=Ids())
            return [not judged(state["index"], state["ids"].array(words_of(t))) for t in texts]

        return keep_where(docs, good)
    gone = written(all_found(docs, benchmark, coverage, block_seeds).select(F.col("_text_key").alias("_gone")).distinct(), "contaminated")
    # The digests of contaminated texts; Spark broadcasts them only while they are few, else both sides are dealt by digest.
    return docs.join(gone, F.md5(F.encode(F.col("text").cast("string"), "utf-8")) == F.col("_gone"), "left_anti")
