"""MinHash near-duplicates with circulant permutations, banding and exact Jaccard verification.

1. A document's set: hashes of its distinct 5-word shingles. One permutation (sigma) of the 64-bit hashes, then a second
   one (pi) that is shifted circularly by k for the k-th coordinate: h_k = min pi(sigma(x) + k). Documents with equal
   sets form a class, of which the smallest doc_id goes on.
2. Bands of ROWS coordinates are hashed to buckets. In each bucket of several classes, each member is compared with the
   bucket's smallest (its hub): pairs whose signatures agree in at least PLAUSIBLE of the coordinates are verified on
   their full sets, and the links' connected components are joined. This is linear in the members.
3. What may be left are links between two members that aren't hubs and aren't joined yet. In buckets whose other members
   still belong to several components, signatures are compared in blocks of BLOCK members, and of the plausible links
   between components a spanning forest is kept. Components that these connect are clusters.
4. Within each cluster, again by blocks, all exact intersections of full sets between different components are counted
   at once (a matrix product over shared shingles), and a spanning forest of the links with a Jaccard similarity of at
   least 75/100 joins them. Blocks of one and the same component are never compared with each other, so that a large
   group that step 2 has joined costs only as much as there is beside it.

A pair at a similarity of 0.75 is missed by all 32 bands of 4 with a chance of 5e-6, and by the comparison of signatures
(a standard deviation of 0.038 at 128 coordinates) with one of about 4e-6. No bucket, cluster or partner list is capped.
The comparisons of steps 3 and 4 grow with the product of the sizes of components that share a bucket and aren't linked,
spread over tasks by block pairs.

Defined results: null or empty texts (or without words) have no shingles and are linked with nothing; fewer than five
words are one shingle; documents with a null doc_id are never linked (component null, kept); rows that repeat a doc_id
get a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import Ids, bounded_batches, changes, dropped, mix64, released, runs, slices, windows, written
from colloquy.llm.components import components

SHINGLE = 5
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
PLAUSIBLE = 0.58
#: Members of a block in the comparison of signatures, and of full sets.
BLOCK, SET_BLOCK = 1024, 128
NUMERATOR, DENOMINATOR = 75, 100
_SIGMA, _PI = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A47)


def shingles(text: bytes | None, ids: Ids) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(ids.array(words), min(SHINGLE, len(words))))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The circulant MinHash signature (32-bit minima) of each set, none of them empty."""
    out = np.empty((len(sets), COORDINATES), np.uint32)
    start = 0
    while start < len(sets):  # about 32k shingles at once stay in the processor's cache
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end]) <= 32_768):
            size += len(sets[end])
            end += 1
        placed = mix64(np.concatenate(sets[start:end]) ^ _SIGMA)
        offsets = np.cumsum([0, *[len(s) for s in sets[start : end - 1]]])
        x, t = np.empty_like(placed), np.empty_like(placed)
        for k in range(COORDINATES):
            np.add(placed, np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1), out=x)  # the circular shift
            np.bitwise_xor(x, _PI, out=x)
            for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
                np.right_shift(x, np.uint64(shift), out=t)
                np.bitwise_xor(x, t, out=x)
                np.multiply(x, np.uint64(factor), out=x)
            out[start:end, k] = np.minimum.reduceat(x, offsets) >> np.uint64(32)
        start = end
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band; the band's number is part of it."""
    values = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(signature), 1), np.uint64)
    for r in range(ROWS):
        key = mix64(key ^ values[:, :, r]) + values[:, :, r]
    return key.view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (a 128-bit digest of the set, null if empty), signature and its buckets, a row each."""
    state: dict = {}
    schema = "doc_id long, n_shingles long, class binary, signature binary, buckets array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = state.setdefault("ids", Ids())
        for part in (p for b in batches for p in slices(b, "text")):
            sets = [shingles(t, ids) for t in part.column("text").to_pylist()]
            full = [s for s in sets if len(s)]
            sig = signatures(full) if full else np.empty((0, COORDINATES), np.uint32)
            keys = band_keys(sig) if full else np.empty((0, BANDS), np.int64)
            rank = np.cumsum([bool(len(s)) for s in sets]) - 1
            has = [bool(len(s)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if h else None for s, h in zip(sets, has, strict=True)], pa.binary()),
                    pa.array([sig[k].tobytes() if h else None for k, h in zip(rank, has, strict=True)], pa.binary()),
                    pa.array([keys[k] if h else None for k, h in zip(rank, has, strict=True)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "class", "signature", "buckets"],
            )

    return ids_and_texts(docs).mapInArrow(released(run), schema)


def ids_and_texts(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "utf-8").alias("text"))


class Forest:
    """Union-find over the rows of a block pair, rows of one component joined from the start; keeps edges that join two trees."""

    def __init__(self, owners: list[int]) -> None:
        first: dict[int, int] = {}
        self.parent, self.edges = [first.setdefault(c, i) for i, c in enumerate(owners)], []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.edges.append((a, b))


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Coordinates that each row of a has in common with the same row of b."""
    return (a == b).sum(1)


def plausible(signature: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of rows that agree in enough coordinates, the most alike first."""
    n = len(signature)
    agree = np.zeros((n, n), np.uint8)
    for k in range(COORDINATES):
        column = signature[:, k]
        agree += column[:, None] == column[None, :]
    a, b = np.nonzero(np.triu(agree >= PLAUSIBLE * COORDINATES, 1))
    order = np.argsort(-agree[a, b].astype(np.int64), kind="stable")
    yield from zip(a[order].tolist(), b[order].tolist(), strict=True)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections, as a matrix product over the shingles that several sets share."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    place = np.full(len(values), -1, np.int64)
    place[shared] = np.arange(len(shared))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    out = np.zeros((n, n), np.float32)
    for at in range(0, len(shared), 4096):
        part = (column >= at) & (column < at + 4096)
        m = np.zeros((n, min(4096, len(shared) - at)), np.float32)
        m[row[part], column[part] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def linked(common: np.ndarray | int, size_a: np.ndarray | int, size_b: np.ndarray | int) -> np.ndarray | bool:
    """Whether a Jaccard similarity is 75/100 or more, exactly."""
    return DENOMINATOR * common >= NUMERATOR * (size_a + size_b - common)


def links(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Pairs of rows whose sets have a Jaccard similarity of 75/100 or more."""
    if len(sets) == 2:
        if linked(len(np.intersect1d(*sets, assume_unique=True)), len(sets[0]), len(sets[1])):
            yield 0, 1
        return
    sizes = np.array([len(s) for s in sets], np.int64)
    a, b = np.nonzero(np.triu(linked(intersections(sets), sizes[:, None], sizes[None, :]), 1))
    yield from zip(a.tolist(), b.tolist(), strict=True)


def dealt(members: DataFrame, key: str, block: int) -> DataFrame:
    """members (key, component, ...) with _i, _j: the pairs of blocks of its key that a row takes part in.

    A key with more than `block` members has blocks: a component with more than `block` of them has blocks of its own,
    into which a hash of the node deals them, all others share blocks. Pairs of blocks of one component are left out.
    """
    counts = written(members.groupBy(key, "component").agg(F.count("*").alias("_n")), "counts")
    sizes = counts.groupBy(key).agg(F.sum("_n").alias("_all"), F.sum(F.when(F.col("_n") <= block, F.col("_n")).otherwise(0)).alias("_few"))
    sizes = sizes.select(key, "_all", F.ceil(F.col("_few") / block).cast("int").alias("_shared"))
    own = counts.filter(F.col("_n") > block).withColumn("_own", F.ceil(F.col("_n") / block).cast("int"))
    own = own.join(sizes, key)
    before = Window.partitionBy(key).orderBy("component")  # one row for each block-sized component of a key
    own = own.withColumn("_to", (F.col("_shared") + F.sum("_own").over(before)).cast("int"))
    own = written(own.select(key, "component", "_own", "_to", F.col("_all").alias("_total")), "own")
    ends = own.groupBy(key).agg(F.max("_to").alias("_blocks"))
    sizes = written(sizes.join(ends, key, "left").select(key, "_all", "_shared", F.coalesce("_blocks", "_shared").alias("_blocks")), "sizes")
    placed = members.join(sizes, key).join(own.select(key, "component", "_own", "_to"), [key, "component"], "left")
    place = F.pmod(F.xxhash64("node"), F.coalesce("_own", F.greatest("_shared", F.lit(1)))).cast("int")
    at = F.when(F.col("_all") <= block, F.lit(0)).when(F.col("_own").isNull(), place).otherwise(F.col("_to") - F.col("_own") + place)
    placed = placed.withColumn("_at", at)
    # A single block meets itself; of a large component's blocks none meets another of the same.
    others = F.when(F.col("_all") <= block, F.array(F.lit(0))).otherwise(F.expr("filter(sequence(0, _blocks - 1), x -> _own is null or x < _to - _own or x >= _to)"))
    placed = placed.withColumn("_other", F.explode(others))
    rest = [c for c in members.columns if c != key]
    return placed.select(key, F.least("_at", "_other").alias("_i"), F.greatest("_at", "_other").alias("_j"), *rest)


def compared(members: DataFrame, key: str, value: str, block: int, find) -> DataFrame:
    """A spanning forest (a, b: components) of the pairs between components that `find` gives for members with equal keys.

    members: key, node, component, value. A task works on a pair of blocks of about 2 * block rows at most. Groups are
    streamed from a sort by key, never collected as a whole partition.
    """
    keys = [key, "_i", "_j"]
    sorted_rows = dealt(members, key, block).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, keys):
            rows = rows.combine_chunks()
            cuts = [0, *changes(rows, keys).tolist(), rows.num_rows]
            owners, values = rows.column("component").to_numpy(), rows.column(value).to_pylist()
            out_a, out_b = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b - a < 2 or (owners[a:b] == owners[a]).all():
                    continue
                forest = Forest(owners[a:b].tolist())
                for x, y in find(values[a:b]):
                    forest.join(x, y)
                for x, y in forest.edges:
                    out_a.append(owners[a + x])
                    out_b.append(owners[a + y])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return sorted_rows.mapInArrow(released(run), "a long, b long")


def plausible_of(values: list[bytes]) -> Iterator[tuple[int, int]]:
    return plausible(np.frombuffer(b"".join(values), np.uint32).reshape(len(values), COORDINATES))


def links_of(values: list[bytes]) -> Iterator[tuple[int, int]]:
    return links([np.frombuffer(v, np.uint64) for v in values])


def plausible_pairs(pairs: DataFrame) -> DataFrame:
    """Those of pairs (node, hub, and the signatures of both) that agree in enough coordinates, as node and hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, COORDINATES) for c in ("signature", "hub_signature"))
            yield batch.select(["node", "hub"]).filter(pa.array(agreement(a, b) >= PLAUSIBLE * COORDINATES))

    return pairs.mapInArrow(released(run), "node long, hub long")


def star_links(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) among stars (node, hub), verified on their full sets (node, shingles).

    A hub's set goes to chunks of about SET_BLOCK of its nodes, so that a hub of very many is no task of its own.
    """
    counts = stars.groupBy("hub").agg(F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("_chunks"))
    counts = written(counts, "hubs")
    chunk = F.pmod(F.xxhash64("node"), F.col("_chunks")).cast("int")
    nodes = stars.join(counts, "hub").select("hub", chunk.alias("_chunk"), "node").join(sets, "node")
    hubs = counts.withColumnRenamed("hub", "node").join(sets, "node")
    hubs = hubs.select(F.col("node").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"), "node", "shingles")
    columns, keys = ["hub", "_chunk", "node", "shingles"], ["hub", "_chunk"]
    rows = nodes.select(*columns).unionByName(hubs).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, keys):
            part = part.combine_chunks()
            cuts = [0, *changes(part, keys).tolist(), part.num_rows]
            hub, node, values = part.column("hub").to_numpy(), part.column("node").to_numpy(), part.column("shingles")
            out_a, out_b = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = [np.frombuffer(values[i].as_py(), np.uint64) for i in range(a, b) if node[i] == hub[i]]
                for i in range(a, b):
                    if node[i] != hub[i]:
                        s = np.frombuffer(values[i].as_py(), np.uint64)
                        if any(linked(len(np.intersect1d(s, h, assume_unique=True)), len(s), len(h)) for h in own):
                            out_a.append(node[i])
                            out_b.append(hub[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(released(run), "a long, b long")


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node (doc_id) and its set as bytes, for the documents among nodes; a set of each text where an id repeats.

    nodes is a written table, so that its size is known: few ids are broadcast and no text is shuffled; beyond Spark's
    broadcast threshold both sides are dealt by id.
    """
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = state.setdefault("ids", Ids())
        for part in (p for b in batches for p in slices(b, "text")):
            sets = [shingles(t, ids).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    texts = ids_and_texts(docs).join(nodes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return texts.mapInArrow(released(run), "node long, shingles binary").dropDuplicates(["node", "shingles"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per document."""
    sketched = written(sketch(docs), "sketch")
    classes = sketched.filter("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("node"))
    classes = written(classes, "classes")
    # A doc_id that repeats with another text is a node of each of its sets; only the sets' smallest ids go on.
    nodes = sketched.join(classes, (sketched["doc_id"] == classes["node"]) & (sketched["class"] == classes["class"])).select("node", "signature", "buckets")
    nodes = written(nodes.dropDuplicates(["node", "signature"]), "nodes")
    signed = nodes.select("node", "signature")

    # Each member of a bucket against its hub.
    bucketed = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = bucketed.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("_m")).filter("_m > 1").select("bucket", "hub")
    members = written(bucketed.join(shared, "bucket").select("bucket", "node", "hub"), "members")
    pairs = written(members.filter("node <> hub").select("node", "hub").distinct(), "pairs")
    both = pairs.join(signed, "node").join(signed.select(F.col("node").alias("hub"), F.col("signature").alias("hub_signature")), "hub")
    stars = written(plausible_pairs(both).distinct(), "stars")
    needed = written(stars.select("node").unionByName(stars.select(F.col("hub").alias("node"))).distinct(), "needed")
    sets = written(full_sets(docs, needed), "sets")
    groups = components(star_links(stars, sets))
    dropped(pairs, stars, needed, sets)

    # What is left: members that aren't hubs, of buckets with several components.
    owned = members.filter("node <> hub").join(groups, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    owned = written(owned, "owned")
    several = owned.groupBy("bucket").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).filter("_a <> _b").select("bucket")
    left = written(owned.join(several, "bucket", "left_semi").join(signed, "node").select("bucket", "node", "component", "signature"), "left")
    connected = components(compared(left, "bucket", "signature", BLOCK, plausible_of))
    clusters = connected.select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    every = nodes.select("node").distinct().join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    clustered = written(every.join(clusters, "component"), "clustered")
    sets = full_sets(docs, clustered).join(clustered, "node")
    sets = written(sets.select("cluster", "node", "component", "shingles"), "sets")
    larger = components(compared(sets, "cluster", "shingles", SET_BLOCK, links_of))
    joined = larger.select(F.col("node").alias("component"), F.col("component").alias("_larger"))
    groups_of = groups.join(joined, "component", "left").select("node", F.coalesce("_larger", "component").alias("component"))
    # Components of one node that were joined only now stand in no group yet.
    alone = joined.join(groups.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("_larger").alias("component"))

    named = classes.join(groups_of.unionByName(alone), "node", "left").select("class", F.coalesce("component", "node").alias("component_id"))
    named = written(named, "named")
    dropped(nodes, members, owned, left, connected, clustered, sets, groups, larger, classes)
    named = named.withColumnRenamed("class", "_class")
    out = sketched.select("doc_id", "n_shingles", "class").join(named, F.col("class") == F.col("_class"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, with the columns of docs; of rows that repeat a kept doc_id, one."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    repeated = docs.groupBy(F.col("doc_id").alias("_again")).count().filter("count > 1 and _again is not null").select("_again")
    if not repeated.limit(1).count():
        return left
    again = left["doc_id"] == F.col("_again")
    return left.join(repeated, again, "left_anti").unionByName(left.join(repeated, again, "left_semi").dropDuplicates(["doc_id"]))
