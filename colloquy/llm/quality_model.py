"""Quality classifier: a factorisation machine.

Features of a text: hashed words (root frequencies, of length 1), structure statistics in bins (each its own feature of
value 1), and the n_chars metadata in bins. score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); the
pairwise part takes linear time as half the sum over ranks of (sum v_i x_i)^2 - sum (v_i x_i)^2.

Training reads at most PER_CLASS labelled documents of each class (a documented bound; picked by a hash of their ids);
scoring reads whole texts, in one map pass without a shuffle.

Defined results: null and empty texts get a score from their structure alone; without labels of both classes the score
is the share of label 1 (0.5 without any); of labels that differ for an id the smallest counts, of rows that
share an id the one with the smallest hash is learnt from; a null doc_id counts as
the text 'null' in the split; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import Ids, add_columns, crc_mod

RANK = 8
WORDS = 1 << 14
BINS = 12
#: Structure statistics, then metadata; each has BINS bins.
STATISTICS = ("words", "characters", "symbols", "upper", "digits", "punctuation", "word_length", "distinct", "repeats", "lines", "line_length", "same_lines", "no_letter_words", "shout_words")
FEATURES = WORDS + BINS * (len(STATISTICS) + 1)
PER_CLASS = 3000
EPOCHS, RATE, DECAY, BATCH = 10, 0.05, 1e-5, 8
#: Features that are scored at once.
MOST_TERMS = 1 << 17
THRESHOLD = 0.3
_SYMBOL = re.compile(rb"[#*$%&|<>{}\[\]\\^~=+_@]")
_UPPER, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_PUNCTUATION = bytes(i for i in range(256) if chr(i) not in ".,;:!?'\"()-")


def bin_of(share: float) -> int:
    """Bins of a share between 0 and 1, finer near 0."""
    edges = (0.0, 0.003, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.35, 0.55, 0.8)
    return sum(share > e for e in edges)


def log_bin(n: float) -> int:
    return min(BINS - 1, int(np.log2(n + 1)))


def structure(text: str, words: list[bytes]) -> list[int]:
    """A bin for each of STATISTICS."""
    data = text.encode()
    n, size = max(len(words), 1), max(len(data), 1)
    letters = [w for w in words if not w.isascii() or w.upper() != w.lower()]
    lines = [x for x in data.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        log_bin(len(words)), log_bin(len(data) / 4), bin_of(len(_SYMBOL.findall(data)) / size),
        bin_of((len(data) - len(data.translate(None, _UPPER))) / size), bin_of((len(data) - len(data.translate(None, _DIGITS))) / size),
        bin_of(len(data.translate(None, _PUNCTUATION)) / size), min(BINS - 1, sum(map(len, words)) // n),
        bin_of(1 - len(set(words)) / n), bin_of(same / n), log_bin(len(lines)), log_bin(len(data) / max(len(lines), 1) / 4),
        bin_of(1 - len(set(lines)) / len(lines) if lines else 0.0), bin_of(1 - len(letters) / n),
        bin_of(sum(w.isupper() and len(w) > 1 for w in letters) / n),
    ]


def sparse(text: str | None, n_chars: int | None, ids: Ids) -> tuple[np.ndarray, np.ndarray]:
    """The features of a document that aren't 0, and their values."""
    text = text or ""
    words = text.encode().split()
    hashed = ids.array([w.lower() for w in words]) % np.uint64(WORDS)
    k, counts = np.unique(hashed.astype(np.int32), return_counts=True)
    x = np.sqrt(counts, dtype=np.float32)
    if len(x):
        x /= np.sqrt(np.square(x).sum())
    bins = [*structure(text, words), 0 if n_chars is None else min(BINS - 1, 1 + log_bin(max(n_chars, 0) / 4))]
    more = WORDS + np.arange(len(bins), dtype=np.int32) * BINS + np.array(bins, np.int32)
    return np.concatenate([k, more.astype(np.int32)]), np.concatenate([x, np.ones(len(bins), np.float32)])


class Rows:
    """Sparse rows one after another: features k, values x, and where each row starts (no row is empty)."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.size = np.array([len(k) for k, _ in rows], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.k = np.concatenate([k for k, _ in rows])
        self.x = np.concatenate([x for _, x in rows])
        self.row = np.repeat(np.arange(len(rows)), self.size)

    def take(self, rows: np.ndarray) -> Rows:
        return Rows([(self.k[a:b], self.x[a:b]) for a, b in zip(self.start[rows].tolist(), (self.start + self.size)[rows].tolist(), strict=True)])


class Machine:
    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray) -> None:
        self.bias, self.w, self.v = bias, w, v

    def terms(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The value before the sigmoid of each row, and the terms v_i x_i with their sums by row."""
        terms = self.v[rows.k] * rows.x[:, None]
        total = np.add.reduceat(terms, rows.start)
        pairs = 0.5 * (np.square(total) - np.add.reduceat(np.square(terms), rows.start)).sum(1)
        return self.bias + np.add.reduceat(self.w[rows.k] * rows.x, rows.start) + pairs, terms, total

    def raw(self, k: np.ndarray, x: np.ndarray) -> float:
        return float(self.terms(Rows([(k, x)]))[0][0])

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The scores of documents' sparse features, all at once for about MOST_TERMS features."""
        out, at = [np.empty(0)], 0
        size = np.cumsum([len(k) for k, _ in found])
        while at < len(found):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + MOST_TERMS)))
            out.append(sigmoid(self.terms(Rows(found[at:end]))[0].astype(np.float64)))
            at = end
        return np.concatenate(out)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Machine:
    """Gradient steps on BATCH rows at once with a rate per weight, the classes weighted alike."""
    rng = np.random.default_rng(9)
    y = np.array([y for y, _, _ in rows])
    w, v = np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, RANK)).astype(np.float32)
    if not 0 < y.sum() < len(y):
        share = float(y.mean()) if len(y) else 0.5
        return Machine(float(np.log((share + 1e-9) / (1 - share + 1e-9))), w, v * 0)
    every, model = Rows([(k, x) for _, k, x in rows]), Machine(0.0, w, v)
    seen_w, seen_v = np.full_like(w, 1e-2), np.full_like(v, 1e-2)
    weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            part = every.take(chosen)
            raw, terms, total = model.terms(part)
            pull = ((sigmoid(raw) - y[chosen]) * weight[chosen]).astype(np.float32)
            model.bias -= 0.01 * float(pull.sum())
            k, inverse = np.unique(part.k, return_inverse=True)
            by_term = pull[part.row] * part.x
            g = np.bincount(inverse, by_term, len(k)).astype(np.float32) + DECAY * w[k]
            seen_w[k] += g * g
            w[k] -= RATE * g / np.sqrt(seen_w[k])
            g = np.zeros((len(k), RANK), np.float32)
            np.add.at(g, inverse, by_term[:, None] * (total[part.row] - terms))
            g += DECAY * v[k]
            seen_v[k] += g * g
            v[k] -= RATE * g / np.sqrt(seen_v[k])
    return model


def n_chars_of(docs: DataFrame) -> Column:
    return F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def fitted(docs: DataFrame, labels: DataFrame, labelled: Column) -> Machine:
    """A machine from a bounded sample of the labelled documents, of each class the ones with the smallest id hashes."""
    own = labels.filter(labelled & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit(92))
    picked = own.filter("quality = 0").orderBy(key).limit(PER_CLASS).unionByName(own.filter("quality = 1").orderBy(key).limit(PER_CLASS))
    # At most 2 * PER_CLASS ids: small enough to broadcast.
    sample = docs.select("doc_id", F.col("text").cast("string").alias("text"), n_chars_of(docs).alias("n_chars")).join(F.broadcast(picked.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    first = F.min(F.struct(F.xxhash64("text", "n_chars"), "text", "n_chars", "quality")).alias("_first")  # of rows that share an id
    sample = sample.groupBy("doc_id").agg(first).select("doc_id", "_first.text", "_first.n_chars", "_first.quality")
    state: dict = {}

    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        ids = state.setdefault("ids", Ids())
        found = [sparse(t, n, ids) for t, n in zip(part.column("text").to_pylist(), part.column("n").to_pylist(), strict=True)]
        return {"k": pa.array([k.tobytes() for k, _ in found], pa.binary()), "x": pa.array([x.tobytes() for _, x in found], pa.binary())}

    rows = add_columns(sample.select("quality", "text", "n_chars", "doc_id"), {"text": F.col("text"), "n": F.col("n_chars")}, {"k": "binary", "x": "binary"}, make, "text").select("doc_id", "quality", "k", "x").collect()
    return train([(r["quality"], np.frombuffer(r["k"], np.int32), np.frombuffer(r["x"], np.float32)) for r in sorted(rows, key=lambda r: r["doc_id"])])


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """docs with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x (RANK + 1) x 4 bytes: 0.6 MB
    state: dict = {}

    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        ids = state.setdefault("ids", Ids())
        found = [sparse(t, n, ids) for t, n in zip(part.column("text").to_pylist(), part.column("n").to_pylist(), strict=True)]
        scores = shared.value.scores(found)
        return {"score": pa.array(scores, pa.float64()), "predicted": pa.array((scores >= THRESHOLD).astype(np.int32))}

    return add_columns(docs, {"text": F.col("text").cast("string"), "n": n_chars_of(docs)}, {"score": "double", "predicted": "int"}, make, "text")


def is_held_out() -> Column:
    return crc_mod(F.col("doc_id"), 5) == 0


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document; learns from labels of rows that aren't held out."""
    model = fitted(docs, labels, ~is_held_out())
    own = [c for c in ("text", "n_chars") if c in docs.columns]
    return score(docs.select("doc_id", is_held_out().alias("held_out"), *own), model).drop(*own)
