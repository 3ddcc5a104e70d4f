"""Language ID by error-correcting output codes.

Each language has a codeword of bits. One linear classifier per bit (logistic loss, on hashed byte n-grams of the
lower-cased letters of a text) predicts it. Decoding adds up the loss of each language's codeword under the bits'
margins and takes the language of the smallest loss; where the second is within AMBIGUOUS of it, the text is flagged.

Training covers every language. It reads at most PER_LANGUAGE labelled rows of each, SAMPLE_ROWS in all, but LEAST_ROWS of
each however many there are (documented bounds; rows are picked by a hash of id and text, repeated rows count once);
prediction reads whole texts, in one map pass without a shuffle.

Defined results: a null text or one without a letter is `und` with score 0; without any labelled row every text is
`und`; ties go to the first language by name; a null doc_id counts as the text 'null' in the split; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import add_columns, bounded_batches, crc_mod, dropped, keep_where, released, slices, written

DIMENSIONS = 4096
PER_LANGUAGE, LEAST_ROWS = 800, 8
KEY_PARTS = 64
#: Rows of the sample in all (8 KB each on the driver); with many languages each gets its share.
SAMPLE_ROWS = 6400
AMBIGUOUS = 0.5
EPOCHS, RATE, BATCH = 6, 0.4, 32
#: Bits of a codeword: all splits of up to 5 languages, else this many random ones, for more than 64 as the logarithm grows.
RANDOM_BITS = 31
#: Code comparisons and loss terms at once.
MOST_TERMS = 1 << 22
_SPACES = bytes(i if 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256))


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each of n languages."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 5:  # every split into two non-empty parts, once
        columns = [[1 if i == 0 or i in chosen else -1 for i in range(n)] for k in range(n - 1) for chosen in combinations(range(1, n), k)]
        return np.array(columns, np.float32).T
    rng = np.random.default_rng(15)
    bits = max(RANDOM_BITS, int(np.ceil(RANDOM_BITS * np.log2(n) / 6)))
    if n * n > MOST_TERMS:  # too many to compare all pairs; the codes only have to differ
        while len(np.unique(codes := rng.choice(np.array([-1, 1], np.float32), (n, bits)), axis=0)) < n:
            pass
        return codes
    tried = [rng.choice(np.array([-1, 1], np.float32), (n, bits)) for _ in range(200 if n <= 200 else 10)]
    return max(tried, key=lambda c: (np.abs(c.sum(0)).max() < n, -int((c @ c.T - 2 * bits * np.eye(n)).max())))


def features(texts: list[str | None]) -> np.ndarray:
    """A row of hashed byte 2- and 3-gram frequencies for each whole text: square roots, of length 1."""
    out = np.empty((len(texts), DIMENSIONS), np.float32)
    for i, text in enumerate(texts):
        data = b" ".join([b"", *(text or "").lower().encode().translate(_SPACES).split(), b""])
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
        grams = np.concatenate([two, three])
        grams ^= grams >> np.uint32(15)
        grams *= np.uint32(0x2C1B3C6D)
        out[i] = np.bincount(grams >> np.uint32(20), minlength=DIMENSIONS)
    np.sqrt(out, out=out)
    norm = np.sqrt(np.square(out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


class Classifier:
    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.languages, self.codes, self.weights, self.bias = languages, codes, weights, bias

    def losses(self, x: np.ndarray) -> np.ndarray:
        """The loss of each language's codeword for each row."""
        margins = x @ self.weights + self.bias
        step = max(1, MOST_TERMS // self.codes.size)
        parts = [margins[at : at + step] for at in range(0, len(margins), step)]
        return np.concatenate([np.log1p(np.exp(-np.clip(m[:, None, :] * self.codes[None, :, :], -30, 30))).sum(2) for m in parts])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """(language, score, margin to the second, ambiguous) for each text."""
        out = []
        has = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        loss = self.losses(features(texts)) if self.languages and any(has) else None
        for i, letters in enumerate(has):
            if not letters or loss is None:
                out.append(("und", 0.0, 0.0, True))
                continue
            own = loss[i]
            best = int(own.argmin())
            share = np.exp(own.min() - own)
            margin = float(np.partition(own, 1)[1] - own[best]) if len(own) > 1 else float("inf")
            out.append((self.languages[best], float(share[best] / share.sum()), margin, margin < AMBIGUOUS))
        return out


def train(rows: list[tuple[str, bytes]]) -> Classifier:
    """A classifier per bit, from (language, features) rows."""
    languages = sorted({lang for lang, _ in rows})
    codes = codewords(len(languages))
    if len(languages) < 2:
        return Classifier(languages, codes, np.zeros((DIMENSIONS, codes.shape[1] if languages else 1), np.float32), np.ones(1, np.float32))
    x = np.frombuffer(b"".join(f for _, f in rows), np.float16).reshape(len(rows), DIMENSIONS)
    number = {lang: i for i, lang in enumerate(languages)}
    y = np.array([number[lang] for lang, _ in rows])
    w, bias = np.zeros((DIMENSIONS, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    seen, seen_bias = np.full_like(w, 1e-6), np.full_like(bias, 1e-6)
    rng = np.random.default_rng(6)
    counts = np.bincount(y, minlength=len(languages))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            k = order[at : at + BATCH]
            xs, target = x[k].astype(np.float32), codes[y[k]]
            pull = -target / (1 + np.exp(np.clip(target * (xs @ w + bias), -30, 30)))
            pull *= (len(rows) / len(languages) / counts[y[k]])[:, None].astype(np.float32)
            step = xs.T @ pull / len(k)
            seen += step * step
            w -= RATE * step / np.sqrt(seen)
            step = pull.mean(0)
            seen_bias += step * step
            bias -= 0.1 * step / np.sqrt(seen_bias)
    return Classifier(languages, codes, w, bias)


def sample_key(text: str) -> Column:
    """What the sample is picked by: rows with other texts differ, whatever their ids; repeated rows count once."""
    return F.xxhash64(F.lit("language"), F.col("doc_id").cast("string"), F.col(f"`{text}`").cast("string"))


def smallest_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows (lang, key) the PER_LANGUAGE distinct ones with the smallest keys of each language."""
    kept: dict[str, np.ndarray] = {}
    for batch in batches:
        coded = batch.column("lang").dictionary_encode()
        number, keys = coded.indices.to_numpy(), batch.column("key").to_numpy()
        for k, lang in enumerate(coded.dictionary.to_pylist()):
            own = np.unique(np.append(kept.get(lang, np.empty(0, np.int64)), keys[number == k]))
            kept[lang] = own[:PER_LANGUAGE]
    for lang, keys in kept.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys)], names=["lang", "key"])


def fitted(docs: DataFrame, labelled: Column, lang: str = "lang", text: str = "text") -> Classifier:
    """A classifier from a bounded sample of the labelled rows, of each language the distinct ones with the smallest hashes.

    Two scans: the first keeps the smallest keys of each language in each task, without sending a text to Python; the
    second reads the picked rows. Texts are not shuffled. A row that repeats very often is read once a task.
    """
    spark = docs.sparkSession
    found = docs.filter(labelled & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    found = found.select(F.col(f"`{lang}`").cast("string").alias("lang"), sample_key(text).alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    smallest = Window.partitionBy("lang").orderBy("key")
    in_parts = Window.partitionBy("lang", F.pmod("key", F.lit(KEY_PARTS))).orderBy("key")  # so that no task sorts what all tasks have kept of a language
    keys = found.select("lang", "key").mapInArrow(released(smallest_keys), "lang string, key long").distinct()
    keys = keys.withColumn("_place", F.row_number().over(in_parts)).filter(F.col("_place") <= PER_LANGUAGE).drop("_place")
    keys = written(keys.withColumn("_place", F.row_number().over(smallest)).filter(F.col("_place") <= PER_LANGUAGE), "sample-keys")
    languages = keys.filter("_place = 1").count()
    if not languages:
        return train([])
    most = min(PER_LANGUAGE, max(LEAST_ROWS, SAMPLE_ROWS // languages))
    picked_keys = keys.filter(F.col("_place") <= most).select("lang", "key").collect()
    dropped(keys)
    wanted = spark.createDataFrame([tuple(r) for r in picked_keys], "lang string, key long")  # at most SAMPLE_ROWS, or LEAST_ROWS of each language

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for part in (p for b in batches for p in slices(b, "text", 1 << 20)):
            rows = {(r["lang"], r["key"]): r["text"] for r in part.to_pylist()}
            new = [k for k in rows if k not in seen]
            seen.update(new)
            made = [r.tobytes() for at in range(0, len(new), 256) for r in features([rows[k] for k in new[at : at + 256]]).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in new], pa.string()), pa.array([k[1] for k in new], pa.int64()), pa.array(made, pa.binary())], names=["lang", "key", "features"])

    bounded_batches(spark)
    picked = found.join(F.broadcast(wanted), ["lang", "key"]).mapInArrow(released(make), "lang string, key long, features binary")
    rows = picked.dropDuplicates(["lang", "key"]).collect()
    return train([(r["lang"], r["features"]) for r in sorted(rows, key=lambda r: (r["lang"], r["key"]))])


def predict(df: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """df with lang_pred, score, margin and ambiguous."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS x bits x 4 bytes, 508 KB for up to 64 languages
    new = {"lang_pred": "string", "score": "double", "margin": "double", "ambiguous": "boolean"}

    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = part.column("text").to_pylist()
        rows = [r for at in range(0, len(texts), 256) for r in shared.value.predict(texts[at : at + 256])]
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        return {k: pa.array(c, t) for k, c, t in zip(new, zip(*rows, strict=True), kinds, strict=True)}

    return add_columns(df, {"text": F.col(f"`{text}`").cast("string")}, new, make, "text", 1 << 20)


def is_held_out() -> Column:
    return crc_mod(F.col("doc_id"), 4) == 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the prediction for each document; learns from the rows that aren't held out."""
    model = fitted(docs, ~is_held_out())
    return predict(docs.select("doc_id", is_held_out().alias("held_out"), "text"), model).drop("text")


def keep(docs: DataFrame) -> DataFrame:
    """docs without those that have no language: no text, no letter, or an ambiguous decoding with under half the score."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, ~is_held_out()))

    def good(texts: list[str | None]) -> list[bool]:
        found = [r for at in range(0, len(texts), 256) for r in shared.value.predict(texts[at : at + 256])]
        return [language != "und" and not (ambiguous and score < 0.5) for language, score, _, ambiguous in found]

    return keep_where(docs, good)
