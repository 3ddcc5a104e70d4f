"""BPE encoding and decoding by prefix-sharing trie traversal.

The words of a step that are not remembered yet go into a trie. For each node, the last token of the encoding of its
path is found from those of its ancestors: it is the one token that ends there and may follow the last token of the
path before it. Each word carries these states down its path, so that what words share is encoded once. Whole texts are
encoded in map tasks without a shuffle; memory is bounded by a step's text and the remembered words.

Defined results: a null or empty text has no tokens (an empty list) and decodes to an empty text; ids that are null or
unknown are left out when decoding; duplicate rows are encoded alike; other columns are kept, and an output column
replaces an input column of that name.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import add_columns

NEVER = 1 << 60
#: What a worker remembers at most: words, states of prefixes (nodes of the trie) and pairs of tokens; how deep the trie goes.
MOST_WORDS, MOST_STATES, MOST_PAIRS = 200_000, 250_000, 100_000
DEEPEST = 64
STEP = 1 << 20
#: Code points (hexadecimal, ranges with a hyphen) that the `regex` module takes as letters or numbers and
#: the library, with older tables, doesn't; marks that it knows nothing of when it composes (and U+11930, which it leaves
#: apart from U+11935); capitals that it lower-cases and Python doesn't, with their small letters.
NO_LETTERS = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7
10ed9-10eee 11b0a 11db0-11ddb 11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2
18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2
1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""
NO_NUMBERS = "11de0-11de9 1246f 12475-1247f 12550-12686 16ff4-16ff6"
UNKNOWN_MARKS = """
898 89c-89f 8ca-8ce 9fe c3c d3b-d3c eba 1715 1ac1-1ac2 1ac5-1ac9 1acb-1ace 1df6-1df8 1dfa a82c 10d24-10d27 10eab-10eac
10f48-10f4a 10f4c 10f82 10f84 11070 1133b 1145e 11839-1183a 11930 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42
11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ed 1e4ef
"""
NEW_CAPITALS = "1c89 a7cb a7cc a7ce a7d2 a7d4 a7da a7dc 10d50-10d65 16ea0-16eb8"
THEIR_SMALL = "1c8a 264 a7cd a7cf a7d3 a7d5 a7db 19b 10d70-10d85 16ebb-16ed3"


def code_points(ranges: str) -> list[int]:
    """The code points of a list of hexadecimal numbers and ranges."""
    bounds = [[int(x, 16) for x in r.split("-")] for r in ranges.split()]
    return [c for b in bounds for c in range(b[0], b[-1] + 1)]


def char_class(ranges: str) -> str:
    """The same as the inside of a pattern's character class."""
    return "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in ranges.split())


_SMALL = dict(zip(code_points(NEW_CAPITALS), map(chr, code_points(THEIR_SMALL)), strict=True))
_ODD = np.zeros(0x110000, bool)
_ODD[[c for r in (NO_LETTERS, NO_NUMBERS, UNKNOWN_MARKS, NEW_CAPITALS) for c in code_points(r)]] = True
_FIRST_ODD = int(_ODD.argmax())
_MARKS = re.compile(f"([{char_class(UNKNOWN_MARKS)}])")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: the byte's own where printable, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, following = {b: chr(b) for b in own}, iter(range(0x100, 0x200))
    return [out.get(b) or chr(next(following)) for b in range(256)]


class Words(dict):
    """Words by number; a new one gets the next number and is noted in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


def grown(values: np.ndarray, size: int) -> np.ndarray:
    """The array, with room for `size` entries."""
    return values if len(values) >= size else np.concatenate([values, np.empty(max(size, 2 * len(values)) - len(values), values.dtype)])


class Model:
    """A vocabulary with ordered merges, read from a tokenizers JSON: byte letters, a word-end suffix, lower case."""

    def __init__(self, data: bytes) -> None:
        told = json.loads(data)
        model = told["model"]
        steps = [n["type"] for n in (told.get("normalizer") or {}).get("normalizers", [])]
        split, *rest = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{"type": None}])
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or [r["type"] for r in rest] != ["ByteLevel"] or told.get("decoder"):
            raise ValueError("only BPE over lower-cased words with byte letters, without a decoder, is known")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.pattern = regex.compile(split["pattern"]["Regex"])
        # Only texts with code points that the library reads otherwise need the exact classes, which are slower.
        exact = split["pattern"]["Regex"].replace(r"\p{L}", rf"[\p{{L}}--[{char_class(NO_LETTERS)}]]").replace(r"\p{N}", rf"[\p{{N}}--[{char_class(NO_NUMBERS)}]]")
        self.exact_pattern = regex.compile("(?V1)" + exact)
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.names = dict.fromkeys(range(max([*self.vocab.values(), *self.special.values()]) + 1))
        self.names |= {v: k for k, v in [*self.vocab.items(), *self.special.items()]}
        self.name_array = pa.array([self.names[i] for i in range(len(self.names))])
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        tokens = len(self.names)
        self.rank: dict[int, int] = {}  # left << 20 | right: rank of their merge
        self.made = [-1] * tokens  # the rank of the merge that makes a token, and its parts
        self.left, self.right = [-1] * tokens, [-1] * tokens
        for i, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, token = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.rank[a << 20 | b] = i
            if self.made[token] < 0:
                self.made[token], self.left[token], self.right[token] = i, a, b
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.vocab)
        self.letters = dict(enumerate(byte_letters()))
        self.known = self.usable()
        self.forget()
        # In ASCII text the classes are plain ranges, which the standard module matches faster.
        plain = split["pattern"]["Regex"]
        for wide, narrow in ((r"\p{L}", "a-z"), (r"\p{N}", "0-9"), (r"\s", r"\t-\r ")):
            plain = plain.replace(wide, narrow)
        self.ascii_pattern = re.compile(plain).findall

    def forget(self) -> None:
        """Starts with nothing remembered of texts."""
        self.words = Words()
        # The tokens of known words one after another; by the word's number where they begin and how many they are.
        self.tokens, self.begin, self.count = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.used = 0
        # The trie: (node << 8 | byte) to the node below; each node's last token and where it starts. Node 0 is the root.
        self.below: dict[int, int] = {}
        self.token, self.start = array("i", [-1]), array("i", [0])
        self.follows: dict[int, bool] = {}  # left << 20 | right: whether the two tokens stand apart

    def stands(self, left: int, right: int, before: int = NEVER) -> bool:
        """Whether the two tokens stay apart: at no time before `before` is a merge across their border the next one.

        Goes back in time: undoes the later of the two border tokens' merges, and looks whether the pair that then met
        at the border would have merged sooner than either was used up. Of equal merges the leftmost comes first.
        """
        rank, made = self.rank.get, self.made
        left_used = right_used = before
        while True:
            across = rank(left << 20 | right, NEVER)
            if across < left_used and across <= right_used and across < before:
                return False
            a, b = made[left], made[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                left_used, left = a, self.right[left]
            else:
                right_used, right = b, self.left[right]

    def usable(self) -> dict[str, int]:
        """The tokens that merging their own letters gives; no other token is ever in an encoding."""
        good: set[int] = set()
        for token in sorted(self.vocab.values(), key=self.made.__getitem__):  # parts come before what they make
            a, b = self.left[token], self.right[token]
            if a < 0 or (a in good and b in good and self.stands(a, b, before=self.made[token])):
                good.add(token)
        return {text: token for text, token in self.vocab.items() if token in good}

    def learn(self, words: list[str]) -> list[tuple[int, ...]]:
        """The tokens of words, by way of a trie of their bytes.

        Words are inserted one after the other. Going down, last[d] is the last token of the encoding of the word's first
        d letters, back[d] where that token starts; a node's own state needs only those of its ancestors, so it is found
        once, when its first word comes by, and what words share is encoded once. The trie stays for the next steps'
        words. It is one table from (node, byte) to node, so that it needs no objects of its own.
        """
        suffix, letters, longest = self.suffix, self.letters, self.longest
        if len(self.token) > MOST_STATES:
            self.below, self.token, self.start = {}, array("i", [-1]), array("i", [0])
        if len(self.follows) > MOST_PAIRS:
            self.follows.clear()
        below, token_of, start_of, ends = self.below, self.token, self.start, self.ends
        found: list[tuple[int, ...]] = []
        last, back = [-1] * (DEEPEST + 2), [0] * (DEEPEST + 2)
        for word in words:
            if word[0] == "\n":  # a special token's string
                found.append((self.special[word[1:]],))
                continue
            data = word.encode()
            w = word if word.isascii() and word.isprintable() else data.decode("latin-1").translate(letters)
            inner = len(w) - 1
            node = depth = 0
            for c in data[: min(inner, DEEPEST)]:
                depth += 1
                edge = node << 8 | c
                node = below.get(edge, 0)
                if not node:
                    node = below[edge] = len(token_of)
                    token, at = ends(w[max(0, depth - longest) : depth], depth - 1, last, 1)
                    token_of.append(token)
                    start_of.append(at)
                last[depth], back[depth] = token_of[node], start_of[node]
            if inner > DEEPEST:  # the rest of a long word is its own
                last += [-1] * (inner + 2 - len(last))
                back += [0] * (inner + 2 - len(back))
                for depth in range(DEEPEST + 1, inner + 1):
                    last[depth], back[depth] = ends(w[max(0, depth - longest) : depth], depth - 1, last, 1)
            token, at = ends(w[max(0, inner - longest) :] + suffix, inner, last, 1 + len(suffix))
            if at:
                out = [token]
                while at:
                    out.append(last[at])
                    at = back[at]
                found.append(tuple(out[::-1]))
            else:
                found.append((token,))
        return found

    def ends(self, tail: str, start: int, last: list[int], size: int) -> tuple[int, int]:
        """The token that ends a path, and where it starts: the one that may follow what is last there.

        tail: the path's last letters, whose last symbol has `size` characters and stands at depth `start`.
        """
        find, follows = self.known.get, self.follows
        cut = len(tail) - size
        for at in range(start, max(-1, start - cut - 1), -1):
            if (token := find(tail[cut - (start - at) :])) is not None:
                if at == 0:
                    return token, 0
                key = last[at] << 20 | token
                if (apart := follows.get(key)) is None:
                    apart = follows[key] = self.stands(last[at], token)
                if apart:
                    return token, at
        raise ValueError(f"no token for {tail[cut:]!r}")

    def pieces(self, text: str) -> list[str]:
        """The words of a text, normalised."""
        if text.isascii():
            return self.ascii_pattern(text.lower())
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if codes.max() >= _FIRST_ODD and _ODD[codes].any():
            text = "".join(unicodedata.normalize("NFC", x) for x in _MARKS.split(text))
            return self.exact_pattern.findall(text.replace("Σ", "σ").translate(_SMALL).lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.pattern.findall(text.replace("Σ", "σ").lower())

    def pieces_around(self, text: str) -> list[str]:
        """The same where special tokens' strings stand in the text; these are marked by a line feed, which no word holds."""
        parts = enumerate(self.find_special.split(text))
        return [w for i, x in parts for w in (["\n" + x] if i % 2 else self.pieces(x))]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin."""
        if len(self.words) > MOST_WORDS:
            self.words.clear()
            self.used = 0
        special = self.find_special.search if self.find_special else lambda _: None
        parts = [[] if not t else self.pieces_around(t) if "<" in t and special(t) else self.pieces(t) for t in texts]
        sizes = [len(p) for p in parts]
        number = np.fromiter(map(self.words.__getitem__, chain.from_iterable(parts)), np.int64, sum(sizes))
        if new := self.words.new:
            with paused_gc():
                made = self.learn(new)
            n, first = len(self.words), len(self.words) - len(new)
            counts = np.fromiter(map(len, made), np.int64, len(made))
            self.count, self.begin = grown(self.count, n), grown(self.begin, n)
            self.count[first:n], self.begin[first:n] = counts, self.used + np.cumsum(counts) - counts
            last = self.used + int(counts.sum())
            self.tokens = grown(self.tokens, last)
            self.tokens[self.used : last] = np.fromiter(chain.from_iterable(made), np.int32, last - self.used)
            self.used = last
            self.words.new = []
        count = self.count[number]
        ends = np.cumsum(count)
        flat = self.tokens[np.repeat(self.begin[number] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        starts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        return flat, starts.astype(np.int32)


@contextmanager
def paused_gc() -> Iterator[None]:
    """Without cycle collection, which would walk the whole trie again and again; nothing made here has cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


_models: dict[str, Model] = {}


def model_of(data: bytes) -> Model:
    """The model of a JSON file's bytes, built once in a task. At a task's end it goes with all that it remembers of texts,
    as workers go on with other stages."""
    key = hashlib.md5(data).hexdigest()
    if key not in _models:
        _models[key] = Model(data)
    return _models[key]


def vocabulary(df: DataFrame, path: str):
    """The JSON file's bytes, read by the driver and sent to the executors: a fixed file of about 2 MB, held under 64 MB."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB isn't sent around")
    return df.sparkSession.sparkContext.broadcast(data)


def decoded(model: Model, ids: pa.ListArray) -> pa.Array:
    """The tokens' strings joined by blanks, as a vocabulary without a decoder decodes. Goes row block by row block."""
    names, out = model.name_array, []
    for at in range(0, len(ids), 512):
        some = ids.slice(at, 512)
        flat = some.flatten()
        flat = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(names))), flat, None)
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(some).to_numpy())]).astype(np.int32)
        if flat.null_count:
            good = np.concatenate([[0], np.cumsum(~np.asarray(pc.is_null(flat)))]).astype(np.int32)
            flat, starts = flat.drop_null(), good[starts]
        out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), names.take(flat)), " "))
    return pa.chunked_array(out, pa.string()).combine_chunks() if out else pa.array([], pa.string())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids (array of int) of a text column, as the tokenizers library encodes without adding special tokens."""
    data = vocabulary(df, path)

    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        flat, starts = model_of(data.value).encode(part.column("_text").to_pylist())
        return {ids: pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))}

    return add_columns(df, {"_text": F.col(f"`{text}`").cast("string")}, {ids: "array<int>"}, make, "_text", STEP, _models.clear)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded_text: str = "decoded") -> DataFrame:
    """encode, then decode of the ids it gave, in one pass of a Python worker."""
    data = vocabulary(df, path)

    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        model = model_of(data.value)
        flat, starts = model.encode(part.column("_text").to_pylist())
        coded = pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))
        return {ids: coded, decoded_text: decoded(model, coded)}

    return add_columns(df, {"_text": F.col(f"`{text}`").cast("string")}, {ids: "array<int>", decoded_text: "string"}, make, "_text", STEP, _models.clear)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that a column of ids stands for, special tokens kept."""
    data = vocabulary(df, path)

    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        return {text: decoded(model_of(data.value), part.column("_ids"))}

    return add_columns(df, {"_ids": F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>"))}, {text: "string"}, make)
