"""Quality rules by compression bands.

The zstandard ratio (compressed bytes to bytes) of a whole text and of its fixed chunks must lie in a band: below it
text is repetitive, above it incompressible. Short texts compress less, so the band depends on the length. A text
fails if its whole ratio leaves the band of its length, or if chunks outside the chunk band hold more than CHUNK_SHARE
of its bytes; every byte is in a chunk, and a short last chunk has the band of its own length. Beside the bands stand plain counts of words, symbols, repeated lines and repeated windows.
All in one map pass without a shuffle; memory is bounded by the longest text.

Defined results: a null or empty text has zero words and counts, null ratios, and fails the base rule; duplicate rows
are judged alike; other columns are kept, and an output column replaces an input column of that name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import Ids, add_columns, keep_where, windows

#: (bytes below which the band holds, lowest ratio, highest ratio) of whole texts, at zstandard level 3. The ratio falls
#: with length up to the compressor's window of 2 MB; a clean text with 15 % of it repeated once is within the band.
BANDS = ((150, 0.30, 1.10), (300, 0.45, 1.00), (600, 0.45, 0.90), (1200, 0.45, 0.80), (2400, 0.445, 0.75), (4800, 0.43, 0.70), (10_000, 0.40, 0.68), (50_000, 0.34, 0.66), (200_000, 0.32, 0.66), (1_000_000, 0.30, 0.66), (float("inf"), 0.29, 0.66))
#: Fixed chunks and their band; a last chunk under half of that size is judged by the band of its length.
CHUNK_BYTES, CHUNK_BAND, CHUNK_SHARE = 4096, (0.43, 0.75), 0.3
LEVEL = 3
MIN_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"
COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "ratio": "double", "chunk_share_out": "double", "kept": "boolean"}
_OTHERS = bytes(i for i in range(256) if i not in SYMBOLS)


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """How many words lie in windows of `width` words that occur at least twice, the first occurrence included."""
    w = windows(ids, width)
    if len(w) < 2:
        return 0
    _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
    often = counts[inverse] > 1
    if not often.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def in_band(size: int, ratio: float) -> bool:
    low, high = next((lo, hi) for below, lo, hi in BANDS if size < below)
    return low <= ratio <= high


def compression(z: zstandard.ZstdCompressor, data: bytes) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of chunked bytes outside the chunk band, and the verdict."""
    whole = len(z.compress(data)) / len(data)
    out = 0
    for at in range(0, len(data), CHUNK_BYTES):
        chunk = data[at : at + CHUNK_BYTES]
        ratio = len(z.compress(chunk)) / len(chunk)
        good = CHUNK_BAND[0] <= ratio <= CHUNK_BAND[1] if len(chunk) >= CHUNK_BYTES // 2 else in_band(len(chunk), ratio)
        out += 0 if good else len(chunk)
    share = out / len(data)
    return whole, share, in_band(len(data), whole) and share <= CHUNK_SHARE


def continuation_bytes(data: bytes) -> int:
    """Bytes that continue a UTF-8 code point."""
    return 0 if data.isascii() else int(((np.frombuffer(data, np.uint8) & 0xC0) == 0x80).sum())


def judged(data: bytes | None, ids: Ids, z: zstandard.ZstdCompressor) -> tuple:
    """The values of COLUMNS for one text."""
    data = data or b""
    words = data.split()
    n = len(words)
    repeated = repeated_words(ids.array(words)) if n > WINDOW else 0
    failed = n < MIN_WORDS or 100 * repeated > MOST_REPEATED * n
    whole, share, good = compression(z, data) if data else (None, None, False)
    chars = sum(map(len, words)) - continuation_bytes(data)
    return n, chars, len(data.translate(None, _OTHERS)), duplicate_lines(data), repeated, failed, whole, share, good and not failed


def apply_rules(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of COLUMNS for each row's whole text."""
    state: dict = {}

    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        if not state:
            state.update(ids=Ids(), z=zstandard.ZstdCompressor(level=LEVEL))
        columns = zip(*[judged(data, **state) for data in part.column("text").to_pylist()], strict=True)
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        return {k: pa.array(c, t) for k, c, t in zip(COLUMNS, columns, kinds, strict=True)}

    return add_columns(df, {"text": F.encode(F.col(f"`{text}`").cast("string"), "utf-8")}, COLUMNS, make, "text")


def keep(docs: DataFrame) -> DataFrame:
    """docs without those that the rules reject, with the columns of docs."""
    state: dict = {}

    def good(texts: list[str | None]) -> list[bool]:
        if not state:
            state.update(ids=Ids(), z=zstandard.ZstdCompressor(level=LEVEL))
        return [judged(t.encode() if t else b"", **state)[-1] for t in texts]

    return keep_where(docs, good)
