"""Periodic run detection by heavy/light lag counting.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least
max(LEAST_WORDS, LEAST_PERIODS * q) words, that no neighbouring word extends keeping period q.

1. For each lag q, the places i with word[i] = word[i + q] are counted exactly. Frequent words are counted by the
   autocorrelation of their places (a sum of power spectra, one inverse FFT; the counts are whole numbers far below the
   precision of a double, so rounding gives them exactly), rare words by the differences of all pairs of their places.
   A word is frequent where its pairs would cost more than its transform.
2. A run of period q holds at least max(LEAST_WORDS - q, (LEAST_PERIODS - 1) * q) matches in a row. A lag goes on if it
   has as many matches beside those inside runs already found whose period divides q. (What has periods p and q and at
   least p + q words has the period gcd(p, q), so a stretch that isn't primitive is a run that a smaller lag has found.)
3. Only these lags get an island scan, which looks at one place in every so many matches first and reads all words
   where such a place stands in a row of matches.

One map pass over whole texts, a document at a time, no shuffle; memory is bounded by the longest text (the pairs of rare
words go through in parts of PAIRS). Nothing is capped: every lag up to a third of the words is counted.

Defined results: a null or empty text has no runs and collapses to an empty text; repeated rows give equal results; other
columns are kept, and an output column replaces an input column of that name.
"""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import add_columns

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Pairs of places that are looked at in one step.
PAIRS = 1 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"
COLUMNS = {"n_words": "long", "runs": f"array<{RUN}>", "strongest": RUN, "collapsed": "string"}
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

Run = tuple[int, int, int]


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal ones alike."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def lag_counts(ids: np.ndarray) -> np.ndarray:
    """At q, for each lag q up to a third of the words: how many words equal the one q places on."""
    most = len(ids) // LEAST_PERIODS
    counts = np.zeros(most + 1, np.int64)
    order = np.argsort(ids, kind="stable")
    size = np.bincount(ids)
    width = len(ids) + most + 1  # room behind the words, so that no lag that counts wraps around
    heavy = np.flatnonzero(size > max(64, 1.5 * width**0.5))
    ends = np.cumsum(size)
    if len(heavy):
        width = 1 << (width - 1).bit_length()
        power = np.zeros(width // 2 + 1)
        for word in heavy.tolist():
            places = np.zeros(width)
            places[order[ends[word] - size[word] : ends[word]]] = 1
            spectrum = np.fft.rfft(places)
            power += spectrum.real**2 + spectrum.imag**2
        counts += np.rint(np.fft.irfft(power, width)[: most + 1]).astype(np.int64)
        size[heavy] = 0
    # places of one word stand together in order; each of a rare word is paired with the word's later ones
    later = np.repeat(ends, np.bincount(ids)) - np.arange(len(ids)) - 1
    later[np.repeat(size == 0, np.bincount(ids))] = 0
    first = np.flatnonzero(later)
    later = later[first]
    upto = np.cumsum(later)
    at = 0
    while at < len(first):
        stop = max(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")), at + 1)
        own, n = first[at:stop], later[at:stop]
        before = np.cumsum(n) - n
        left = np.repeat(own, n)
        right = left + 1 + np.arange(len(left)) - np.repeat(before, n)
        lags = order[right] - order[left]
        counts += np.bincount(lags[lags <= most], minlength=most + 1)
        at = stop
    counts[0] = 0
    return counts


def islands(ids: np.ndarray, q: int, need: int) -> list[tuple[int, int]]:
    """(start, length) of the rows of at least `need` matches in a row at lag q."""
    n = len(ids) - q
    if n > 4096:
        at = np.arange(need - 1, n, need)  # as many matches in a row hold one of these places
        at = at[ids[at] == ids[at + q]]
        ahead, behind = np.ones(len(at), bool), np.ones(len(at), bool)
        half = need // 2  # and on one of its sides so many more
        for k in sorted({half * k // 8 for k in range(1, 9)}):
            right, left = at + k, at - k
            inside = np.minimum(right, n - 1)
            ahead &= (right < n) & (ids[inside] == ids[inside + q])
            inside = np.maximum(left, 0)
            behind &= (left >= 0) & (ids[inside] == ids[inside + q])
        if not (ahead | behind).any():
            return []
    same = np.zeros(n + 2, np.int8)
    same[1:-1] = ids[:-q] == ids[q:]
    edge = np.diff(same)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = stops - starts >= need
    return list(zip(starts[long].tolist(), (stops - starts)[long].tolist(), strict=True))


def runs_of(ids: np.ndarray) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    counts = lag_counts(ids)
    lag = np.arange(len(counts))
    need = np.maximum(LEAST_WORDS - lag, (LEAST_PERIODS - 1) * lag)
    enough = counts >= need
    enough[0] = False
    left = counts - need
    found: dict[tuple[int, int], Run] = {}
    q = 0
    while q + 1 < len(enough) and enough[q + 1 + (at := int(enough[q + 1 :].argmax()))]:
        q += 1 + at
        for start, matches in islands(ids, q, int(need[q])):
            length = matches + q
            if (start, length) in found:  # the run of a smaller period
                continue
            found[start, length] = (start, length, q)
            more = np.arange(2 * q, min(length, len(counts)), q)  # lags at which this run matches itself
            left[more] -= length - more
            enough[more] &= left[more] >= 0
    return sorted(found.values(), key=lambda r: (r[0], r[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run with the most periods; of equal ones the first, then the one of the smallest period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that a run contains after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def periodic_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the words, runs, the strongest run and the collapsed text of each row's whole text."""

    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        n, every, best, short = [], [], [], []
        for data in part.column("text").to_pylist():
            words = data.split() if data else []
            runs = runs_of(numbered(words)) if len(words) >= LEAST_WORDS else []
            n.append(len(words))
            every.append([as_dict(r) for r in runs])
            best.append(as_dict(strongest(runs)))
            short.append(collapsed(words, runs).decode())
        return {"n_words": pa.array(n, pa.int64()), "runs": pa.array(every, pa.list_(_RUN)), "strongest": pa.array(best, _RUN), "collapsed": pa.array(short, pa.string())}

    return add_columns(df, {"text": F.encode(F.col(f"`{text}`").cast("string"), "utf-8")}, COLUMNS, make, "text", 1 << 20)


def as_dict(run: Run | None) -> dict[str, int] | None:
    return None if run is None else dict(zip(("start", "length", "period"), run, strict=True))
