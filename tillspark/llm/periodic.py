"""Operator 13 -- periodic runs by the branching-tandem test on an enhanced suffix array.

The words of many texts stand in one array, each text with names of its own,
so that suffixes of different texts share nothing.  Sorting by doubling gives
the suffix array, its inverse (ISA) and, from the names kept of every doubling,
the longest common extension of any two positions.

A square ww of period q that cannot be rotated to the right starts at i exactly
if the suffixes i and i + q part after q words: they lie in different children
of an LCP interval of depth q.  Every boundary of the LCP array splits its
interval in two; the suffixes of the smaller side look up ISA[i +- q] in the
other side, O(n log n) in all and without a tree.  Squares found are rotated to
the left as far as they go and merged into runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.llm.common import without

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: words handled together; a longer text is handled by itself
BATCH_WORDS = 1 << 18
MEMO_WORDS = 500_000
OUTPUT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class _Names(dict):
    """A number for each word met."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class SuffixIndex:
    """Suffix array of several sequences: ``names`` of all, ``of`` which sequence a position is in, ``end`` its end."""

    def __init__(self, names: np.ndarray, of: np.ndarray, end: np.ndarray) -> None:
        n = len(names)
        key = of.astype(np.int64) << np.int64(32) | names
        self.sa = np.argsort(key, kind="stable")
        new = np.concatenate([[True], np.diff(key[self.sa]) != 0])
        rank = np.full(n + 1, -1, np.int32)
        rank[self.sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        #: levels[k][i]: name of the first 2^k words at i; equal names, equal words
        self.levels = [rank.copy()]
        new = np.append(new, True)
        slots = np.flatnonzero(~(new[:-1] & new[1:]))  # in groups of two and more
        width = 1
        while len(slots):
            at = self.sa[slots]
            after = at + width
            second = np.where(after < end[at], rank[np.minimum(after, n)] + 1, 0)
            key = rank[at].astype(np.int64) * (n + 1) + second
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            self.sa[slots] = at
            new = np.concatenate([[True], np.diff(key) != 0])
            rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
            self.levels.append(rank.copy())
            new = np.append(new, True)
            slots = slots[~(new[:-1] & new[1:])]
            width *= 2
        self.isa = rank  # every suffix has a rank of its own now

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension of the positions a != b, in words."""
        a, b = a.copy(), b.copy()
        total = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            same = (self.levels[k][a] == self.levels[k][b]).astype(np.int64) << k
            a, b, total = a + same, b + same, total + same
        return total

    def lcp(self) -> np.ndarray:
        """lcp[r]: words that the suffixes of rank r - 1 and r share."""
        out = np.zeros(len(self.sa), np.int32)
        first = self.levels[0][self.sa]
        r = np.flatnonzero(first[1:] == first[:-1]) + 1
        out[r] = self.extension(self.sa[r - 1], self.sa[r])
        return out


def _sides(lcp: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For boundaries p: first rank of the left side (bounded by an lcp of at most
    lcp[p]) and end of the right side (bounded by a smaller lcp)."""
    n = len(lcp)
    lengths = np.diff(np.flatnonzero(np.concatenate([[0], lcp, [0]]) == 0))
    tables = [np.concatenate([lcp, [0]])]
    while 1 << len(tables) <= lengths.max():
        half = 1 << (len(tables) - 1)
        t = tables[-1]
        tables.append(np.minimum(t, np.concatenate([t[half:], np.zeros(min(half, len(t)), t.dtype)])))
    depth = lcp[p]
    low, high = p - 1, p + 1
    for k in range(len(tables) - 1, -1, -1):
        start = low - (1 << k) + 1
        low = np.where((start >= 0) & (tables[k][np.maximum(start, 0)] > depth), start - 1, low)
        high = np.where(tables[k][np.minimum(high, n)] >= depth, high + (1 << k), high)
    return low, high


def find_runs(texts: list[np.ndarray], min_length: int, min_exponent: int) -> np.ndarray:
    """Rows (text, start, length, period) of the maximal runs with length >=
    max(min_length, min_exponent * period), by text, start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.empty((0, 4), np.int64)
    if not sizes.sum():
        return none
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(texts)), sizes)
    first = (ends - sizes)[of]
    index = SuffixIndex(np.concatenate(texts), of, ends[of])
    lcp = index.lcp()
    p = np.flatnonzero(lcp)
    if not len(p):
        return none
    low, high = _sides(lcp, p)
    left = p - low <= high - p  # the smaller side looks up the other
    lo, hi = np.where(left, low, p), np.where(left, p, high)
    other_lo, other_hi = np.where(left, p, low), np.where(left, high, p)
    size = hi - lo
    which = np.repeat(np.arange(len(p)), size)
    at = index.sa[np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which]]
    q = lcp[p][which].astype(np.int64)
    found = []
    for step in (q, -q):
        partner = at + step
        inside = (partner >= 0) & (partner < len(of))
        rank = index.isa[np.where(inside, partner, 0)]
        ok = inside & (rank >= other_lo[which]) & (rank < other_hi[which])
        found.append(np.stack([np.minimum(at, partner)[ok], q[ok]], axis=1))
    square = np.concatenate(found)
    start, period = square[:, 0], square[:, 1]
    end = start + 2 * period
    # rotate to the left: the least start from which the extension by the period reaches the end
    need = np.maximum(min_length, min_exponent * period)
    enough = end - need >= first[start]
    start, period, end, need = start[enough], period[enough], end[enough], need[enough]
    reaches = lambda s, p, e: index.extension(s, s + p) == e - p - s
    enough = reaches(end - need, period, end)
    start, period, end, need = start[enough], period[enough], end[enough], need[enough]
    bad, good = first[start] - 1, end - need
    while (open_ := good - bad > 1).any():
        middle = (good + bad) // 2
        ok = reaches(np.maximum(middle, 0), period, end) & open_
        good, bad = np.where(ok, middle, good), np.where(open_ & ~ok, middle, bad)
    # a multiple of the smallest period spans the same words
    order = np.lexsort((period, end, good))
    good, end, period = good[order], end[order], period[order]
    keep = np.concatenate([[True], (np.diff(good) != 0) | (np.diff(end) != 0)]) if len(good) else np.zeros(0, bool)
    good, end, period = good[keep], end[keep], period[keep]
    runs = np.stack([of[good], good - first[good], end - good, period], axis=1)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 1] + runs[:, 3], 1)
    np.add.at(edge, runs[:, 1] + runs[:, 2], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)])


def _runs(min_length: int, min_exponent: int):
    def judged(texts: list[list[bytes]], names: _Names) -> list[tuple]:
        runs = find_runs([np.fromiter(map(names.__getitem__, w), np.int64, len(w)) for w in texts], min_length, min_exponent)
        cut = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
        out = []
        for i, words in enumerate(texts):
            own = runs[cut[i] : cut[i + 1]]
            rows = [{"start": s, "length": n, "period": p} for _, s, n, p in own.tolist()]
            out.append((len(words), rows, _collapse(words, own).decode("utf-8", "surrogatepass")))
        return out

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = _Names()
        for batch in batches:
            rows: list[tuple] = []
            held: list[list[bytes]] = []
            size = 0
            for t in batch:
                words = (t or "").encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only
                if held and size + len(words) > BATCH_WORDS:
                    rows += judged(held, names)
                    held, size = [], 0
                    if len(names) > MEMO_WORDS:
                        names.clear()
                held.append(words)
                size += len(words)
            rows += judged(held, names) if held else []
            yield pd.DataFrame(rows, columns=["n_words", "runs", "collapsed"])

    return F.pandas_udf(of, OUTPUT)


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``n_words``, ``runs`` and ``collapsed``.

    Words are runs of non-white-space (ASCII), numbered from 0.  A run is a
    stretch of words with smallest period q and at least max(min_length,
    min_exponent * q) words that no neighbouring word extends; ``runs`` lists
    (start, length, period) by start, then period.  ``collapsed`` joins by one
    space the words that no run holds after its first q words.

    Null, empty and wordless texts have no words, no runs and an empty
    ``collapsed``.  Texts are read whole; memory grows with the longest single
    text, by some 100 bytes and four bytes a doubling of its longest repeat for
    each word.  Each row is judged by itself: repeated rows give equal results, an
    empty table an empty one.  Input columns named like the outputs are replaced.
    ``min_exponent`` is 2 at least.
    """
    if min_exponent < 2:
        raise ValueError("min_exponent must be 2 at least")
    rows = without(docs, "n_words", "runs", "collapsed", "__found")
    names = [F.col(f"`{c}`") for c in rows.columns]
    found = rows.withColumn("__found", _runs(min_length, min_exponent)(F.col(f"`{text_col}`").cast("string")))
    return found.select(*names, "__found.n_words", "__found.runs", "__found.collapsed")
