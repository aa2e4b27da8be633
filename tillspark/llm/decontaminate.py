"""Operator 3 -- benchmark decontamination by winnowing.

A benchmark window is 10 consecutive words of an item (a shorter item is one
window).  Both sides hash every 5-gram of words and keep, for each 6
consecutive 5-grams (= 10 words), the least hash.  Equal 10-word spans keep
equal fingerprints, so every shared window has a shared fingerprint: the
fingerprints are joined and each hit is extended to the 10-word windows around
it, which are compared word by word.  An item of L < 10 words is looked up by
the hash of all L-grams (winnowing with one L-gram per window).

The benchmark is joined in blocks of bounded bytes (``block_bytes`` of item
text per broadcast index); documents are never shuffled by their text.  With
one block the documents are decided in a single pass where they lie.  With
more, each block is one pass over the documents that keeps only contaminated
texts, keyed by SHA-256, and the passes' results are merged per text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.common import scratch_table, text_or_empty, without

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 2 << 20
#: documents are tokenised together in chunks of about this many bytes
CHUNK_BYTES = 1 << 18
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
RESULT = "n_words long, starts array<int>, lens array<int>, items array<string>"

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_word = np.zeros(256, dtype=bool)
_word[48:58] = _word[97:123] = _word[128:] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in lower-cased bytes."""
    mask = np.zeros(len(data) + 2, dtype=np.int8)
    mask[1:-1] = _word[data]
    edge = np.diff(mask)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Hasher:
    """Polynomial word hashes and n-gram hashes modulo 2**64."""

    def __init__(self) -> None:
        self.grow(CHUNK_BYTES + 1)

    def grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.power, self.inverse = np.full(n + 1, BASE, np.uint64), np.full(n + 1, INVERSE, np.uint64)
            self.power[0] = self.inverse[0] = 1
            np.cumprod(self.power, out=self.power)
            np.cumprod(self.inverse, out=self.inverse)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        i = 0
        while i < len(starts):  # pieces of bounded length, cut between words
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, side="right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            if hi - lo >= len(self.power):
                self.grow(hi - lo + 1)
            with np.errstate(over="ignore"):
                total = np.zeros(hi - lo + 1, np.uint64)
                np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * self.power[: hi - lo], out=total[1:])
                s, e = starts[i:j] - lo, ends[i:j] - lo
                out[i:j] = (total[e] - total[s]) * self.inverse[s]
            i = j
        return self.mix(out)

    @staticmethod
    def mix(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def grams(self, words: np.ndarray, n: int) -> np.ndarray:
        if len(words) < n:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            h = words[: len(words) - n + 1].copy()
            for k in range(1, n):
                h = h * np.uint64(BASE) + words[k : len(words) - n + 1 + k]
        return self.mix(h)


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Indices of the grams that are the least of some ``width`` consecutive ones."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = grams[:n].copy()
    for k in range(1, width):
        np.minimum(low, grams[k : k + n], out=low)
    high = np.zeros(len(grams), np.uint64)  # the largest of the minima of the windows that hold a gram
    for k in range(width):
        np.maximum(high[k : k + n], low, out=high[k : k + n])
    return np.flatnonzero(high == grams)


class BenchmarkIndex:
    """Fingerprints and windows of one block of items, for lookups in tasks."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, gram: int) -> None:
        self.window, self.gram = window, gram
        hasher = Hasher()
        self.owners: dict[bytes, set] = defaultdict(set)
        prints: dict[int, list] = defaultdict(list)
        for item, text in items:
            data = _lower[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
            starts, ends = word_spans(data)
            if not len(starts):
                continue
            raw = data.tobytes()
            words = [raw[s:e] for s, e in zip(starts, ends)]
            span = min(window, len(words))
            for i in range(len(words) - span + 1):
                self.owners[b" ".join(words[i : i + span])].add(item)
            h = hasher.words(data, starts, ends)
            if span < window:
                prints[span].append(hasher.grams(h, span))
            else:
                g = hasher.grams(h, gram)
                prints[window].append(g[winnow(g, window - gram + 1)])
        self.prints = {n: np.unique(np.concatenate(p)) for n, p in prints.items()}
        self.owners = dict(self.owners)

    def hits(self, length: int, grams: np.ndarray) -> np.ndarray:
        known = self.prints[length]
        at = np.searchsorted(known, grams)
        at[at == len(known)] = 0
        return np.flatnonzero(known[at] == grams)

    def search(self, data: np.ndarray, first_byte: np.ndarray, hasher: Hasher) -> Iterator[tuple[int, list, list, list]]:
        """For each text of a chunk (given by the offset of its first byte):
        number of words, window starts, window lengths, item ids."""
        starts, ends = word_spans(data)
        bound = np.searchsorted(starts, first_byte)  # first word of each text, and the end
        found: dict[int, list] = defaultdict(list)
        if self.prints and len(starts):
            raw = data.tobytes()
            h = hasher.words(data, starts, ends)
            tried = set()
            for length in self.prints:
                if length < self.window:
                    candidates = self.hits(length, hasher.grams(h, length))
                else:
                    g = hasher.grams(h, self.gram)
                    kept = winnow(g, length - self.gram + 1)
                    near = kept[self.hits(length, g[kept])]
                    back = np.arange(length - self.gram + 1)  # extend the hit to the windows around it
                    candidates = np.unique((near[:, None] - back[None, :]).ravel())
                for i in candidates[candidates >= 0].tolist():
                    d = int(np.searchsorted(bound, i, side="right")) - 1
                    if i + length > bound[d + 1] or (i, length) in tried:
                        continue
                    tried.add((i, length))
                    key = b" ".join([raw[s:e] for s, e in zip(starts[i : i + length], ends[i : i + length])])
                    if key in self.owners:
                        found[d].append((i - int(bound[d]), length, self.owners[key]))
        for d in range(len(bound) - 1):
            hit = found.get(d, [])
            items = sorted({o for _, _, owners in hit for o in owners if o is not None})
            yield int(bound[d + 1] - bound[d]), [x[0] for x in hit], [x[1] for x in hit], items


def _search_texts(texts: pa.Array, index: BenchmarkIndex, hasher: Hasher) -> list[tuple]:
    out: list[tuple] = []
    chunk: list[bytes] = []
    held = 0

    def flush() -> None:
        nonlocal chunk, held
        if chunk:
            sizes = np.array([len(b) + 1 for b in chunk], dtype=np.int64)  # a space parts two texts
            first = np.concatenate([[0], np.cumsum(sizes)])
            data = _lower[np.frombuffer(b" ".join(chunk) + b" ", np.uint8)]
            out.extend(index.search(data, first, hasher))
            chunk, held = [], 0

    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass")
        chunk.append(b)
        held += len(b)
        if held >= CHUNK_BYTES:
            flush()
    flush()
    return out


def _hits(spark, items: list[tuple], window: int, gram: int):
    """Column function text -> RESULT for one block of items, which it broadcasts."""
    index = spark.sparkContext.broadcast(items)

    @F.pandas_udf(RESULT)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, hasher = BenchmarkIndex(index.value, window, gram), Hasher()
        for s in batches:
            rows = _search_texts(s, own, hasher)
            yield pd.DataFrame(rows, columns=["n_words", "starts", "lens", "items"])

    return search


def _covered(spans: Column) -> Column:
    """Words covered by an array of (start, len): sorted sweep."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["end"], x["start"] + x["len"]).alias("end"),
        (acc["n"] + F.greatest(F.lit(0), x["start"] + x["len"] - F.greatest(acc["end"], x["start"]))).cast("long").alias("n"),
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def mark_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All rows of ``docs`` with ``n_words`` and ``n_hit`` (long), ``hit_windows``
    (array of (start, len) in words), ``items`` (ids of the items with an
    occurring window, as sorted strings) and ``contaminated``.

    Null and wordless texts have no words and no hits; wordless items have no
    window; repeated items and rows count each in its own right; an item
    without an id marks words but is not listed.  Empty tables give empty
    results or no hits.  Texts are read whole, whatever their length.  Input columns
    named like the outputs are replaced.
    """
    if gram > window:
        raise ValueError("gram must not exceed window")
    spark = docs.sparkSession
    rows = without(docs, "n_words", "n_hit", "hit_windows", "items", "contaminated", "__r", "__key")
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    text = text_or_empty("text")

    def block(b: int):
        return _hits(spark, [tuple(r) for r in tests.where(block_of == b).collect()], window, gram)

    if blocks == 1:
        marked = rows.withColumn("__r", block(0)(text))
        n_words = F.col("__r.n_words")
    else:
        passes = []
        for b in range(blocks):
            one = rows.select(F.sha2(text, 256).alias("__key"), block(b)(text).alias("__r")).where(F.size("__r.starts") > 0)
            passes.append(scratch_table(one.dropDuplicates(["__key"])))
        hit = passes[0]
        for p in passes[1:]:
            hit = hit.union(p)
        hit = hit.groupBy("__key").agg(  # at most one row per block
            F.flatten(F.collect_list("__r.starts")).alias("starts"),
            F.flatten(F.collect_list("__r.lens")).alias("lens"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("__r.items")))).alias("items"),
        )
        empty = F.array().cast("array<int>")
        marked = rows.withColumn("__key", F.sha2(text, 256)).join(hit, "__key", "left")
        marked = marked.withColumn(
            "__r",
            F.struct(
                F.coalesce("starts", empty).alias("starts"),
                F.coalesce("lens", empty).alias("lens"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            ),
        ).drop("starts", "lens", "items")
        lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        n_words = F.regexp_count(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long")
    windows = F.transform(F.arrays_zip("__r.starts", "__r.lens"), lambda x: F.struct(x["starts"].alias("start"), x["lens"].alias("len")))
    out = marked.withColumns({"n_words": n_words, "hit_windows": windows, "items": F.col("__r.items")})
    out = out.withColumn("n_hit", _covered(F.col("hit_windows")))
    return out.select(
        *[F.col(f"`{c}`") for c in rows.columns], "n_words", "n_hit", "hit_windows", "items", (F.col("n_hit") > 0).alias("contaminated")
    )
