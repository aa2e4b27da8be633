"""Operator 6 -- SimHash near-duplicates by pigeonring filtering.

A 64-bit fingerprint is a ring of eight 8-bit segments.  If two fingerprints
differ in at most 2 bits, some start exists from which every chain of l
consecutive segments differs in at most l * 2 / 8 bits (the pigeonring
principle): none in the first three segments, at most one through the
seventh, at most two in all.  Of the four segments after the first three, one
half is then equal too.  So each distinct fingerprint gets 16 keys (8 starts x
2 halves) of 24 + 16 equal bits; fingerprints that share a key are candidates,
the chain budget prunes them and the full Hamming distance decides.

Keys shared by more than ``SMALL_BUCKET`` distinct fingerprints are never
paired: their members can differ in 24 known bits only, and two of them are
within 2 bits exactly if they share a centre one flip (or none) away.  Members
are grouped by (key, centre), at most 25 in a group, and linked to the least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.common import scratch_table, without
from tillspark.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42
SMALL_BUCKET = 256
SEGMENTS = 8


def _fingerprint(text: str | None, k: int, seed: int) -> int:
    import itertools

    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        h = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    else:
        ends = list(itertools.accumulate(len(w) + 1 for w in words))
        view, xx = memoryview(joined), xxhash.xxh64_intdigest
        h = np.fromiter((xx(view[s : e - 1], seed) for s, e in zip([0, *ends], ends[k - 1 :])), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # whole text, in pieces of bounded memory
        part = h[i : i + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(part) // 255
        if full:
            ones += np.add.reduce(bits[: full * 255].reshape(full, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[full * 255 :].sum(axis=0, dtype=np.int64)
    value = np.packbits(2 * ones > len(h), bitorder="little").view("<i8")
    return int(value[0])


def fingerprint(text: Column, k: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> Column:
    """64-bit SimHash (as a signed long) of the word ``k``-shingles of ``text``.

    Words are runs of non-white-space after lower-casing A-Z; a text of fewer
    words is one shingle; null or wordless text gives 0.
    """

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:  # one text at a time becomes a Python string
            yield pa.array([_fingerprint(t.as_py(), k, seed) for t in texts], pa.int64())

    return of(text)


def _rotated(x: Column, start: int) -> Column:
    bits = 8 * start
    return x if bits == 0 else F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def _keys(fps: DataFrame) -> DataFrame:
    """(fp) -> 16 rows (k, start, half, fp); k packs chain start, half and the 40 equal bits."""
    keys = []
    for start in range(SEGMENTS):
        r = _rotated(F.col("fp"), start)
        prefix = F.shiftrightunsigned(r, 40)
        for half in (0, 1):
            equal = F.shiftrightunsigned(r, 24 if half == 0 else 8).bitwiseAND(F.lit(0xFFFF))
            k = F.lit((start * 2 + half) << 40).cast("long").bitwiseOR(F.shiftleft(prefix, 16)).bitwiseOR(equal)
            keys.append(k)
    return fps.select("fp", F.explode(F.array(*keys)).alias("k"))


def _chain_holds(a: Column, b: Column, start: Column) -> Column:
    """Budgets of the chain from ``start`` (0-7), then the full Hamming check."""
    diff = a.bitwiseXOR(b)
    by_start = F.lit(False)
    for i in range(SEGMENTS):
        # chains of 4 to 7 segments: one bit at most (the first three are equal by the key)
        by_start = F.when(start == i, F.bit_count(F.shiftrightunsigned(_rotated(diff, i), 8)) <= 1).otherwise(by_start)
    return by_start & (F.bit_count(diff) <= MAX_BITS)


def near_edges(fps: DataFrame, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) that join exactly those within 2 bits, transitively."""
    keyed = _keys(fps)
    shared = scratch_table(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    members = keyed.join(shared, "k")
    start = F.shiftright(F.col("k"), 41).cast("int")
    grouped = (
        members.where(F.col("n") <= small_bucket)
        .groupBy("k")
        .agg(F.collect_list("fp").alias("fps"))  # at most small_bucket
        .withColumn("start", start)
    )
    pairs = grouped.select("start", "fps", F.explode("fps").alias("a")).select(
        "a", F.explode(F.filter("fps", lambda b: (b > F.col("a")) & _chain_holds(F.col("a"), b, F.col("start")))).alias("b")
    )
    crowded = members.where(F.col("n") > small_bucket)
    centres = []
    for s in range(SEGMENTS):
        for half in (0, 1):
            free = list(range(8)) + (list(range(8, 24)) if half == 1 else list(range(24, 40)))
            if half == 1:  # bits 8..23 of the rotated value are equal, 24..39 are free
                free = list(range(8)) + list(range(24, 40))
            else:
                free = list(range(8)) + list(range(8, 24))
            flips = []
            for bit in free:
                at = (bit - 8 * s) % 64  # rotated left by 8s: original bit position
                v = 1 << at
                flips.append(v - (1 << 64) if v >= 1 << 63 else v)
            centres.append(((s * 2 + half), [0, *flips]))
    which = F.shiftright(F.col("k"), 40)
    flips = F.lit(None).cast("array<long>")
    for w, f in centres:
        flips = F.when(which == w, F.array(*[F.lit(x).cast("long") for x in f])).otherwise(flips)
    stars = (
        crowded.select("k", "fp", F.explode(flips).alias("flip"))
        .select("k", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
        .groupBy("k", "centre")
        .agg(F.collect_list("fp").alias("fps"))  # at most 25
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("b"), F.explode("fps").alias("a"))
        .where("a > b")
        .select("a", "b")
    )
    return pairs.union(stars).distinct()


def simhash_components(docs: DataFrame, k: int = SHINGLE_WORDS, seed: int = HASH_SEED, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns ``keep``, ``fingerprint``
    (16 lowercase hex digits), ``component_id`` and ``component`` (least
    fingerprint of the class, as a long).

    Rows whose fingerprints differ in at most 2 bits are linked; a component is
    what links reach.  ``component_id`` is its smallest non-null doc_id (null if
    it has none).  Null and wordless texts have fingerprint 0 and link like any
    other; repeated rows share a fingerprint; an empty table gives an empty result.
    Texts are hashed whole, in pieces of bounded memory.
    """
    cols = [F.col(c) for c in ["doc_id", *(keep or [])]]
    narrow = scratch_table(docs.select(*cols, fingerprint(F.col("text"), k, seed).alias("__fp")))
    per_fp = narrow.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("first_id"))
    comps = connected_components(near_edges(per_fp.select("fp")))
    rooted = per_fp.join(comps, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id", F.col("root").alias("component"))
    return narrow.join(of_fp, F.col("__fp") == F.col("fp")).select(
        "doc_id",
        *(keep or []),
        F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "component",
    )


def keep_one_per_component(docs: DataFrame, k: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> DataFrame:
    """The rows of ``docs`` that stay: one per component, all columns unchanged.

    The row with the smallest doc_id stays (null last); among rows of one doc_id
    the one with the smallest text hash; of rows equal in both, one.
    """
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("__th"))
    found = simhash_components(marked, k, seed, keep=["__th"])
    # a null doc_id sorts last: flag first in the struct
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("__th").alias("t"))).alias("w")
    winners = found.groupBy("component").agg(first).select(F.col("w.i").alias("__wi"), F.col("w.t").alias("__wt")).distinct()
    rows = without(docs, "__th").withColumn("__th", F.xxhash64("text"))
    kept = rows.join(winners, F.col("doc_id").eqNullSafe(F.col("__wi")) & (F.col("__th") == F.col("__wt")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__th"]).drop("__th")
