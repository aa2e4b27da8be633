"""Operator 10 -- document fingerprints from prefix polynomial hashes.

For a text c[0..n) and a prime p, P[i] = sum of (c[j] + 1) * B**j mod p over
j < i.  The hash of any span [i, j) is (P[j] - P[i]) * B**-i mod p, so equality
of any two spans is one comparison, and the longest common extension of two
positions is found by binary search.  Two primes are used together.

A fingerprint holds the text's length, its whole hash under both primes, and
a 64-bin sketch of the hashes of its spans of 12 code points (16 bits of a second
mix of the least in each bin: its own bits tend to zero in long texts); the likeness of two fingerprints is the share of equal bins among those
that either uses, an estimate of the spans they share.

Each document is also compared with an edited text built from the next
document in descending doc_id.  Rows are dealt to buckets of that order; the
first row of a bucket is also sent, as a guest, to the bucket before, so every
neighbour is met in one exchange of the texts and no order is made in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
SPAN = 12
BINS = 64
EMPTY = "____"
BUCKET_ROWS = 8192


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (SplitMix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PrefixHasher:
    """Prefix arrays modulo both primes, with power tables that grow to the longest text."""

    def __init__(self) -> None:
        self.power: list = [np.ones(1, np.uint64) for _ in PRIMES]
        self.inverse: list = [np.ones(1, np.uint64) for _ in PRIMES]
        self.need(1 << 14)

    def need(self, n: int) -> None:
        while len(self.power[0]) <= n:
            for k, (p, b) in enumerate(zip(PRIMES, BASES)):
                for table, base in ((self.power, b), (self.inverse, pow(b, -1, p))):
                    old = table[k]  # doubling: B**(m + i) = B**m * B**i
                    table[k] = np.concatenate([old, old * np.uint64(pow(base, len(old), p)) % np.uint64(p)])

    def prefix(self, codes: np.ndarray) -> list[np.ndarray]:
        self.need(len(codes))
        out = []
        for k, p in enumerate(PRIMES):
            total = np.zeros(len(codes) + 1, np.uint64)
            # terms below 2**31: the running sum stays below 2**64 up to 2**33 code points
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.power[k][: len(codes)] % np.uint64(p), out=total[1:])
            out.append(total % np.uint64(p))
        return out

    def span(self, prefix: list[np.ndarray], i: int, j: int) -> tuple[int, ...]:
        """Hash of the span [i, j) under both primes."""
        return tuple((int(prefix[k][j]) - int(prefix[k][i])) * int(self.inverse[k][i]) % p for k, p in enumerate(PRIMES))

    def extension(self, a: list[np.ndarray], i: int, b: list[np.ndarray], j: int) -> int:
        """Length of the longest common extension of position i of a and j of b."""
        lo, hi = 0, min(len(a[0]) - 1 - i, len(b[0]) - 1 - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.span(a, i, i + mid) == self.span(b, j, j + mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def spans(self, prefix: list[np.ndarray], width: int) -> np.ndarray:
        """Hashes of all spans of ``width`` (the whole text if shorter) under both primes, mixed into 64 bits."""
        n = len(prefix[0]) - 1
        width = min(width, n)
        if n == 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n - width + 1, np.uint64)
        for k, prime in enumerate(PRIMES):
            p = np.uint64(prime)
            diff = (prefix[k][width:] + p - prefix[k][: n - width + 1]) % p
            h = (h << np.uint64(31)) | (diff * self.inverse[k][: n - width + 1] % p)
        return mix(h)

    def fingerprint(self, prefix: list[np.ndarray]) -> str:
        n = len(prefix[0]) - 1
        h = self.spans(prefix, SPAN)
        at = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.intp)
        least, used = np.full(BINS, ~np.uint64(0)), np.zeros(BINS, bool)
        np.minimum.at(least, at, h)
        used[at] = True
        kept = mix(least) >> np.uint64(48)  # uniform however small the least hash is
        sketch = "".join(f"{v:04x}" if u else EMPTY for v, u in zip(kept.tolist(), used.tolist()))
        whole = self.span(prefix, 0, n)
        return f"{n:x}-{whole[0]:08x}{whole[1]:08x}-{sketch}"


def likeness(a: str, b: str) -> float:
    """Share of equal bins among those used by either; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = a.rpartition("-")[2], b.rpartition("-")[2]
    pairs = [(x[i : i + 4], y[i : i + 4]) for i in range(0, 4 * BINS, 4)]
    used = [(p, q) for p, q in pairs if p != EMPTY or q != EMPTY]
    return sum(p == q for p, q in used) / len(used) if used else 0.0


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _compare(rows: Iterator[tuple], hasher: PrefixHasher) -> Iterator[tuple]:
    """(bucket, guest, doc_id, text) in order -> one result per row that is no guest."""
    import hashlib

    last = None
    for bucket, guest, doc_id, text in rows:
        if last is not None and last[0] != bucket:
            last = None
        if last is None and guest:
            continue  # a repeated guest: its bucket is done
        codes = code_points(text)
        prefix = hasher.prefix(codes)
        here = (bucket, doc_id, text, codes, prefix, hasher.fingerprint(prefix))
        if last is not None:
            _, own_id, own, own_codes, own_prefix, own_print = last
            half = len(own_codes) // 2
            edited = np.concatenate([own_codes[: len(own_codes) - half], codes[:half]])
            edited_prefix = hasher.prefix(edited)
            edited_print = hasher.fingerprint(edited_prefix)
            sha = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
            yield (
                own_id,
                len(own_codes),
                sha,
                own_print,
                edited_print,
                likeness(own_print, edited_print),
                likeness(own_print, here[5]),
                hasher.extension(own_prefix, 0, edited_prefix, 0),
                hasher.extension(own_prefix, 0, prefix, 0),
            )
        last = None if guest else here


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_edited long, common_next long"
)


def _bucket_of(doc_id: Column, bounds: list) -> Column:
    """Index of the bucket in descending order; null ids in the last."""
    cuts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def bucket(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            known = s.notna().to_numpy()
            out = np.full(len(s), len(cuts))
            out[known] = len(cuts) - np.searchsorted(cuts, s[known].to_numpy(dtype=np.int64), side="right")
            yield pd.Series(out.astype(np.int32))

    # cast twice: nullable longs reach pandas as doubles otherwise
    return bucket(doc_id)


def compare_with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of ``docs`` (columns of ``RESULT``): the fingerprints of the
    text and of its edited form, their likeness, and the longest common prefix
    with the edited text and with the next document.

    The edited text has its last floor(n/2) code points replaced by the first
    as many (or all) of the next document: descending doc_id, null ids last,
    ties by text hash; after the last comes the first (a single row is its own
    next).  Null text is empty.  Repeated rows follow one another.  An empty
    table gives an empty result; other columns of ``docs`` are not read.  Texts are
    hashed whole: memory grows with the longest text and its neighbour.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("__th", F.xxhash64("text"))
    ids = rows.select("doc_id")
    n = ids.count()
    buckets = max(1, -(-n // bucket_rows))
    known = ids.where(F.col("doc_id").isNotNull())
    at = [i / buckets for i in range(1, buckets)]
    bounds = sorted({int(x) for x in known.approxQuantile("doc_id", at, 0.2 / buckets)}) if at else []
    placed = rows.withColumn("__bucket", _bucket_of(F.col("doc_id"), bounds))
    # the first row of each bucket: one row per bucket
    order = F.struct(F.col("doc_id").isNull().alias("n"), (-F.col("doc_id")).alias("d"), F.col("__th").alias("t"))
    firsts = {r[0]: r[1] for r in placed.drop("text").groupBy("__bucket").agg(F.min(order)).collect()}
    filled = sorted(firsts)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}  # the first bucket's first row goes to the last
    tops = spark.createDataFrame(
        [(b, firsts[b]["d"], firsts[b]["t"], before[b]) for b in filled], "__b int, __d long, __t long, __to int"
    )
    same = (F.col("__bucket") == F.col("__b")) & (-F.col("doc_id")).eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t"))
    dealt = placed.join(F.broadcast(tops), same, "left")  # one row per bucket
    homes = F.array(
        F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("guest")),
        F.struct(F.col("__to").alias("b"), F.lit(True).alias("guest")),
    )
    dealt = dealt.withColumn("__home", F.explode(F.when(F.col("__to").isNull(), F.slice(homes, 1, 1)).otherwise(homes)))
    dealt = dealt.select(F.col("__home.b").alias("b"), F.col("__home.guest").alias("guest"), "doc_id", "text", "__th")
    ordered = dealt.repartition("b").sortWithinPartitions("b", "guest", F.col("doc_id").desc_nulls_last(), "__th")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each():
            for pdf in batches:
                ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
                yield from zip(pdf["b"], pdf["guest"], ids, pdf["text"])

        names = [c.split()[0] for c in RESULT.split(", ")]
        out: list[tuple] = []
        for row in _compare(each(), PrefixHasher()):
            out.append(row)
            if len(out) == 2000:
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
                out = []
        if out:
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return ordered.drop("__th").mapInPandas(run, RESULT)
