"""Operator 11 -- MinHash near-duplicates on HyperMinHash sketches.

A text's set is its distinct word shingles.  The sketch has ``REGISTERS``
buckets of 16 bits: the least shingle hash of the bucket, kept as its number of
leading zeros (6 bits) and the ``MANTISSA`` bits that follow.  A bucket that no
shingle falls in is filled by the first later round (the shingles hashed anew)
that reaches it, so texts of one shingle have full sketches too and two
registers agree with probability J.  The round is mixed into the register.

  1  equal sets become one row (digest of the whole set)
  2  bands of ``ROWS`` registers; sets that share a band meet in its bucket
  3  each member of a bucket is compared with the least member, and again with
     a member drawn anew for each bucket, where their components still differ
  4  what then lies in several components of one bucket is compared in tiles
     of two blocks of bounded bytes: the members outside the bucket's largest
     component against all; no pair is left out, no group is gathered whole,
     and only links leave a tile

A comparison estimates J from the agreeing registers, corrected for accidental
agreement, and drops what lies below the threshold by more than the sketch can
err; what remains is decided on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.llm.common import scratch_table, with_position, without
from tillspark.llm.components import connected_components
from tillspark.operators.joins import broadcast_bounded

SHINGLE_WORDS = 5
SIMILARITY = 80  # per cent
REGISTERS = 256
MANTISSA = 10
#: registers of a band; a pair at J = 0.8 misses all 42 bands with probability 3e-6
ROWS = 6
BANDS = REGISTERS // ROWS
#: standard deviations of the estimate below which a pair is dropped (2e-8 of the pairs at the threshold)
SLACK = 5.5
#: bytes of sketches and sets in a block of a bucket
TILE_BYTES = 1 << 22
#: the low bits of a bucket's number are its band
BAND_STEP = 64
SEED = 42
VALUE_BITS = 44
ROUNDS_MAX = 1 << 12
MEMO_WORDS = 500_000
SKETCH = "n long, d1 long, d2 long, regs binary"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hash of each word met; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


def shingle_set(text: str | None, k: int, memo: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``k``-word shingles; the whole
    sequence if it is shorter, nothing without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(k, len(words))
    factors = _mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    total = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        total += h[j : len(h) - size + 1 + j] * factors[j]
    return np.unique(_mix(total))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set."""
    regs = np.zeros(REGISTERS, np.uint16)
    empty = np.ones(REGISTERS, bool)
    low = np.uint64((1 << VALUE_BITS) - 1)
    first = 0
    n = len(hashes)
    while empty.any():
        rounds = max(1, min(ROUNDS_MAX, -(-10 * REGISTERS // n))) if n < 8 * REGISTERS or first else 1
        at = np.arange(first, first + rounds, dtype=np.uint64)
        g = _mix(hashes[None, :] ^ _mix(at * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))[:, None])
        # bucket (8 bits), round (12 bits), value (44 bits): the first of a bucket is its register
        order = np.sort(((g >> np.uint64(56)) << np.uint64(56) | (at - np.uint64(first))[:, None] << np.uint64(VALUE_BITS) | g & low).ravel())
        start = np.searchsorted(order, np.arange(REGISTERS, dtype=np.uint64) << np.uint64(56))
        held = order[np.minimum(start, len(order) - 1)]
        found = empty & (held >> np.uint64(56) == np.arange(REGISTERS, dtype=np.uint64)) & (start < len(order))
        value, turn = held & low, (held >> np.uint64(VALUE_BITS) & np.uint64(0xFFF)) + np.uint64(first)
        part, exponent = np.frexp(value.astype(np.float64))
        mantissa = np.maximum((part * 2 - 1) * (1 << MANTISSA), 0).astype(np.uint16)
        packed = (VALUE_BITS - exponent).astype(np.uint16) << MANTISSA | mantissa
        packed ^= np.where(turn > 0, _mix(turn) >> np.uint64(48), 0).astype(np.uint16)
        regs[found] = packed[found]
        empty &= ~found
        first += rounds
    return regs


def _sketches(k: int):
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = _Words()
        for texts in batches:
            rows = []
            for t in texts:
                s = shingle_set(t, k, memo)
                digest = [int((_mix(s ^ np.uint64(c)).sum(dtype=np.uint64)).view(np.int64)) for c in (0x243F6A8885A308D3, 0x13198A2E03707344)]
                rows.append((len(s), *digest, sketch(s).tobytes() if len(s) else None))
            yield pd.DataFrame(rows, columns=["n", "d1", "d2", "regs"])

    return F.pandas_udf(of, SKETCH)


def _sets(k: int):
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = _Words()
        for texts in batches:
            yield pd.Series([shingle_set(t, k, memo).tobytes() for t in texts])

    return F.pandas_udf(of, "binary")


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, regs) -> (bucket, key) for each band."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(n, REGISTERS)
        part = regs[:, : BANDS * ROWS].reshape(n, BANDS, ROWS).astype(np.uint64)
        h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS))
        for j in range(0, ROWS, 3):
            word = part[:, :, j]
            for i in range(j + 1, min(j + 3, ROWS)):
                word = word << np.uint64(16) | part[:, :, i]
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) ^ word)
        h = h & ~np.uint64(BAND_STEP - 1) | np.arange(BANDS, dtype=np.uint64)
        keys = np.repeat(batch.column("key").to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(keys)], names=["bucket", "key"])


def accidental(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that two unequal least hashes give one register, for sets of
    ``a`` and ``b`` shingles: same round, same leading zeros, same mantissa."""
    edges = np.concatenate([2.0 ** -np.arange(VALUE_BITS), [0.0]]) / REGISTERS

    def zeros(n: np.ndarray) -> np.ndarray:  # the distribution of the leading zeros
        above = np.exp(n[:, None] * np.log1p(-edges[None, :]))
        return np.diff(above, axis=1) / (1 - above[:, :1])

    a, b = a.astype(float), b.astype(float)
    qa, qb = (-np.expm1(n * np.log1p(-1 / REGISTERS)) for n in (a, b))
    return qa * qb / (1 - (1 - qa) * (1 - qb)) * (zeros(a) * zeros(b)).sum(axis=1) / (1 << MANTISSA)


def estimate(agree: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of agreeing registers, collision-corrected."""
    c = accidental(a, b)
    return (agree / REGISTERS - c) / (1 - c)


def _floor(percent: int) -> float:
    s = percent / 100
    return s - SLACK * (s * (1 - s) / REGISTERS) ** 0.5


def _near(percent: int):
    """pandas UDF: estimate from the sketches, then the full sets decide."""

    def of(an, ar, aset, bn, br, bset):
        out = np.zeros(len(an), bool)
        if not len(an):
            return pd.Series(out)
        a, b = an.to_numpy(), bn.to_numpy()
        agree = (
            np.frombuffer(b"".join(ar), np.uint16).reshape(-1, REGISTERS) == np.frombuffer(b"".join(br), np.uint16).reshape(-1, REGISTERS)
        ).sum(axis=1)
        sized = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        for i in np.flatnonzero(sized & (estimate(agree, a, b) >= _floor(percent))):
            x, y = np.frombuffer(aset[i], np.uint64), np.frombuffer(bset[i], np.uint64)
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            out[i] = 100 * common >= percent * (len(x) + len(y) - common)
        return pd.Series(out)

    return F.pandas_udf(of, "boolean")


def _confirmed(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) that are linked, as edges."""
    side = lambda s: profiles.select(*[F.col(c).alias(s + c) for c in ("key", "n", "regs", "set")])
    both = pairs.join(side("a_"), F.col("a") == F.col("a_key")).join(side("b_"), F.col("b") == F.col("b_key"))
    ok = _near(percent)(*[F.col(s + c) for s in ("a_", "b_") for c in ("n", "regs", "set")])
    return scratch_table(both.select("a", "b", ok.alias("ok")).where("ok").select("a", "b"))


def _open(members: DataFrame) -> DataFrame:
    """The members of buckets that hold several components."""
    several = members.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket")
    return scratch_table(members.join(several, "bucket"))


def _with_component(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(bucket, key, ...) -> (bucket, key, comp) of buckets that hold several components."""
    comps = connected_components(edges)
    return _open(
        scratch_table(members.select("bucket", "key").join(comps, F.col("key") == F.col("node"), "left").select("bucket", "key", F.coalesce("root", "key").alias("comp")))
    )


def _tiled(percent: int):
    def linked(x: np.ndarray, others: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Which of the other full sets are linked with the set ``x``."""
        y = np.frombuffer(b"".join(others), np.uint64)
        hit = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
        common = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
        return 100 * common >= percent * (len(x) + sizes - common)

    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The links of one tile, between its minor members and all members of its two blocks.

        A pair that shares several bands is judged in the first of them only.
        """
        band = key[0] & (BAND_STEP - 1)
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            regs = np.frombuffer(b"".join(right.regs), np.uint16).reshape(-1, REGISTERS)
            keys, n, comp, sets = right.key.to_numpy(), right.n.to_numpy(), right.comp.to_numpy(), right.set.to_numpy()
            for x in left.itertuples(index=False):
                same = regs == np.frombuffer(x.regs, np.uint16)
                fit = (comp != x.comp) & (100 * np.minimum(n, x.n) >= percent * np.maximum(n, x.n))
                fit &= estimate(same.sum(axis=1), np.full(len(n), x.n), n) >= _floor(percent)
                at = np.flatnonzero(fit)
                at = at[same[at, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
                if len(at):
                    at = at[linked(np.frombuffer(x.set, np.uint64), list(sets[at]), n[at])]
                    out += [(min(x.key, k), max(x.key, k)) for k in keys[at].tolist()]
        return pd.DataFrame({"a": np.array([o[0] for o in out], np.int64), "b": np.array([o[1] for o in out], np.int64)})

    return of


def _tiles(members: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The links between different components of one bucket: members outside
    the bucket's largest component against all, in blocks of about TILE_BYTES."""
    weighed = scratch_table(members.join(profiles, "key").withColumn("bytes", F.lit(2 * REGISTERS) + F.octet_length("set")))
    counts = weighed.groupBy("bucket", "comp").agg(F.sum("bytes").alias("c"))
    per_bucket = counts.groupBy("bucket").agg(F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("most"))
    blocks = lambda n: F.ceil(n / F.lit(TILE_BYTES)).cast("int")
    sized = per_bucket.select(
        "bucket", F.col("most.comp").alias("major"), blocks(F.col("all") - F.col("most.c")).alias("nl"), blocks(F.col("all")).alias("nr")
    )
    placed = weighed.drop("bytes").join(sized, "bucket")
    own = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["bucket", "key", "comp", "n", "regs", "set"]
    left = placed.where(F.col("comp") != F.col("major")).select(*cols, F.lit(0).alias("side"), own(F.col("nl")).alias("l"), every("nr").alias("r"))
    right = placed.select(*cols, F.lit(1).alias("side"), every("nl").alias("l"), own(F.col("nr")).alias("r"))
    tiles = left.unionByName(right).repartition("bucket", "l", "r")  # not by the bucket alone, which may be hot
    return tiles.groupBy("bucket", "l", "r").applyInPandas(_tiled(percent), "a long, b long")


def minhash_components(
    docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = SIMILARITY, keep: list[str] | None = None, pinned: bool = False
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns ``keep``, ``n_shingles``
    (size of its set), ``component_id`` (smallest non-null doc_id that links
    reach, itself included) and ``kept`` (doc_id is component_id).

    Words are runs of non-white-space after lower-casing A-Z.  Two rows are
    linked if 100 * intersection >= percent * union of their sets of ``k``-word
    shingles (64-bit hashes); a text of fewer words is one shingle.  Null, empty
    and wordless texts have an empty set and are linked with nothing, each its
    own component.  Rows of equal sets are linked whatever their ids; a null
    doc_id counts as larger than all, and a component of null ids has a null
    component_id (its rows are kept).  Texts are read whole: memory grows with
    the longest single text.  An empty table gives an empty result.
    Kept columns named like the outputs are left out.
    ``pinned``: the table is read straight from Parquet files, else it is first
    written to the shared folder.
    """
    names = ["doc_id", *(c for c in keep or [] if c.lower() not in ("doc_id", "text", "n_shingles", "component_id", "kept"))]
    rows = without(docs.select(*dict.fromkeys([*names, "text"])), "__pos")
    rows = with_position(rows if pinned else scratch_table(rows), "__pos")
    narrow = scratch_table(rows.select(*names, "__pos", _sketches(k)(F.col("text").cast("string")).alias("__s")))
    s = lambda c: F.col(f"__s.{c}")
    sets = scratch_table(
        narrow.where(s("n") > 0)
        .groupBy(s("d1").alias("d1"), s("d2").alias("d2"), s("n").alias("n"))
        .agg(F.min("__pos").alias("key"), F.min("doc_id").alias("first_id"), F.first(s("regs")).alias("regs"))
    )
    bands = scratch_table(sets.select("key", "regs").mapInArrow(_bands, "bucket long, key long"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("key").alias("least")).where("c > 1")
    members = scratch_table(bands.join(shared.select("bucket", "least"), "bucket"))
    wanted = scratch_table(members.select("key").distinct())
    texts = rows.join(broadcast_bounded(wanted.withColumnRenamed("key", "__key")), F.col("__pos") == F.col("__key"))
    profiles = scratch_table(
        sets.select("key", "n", "regs").join(texts.select("__key", _sets(k)(F.col("text").cast("string")).alias("set")), F.col("key") == F.col("__key")).drop("__key")
    )
    edges = _confirmed(members.where("key > least").select(F.col("least").alias("a"), F.col("key").alias("b")).distinct(), profiles, percent)
    # all pairs with the least member are judged; what a second member, drawn anew for each bucket, links
    left = _with_component(members.where("key > least"), edges)
    drawn = left.groupBy("bucket").agg(F.min_by(F.struct("key", "comp"), F.xxhash64("bucket", "key")).alias("w"))
    left = scratch_table(left.join(drawn, "bucket"))
    pairs = left.where(F.col("comp") != F.col("w.comp")).select(F.least("key", "w.key").alias("a"), F.greatest("key", "w.key").alias("b")).distinct()
    edges = scratch_table(edges.union(_confirmed(pairs, profiles, percent)))
    left = _with_component(left.where(F.col("key") != F.col("w.key")), edges)
    edges = edges.union(scratch_table(_tiles(left, profiles, percent)))
    comps = connected_components(edges)
    rooted = sets.join(comps, F.col("key") == F.col("node"), "left").select("d1", "d2", F.col("n").alias("__n"), "first_id", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_set = rooted.join(least, "root").select(F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), "__n", F.col("component_id").alias("__c"))
    found = narrow.join(of_set, (s("d1") == F.col("__d1")) & (s("d2") == F.col("__d2")) & (s("n") == F.col("__n")), "left")
    component = F.when(s("n") > 0, F.col("__c")).otherwise(F.col("doc_id"))
    return found.select(*names, s("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
