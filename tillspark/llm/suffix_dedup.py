"""Operator 7 -- exact substring dedup by a depth-limited MSD radix sort.

Suffixes are ordered through ``depth`` (200) bytes only; groups that are equal
so far are split by one more digit per pass, and suffixes alone in their group
drop out.  Equal groups after the last digit are exactly the repeated windows.

The order of the digits is free, so the most significant one is chosen to drop
most suffixes at the least cost: the least 100-byte gram inside the window (its
minimiser).  Equal windows have equal minimisers, and neighbouring windows
share theirs, so one row stands for a run of about fifty suffixes.

  pass 1  digit = hash of the minimiser: runs with a unique one drop out
  pass 2  digit = hash of all bytes the run's windows cover: equal runs are
          repeated as a whole; one of them stays as a witness for the others
  pass 3  runs left single are cut into blocks of 16 windows, aligned to the
          minimiser; digit = hash of the bytes common to all 16: blocks with a
          unique one drop out; those that cover equal bytes are repeated whole
  pass 4  digit = 128-bit hash of each window, for the blocks left single
          among others of their group, and the witnesses

Groups are only counted (map-side partial sums) and joined back, never
gathered; matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.llm.common import scratch_table, text_or_empty, with_position, without
from tillspark.operators.joins import broadcast_bounded

DEPTH = 200
#: window starts handled together: positions fit the low bits of a rank
CHUNK_BITS = 20
#: windows of one block in pass 3
BLOCK = 16
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class SpanHasher:
    """64-bit polynomial hashes of byte spans under two bases."""

    def __init__(self) -> None:
        n = (1 << CHUNK_BITS) + 1
        self.tables = []
        for base in BASES:
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                t = np.full(n, b, np.uint64)
                t[0] = 1
                pair.append(np.cumprod(t))
            self.tables.append(pair)

    def prefix(self, data: np.ndarray, which: int) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.tables[which][0][: len(data)], out=total[1:])
        return total

    def spans(self, prefix: np.ndarray, lo: np.ndarray | slice, hi: np.ndarray | slice, which: int) -> np.ndarray:
        h = (prefix[hi] - prefix[lo]) * self.tables[which][1][: len(prefix)][lo]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def rolling_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def window_runs(data: np.ndarray, depth: int, hasher: SpanHasher) -> tuple[np.ndarray, ...]:
    """Runs of windows of one piece that share their minimiser:
    (hash of the minimiser, first start, last start, minimiser, hash of the bytes covered)."""
    gram = depth // 2
    p0 = hasher.prefix(data, 0)
    n = len(data)
    grams = hasher.spans(p0, slice(0, n - gram + 1), slice(gram, n + 1), 0)
    low = np.uint64((1 << CHUNK_BITS) - 1)
    rank = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # ties: the leftmost
    at = (rolling_min(rank, depth - gram + 1) & low).astype(np.int64)
    cut = np.flatnonzero(np.diff(at)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(at)]]) - 1
    covered = hasher.spans(hasher.prefix(data, 1), first, last + depth, 1)
    return grams[at[first]], first, last, at[first], covered


def pieces(data: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a text that overlap by depth - 1 bytes, so that each window is in one."""
    step = (1 << CHUNK_BITS) - depth
    for at in range(0, max(0, len(data) - depth + 1), step):
        yield at, data[at : at + step + depth - 1]


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


#: run = first start << 32 | (last - first) << 16 | (minimiser - first)
RUNS = "h long, key long, run long, d long"
BLOCKS = "h long, key long, run long, d long, witness boolean"
WINDOWS = "w1 long, w2 long, key long, at long, witness boolean"
FLUSH_ROWS = 100_000


def _emit(batches: Iterator[pa.RecordBatch], schema: str, rows_of) -> Iterator[pa.RecordBatch]:
    """Collects the arrays that ``rows_of(row, hasher)`` yields into record batches."""
    hasher = SpanHasher()
    names = [c.split()[0] for c in schema.split(", ")]
    out: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        flat = [np.concatenate(v) for v in zip(*out)]
        flat = [v.view(np.int64) if v.dtype == np.uint64 else v for v in flat]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in flat], names=names)

    for batch in batches:
        for i in range(batch.num_rows):
            for arrays in rows_of({k: batch.column(k)[i].as_py() for k in batch.schema.names}, hasher):
                out.append(arrays)
                held += len(arrays[0])
                if held > FLUSH_ROWS:
                    yield flush()
                    out, held = [], 0
    if out:
        yield flush()


def _unpacked(runs: list[dict]) -> np.ndarray:
    """Sorted (first, last, minimiser, witness) of a text's packed runs."""
    v = np.array(sorted((r["run"], r["witness"]) for r in runs), dtype=np.int64).reshape(-1, 2)
    first = v[:, 0] >> 32
    return np.stack([first, first + (v[:, 0] >> 16 & 0xFFFF), first + (v[:, 0] & 0xFFFF), v[:, 1]], axis=1)


def _inside(runs: np.ndarray, base: int, piece: np.ndarray, depth: int) -> np.ndarray:
    """The part of the runs that starts in a piece, relative to it.  A run found
    in one piece lies in it whole."""
    step = (1 << CHUNK_BITS) - depth
    own = runs[(runs[:, 0] >= base) & (runs[:, 0] < base + step)] - np.array([base, base, base, 0])
    return own


def _runs(texts: DataFrame, depth: int) -> DataFrame:
    def of(row: dict, hasher: SpanHasher):
        for at, piece in pieces(_bytes(row["text"]), depth):
            h, lo, hi, m, d = window_runs(piece, depth, hasher)
            yield h, np.full(len(h), row["key"]), (lo + at) << 32 | (hi - lo) << 16 | (m - lo), d

    return texts.mapInArrow(lambda batches: _emit(batches, RUNS, of), RUNS)


def _blocks(texts: DataFrame, depth: int) -> DataFrame:
    """(key, text, runs) -> the blocks of the runs; h is the hash of the common bytes."""

    def of(row: dict, hasher: SpanHasher):
        runs = _unpacked(row["runs"])
        for base, piece in pieces(_bytes(row["text"]), depth):
            own = _inside(runs, base, piece, depth)
            if not len(own):
                continue
            low, high = (own[:, 2] - own[:, 1]) // BLOCK, (own[:, 2] - own[:, 0]) // BLOCK
            n = high - low + 1
            r = np.repeat(np.arange(len(own)), n)
            b = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) + low[r]  # block of offsets BLOCK*b ...
            lo = np.maximum(own[r, 0], own[r, 2] - BLOCK * b - BLOCK + 1)
            hi = np.minimum(own[r, 1], own[r, 2] - BLOCK * b)
            common = own[r, 2] - BLOCK * b  # start of the bytes that all windows of the block hold
            # a first window outside the text only makes the common bytes start earlier than any real window
            h = hasher.spans(hasher.prefix(piece, 0), common, common - BLOCK + 1 + depth, 0) ^ b.astype(np.uint64)
            d = hasher.spans(hasher.prefix(piece, 1), lo, hi + depth, 1)
            packed = (lo + base) << 32 | (hi - lo) << 16 | (own[r, 2] - lo)
            yield h, np.full(len(r), row["key"]), packed, d, own[r, 3].astype(bool)

    return texts.mapInArrow(lambda batches: _emit(batches, BLOCKS, of), BLOCKS)


def _windows(texts: DataFrame, depth: int) -> DataFrame:
    """(key, text, runs) -> the hashes of all windows of the runs."""

    def of(row: dict, hasher: SpanHasher):
        runs = _unpacked(row["runs"])
        for base, piece in pieces(_bytes(row["text"]), depth):
            own = _inside(runs, base, piece, depth)
            if not len(own):
                continue
            n = own[:, 1] - own[:, 0] + 1
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(own[:, 0], n)
            w = [hasher.spans(hasher.prefix(piece, k), at, at + depth, k) for k in (0, 1)]
            yield *w, np.full(len(at), row["key"]), at + base, np.repeat(own[:, 3], n).astype(bool)

    return texts.mapInArrow(lambda batches: _emit(batches, WINDOWS, of), WINDOWS)


def _refine(runs: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """One pass over runs (h, key, run, d, witness) of one level: the spans that are
    repeated as a whole, and what the next pass must read: (key, runs)."""
    kinds = scratch_table(
        runs.groupBy("h", "d").agg(
            F.count(F.lit(1)).alias("n"), F.max("witness").alias("seen"), F.min(F.struct("key", "run")).alias("one")
        )
    )
    settled = (F.col("n") > 1) | F.col("seen")
    split = (
        kinds.groupBy("h")
        .agg(F.count(F.lit(1)).alias("kinds"), F.min(settled).alias("done"))
        .where((F.col("kinds") > 1) & ~F.col("done"))
        .select("h")
    )
    todo = kinds.join(split, "h").select("one.key", F.struct(F.col("one.run").alias("run"), settled.alias("witness")).alias("r"))
    per_text = scratch_table(todo.groupBy("key").agg(F.collect_list("r").alias("runs")))  # at most a text's length
    first, length = F.shiftright("run", 32), F.shiftright("run", 16).bitwiseAND(F.lit(0xFFFF))
    whole = (
        runs.where(~F.col("witness"))
        .join(kinds.where("n > 1").select("h", "d"), ["h", "d"])
        .select("key", first.alias("lo"), (first + length + depth).alias("hi"))
    )
    return whole, per_text


def _cut(text, spans):
    """pandas UDF body: bytes outside the spans, number of bytes cut, number of maximal cuts."""
    import pandas as pd

    rows = []
    for t, s in zip(text, spans):
        data = (t or "").encode("utf-8", "surrogatepass")
        kept, at, cuts, n = [], 0, 0, 0
        for lo, hi in sorted((x["lo"], x["hi"]) for x in s):
            if lo > at or cuts == 0:
                kept.append(data[at:lo])
                cuts += 1
            start = max(lo, at)
            if hi > start:
                n += hi - start
                at = hi
        kept.append(data[at:])
        rows.append((b"".join(kept), n, cuts))
    return pd.DataFrame(rows, columns=["kept", "n_removed", "n_spans"])


def remove_repeats(docs: DataFrame, depth: int = DEPTH, pinned: bool = False) -> DataFrame:
    """All rows of ``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` (long) and ``kept`` (binary).

    Removed is each byte covered by a string of ``depth`` bytes that also
    starts anywhere else in the table, the same document included; every
    occurrence is removed, judged on the input.  ``n_spans`` counts the maximal
    removed stretches; ``kept`` is the rest, concatenated (it may cut a
    multi-byte character).

    Null text is empty; texts shorter than ``depth`` are kept; repeated rows
    remove each other; an empty table gives an empty result.  ``pinned``: the
    table is read straight from Parquet files, else it is first written to the
    shared folder.  Input columns named like the outputs are replaced.
    """
    if depth < 4 * BLOCK or depth >= 1 << 16:
        raise ValueError("depth out of range")
    rows = without(docs, "n_bytes", "n_removed", "n_spans", "kept", "__pos", "__spans", "__cut", "__own", "__key")
    rows = with_position(rows if pinned else scratch_table(rows), "__pos")
    texts = rows.select(F.col("__pos").alias("key"), text_or_empty("text").alias("text")).where(F.octet_length("text") >= depth)

    runs = _runs(texts, depth)
    # pass 1: the minimiser
    repeated = runs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    runs = scratch_table(runs.join(repeated, "h").withColumn("witness", F.lit(False)))
    # pass 2: all bytes of the run
    by_run, per_text = _refine(runs, depth)

    def with_runs(todo: DataFrame) -> DataFrame:
        return texts.join(broadcast_bounded(todo.select("key")), "key", "left_semi").join(todo, "key")

    # pass 3: the bytes common to a block, then all bytes of the block
    by_block, per_text = _refine(scratch_table(_blocks(with_runs(per_text), depth)), depth)
    # pass 4: each window of what is left
    windows = scratch_table(_windows(with_runs(per_text), depth))
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    single = windows.where(~F.col("witness")).join(twice, ["w1", "w2"]).select(
        "key", F.col("at").alias("lo"), (F.col("at") + depth).alias("hi")
    )
    whole = by_run.union(by_block)
    spans = scratch_table(
        whole.union(single).groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("__spans"))  # at most a text's length
    )
    keys = broadcast_bounded(spans.select(F.col("key").alias("__key")))
    own = spans.select(F.col("key").alias("__own"), "__spans")
    hit = rows.join(keys, F.col("__pos") == F.col("__key"), "left_semi").join(own, F.col("__pos") == F.col("__own")).drop("__own")
    cut = F.pandas_udf(_cut, "kept binary, n_removed long, n_spans long")
    hit = hit.withColumn("__cut", cut(F.col("text"), F.col("__spans"))).drop("__spans")
    clean = rows.join(keys, F.col("__pos") == F.col("__key"), "left_anti").withColumn(
        "__cut",
        F.struct(
            text_or_empty("text").cast("binary").alias("kept"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans")
        ),
    )
    out = hit.unionByName(clean).withColumn("n_bytes", F.octet_length(text_or_empty("text")).cast("long"))
    names = [F.col(f"`{c}`") for c in rows.columns if c != "__pos"]
    return out.select(*names, "n_bytes", F.col("__cut.n_removed"), F.col("__cut.n_spans"), F.col("__cut.kept"))
