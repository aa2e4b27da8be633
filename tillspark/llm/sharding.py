"""Operator 1 -- uniform sharding by a hypergeometric communication matrix.

A uniform shuffle of N rows into S shards of fixed sizes fixes how many rows
each block of the input sends to each shard: that matrix (block x shard) is
multivariate hypergeometric.  Its rows are drawn by halving: the root holds
the shard sizes; a node's counts are split between its two halves by one
multivariate hypergeometric draw, seeded by the node; after log2(N / BLOCK)
splits a leaf holds the exact counts of one block of BLOCK consecutive rows.
A task therefore draws the matrix rows of its own blocks alone; the matrix is
never gathered.  Inside a block the labels are permuted locally.  Rows are
then exchanged by (shard, cell) and permuted again inside their shard.

Everything is a function of (seed, N, row position), so a re-run task or a
lost executor gives the same result.  The position of a row is the number of
rows in earlier files (one row per file, as bounded as the driver's own file
listing) plus its index in the file, which does not depend on how the scan is
split into tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillspark.llm.common import scratch_table, without

BLOCK_ROWS = 8192
CELL_ROWS = 4096
SEED = 42
#: numpy draws exactly below this; beyond it the sampler in ``hypergeometric`` takes over
NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Number of good items among ``n`` draws without replacement, any size."""
    if good == 0 or n == 0:
        return 0
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    lo, hi = max(0, n - bad), min(n, good)
    total = good + bad
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (total + 2)))
    sd = (n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))) ** 0.5
    reach = int(12 * sd) + 50
    lo, hi = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(lo, hi, dtype=np.float64)  # step from k to k + 1
    step = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    log_p = np.concatenate([[0.0], np.cumsum(step)])
    p = np.exp(log_p - log_p.max())
    return lo + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), side="right").clip(0, len(p) - 1))


def split_counts(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """One multivariate hypergeometric draw of ``n`` rows from ``counts``."""
    out, rest, left = np.zeros_like(counts), int(counts.sum()), n
    for i, c in enumerate(counts.tolist()):
        rest -= c
        out[i] = take = hypergeometric(rng, c, rest, left)
        left -= take
    return out


def shard_sizes(total: int, n_shards: int) -> np.ndarray:
    return np.array([total // n_shards + (s < total % n_shards) for s in range(n_shards)], dtype=np.int64)


def block_labels(total: int, n_shards: int, seed: int, block: int, block_rows: int, seen: dict) -> np.ndarray:
    """The permuted shard labels of one block.  ``seen`` keeps the nodes of the
    last descent (neighbouring blocks share almost all of it)."""
    a, b = 0, -(-total // block_rows)
    path = {(a, b): seen.get((a, b), shard_sizes(total, n_shards))}
    while b - a > 1:
        mid = (a + b) // 2
        here = path[a, b]
        child = (a, mid) if block < mid else (mid, b)
        if child not in seen:
            rng = np.random.default_rng([seed, a, b])
            left = split_counts(rng, here, min(mid * block_rows, total) - a * block_rows)
            seen[a, mid], seen[mid, b] = left, here - left
        path[child] = seen[child]
        a, b = child
    counts = path[a, b]
    for node in [k for k in seen if k not in path]:
        del seen[node]
    return np.random.default_rng([seed, block, 0, 1]).permutation(np.repeat(np.arange(n_shards, dtype=np.int32), counts))


def shard_of(position: Column, total: int, n_shards: int, seed: int, block_rows: int) -> Column:
    """Shard of each row position: the matrix row of its block, locally permuted."""

    @F.pandas_udf("int")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict = {}
        at, labels = -1, np.zeros(0, np.int32)
        for s in batches:
            pos = s.to_numpy(dtype=np.int64)
            out = np.zeros(len(pos), np.int32)
            blocks = pos // block_rows
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(pos)]):
                if hi > lo:
                    if blocks[lo] != at:
                        at = int(blocks[lo])
                        labels = block_labels(total, n_shards, seed, at, block_rows, seen)
                    out[lo:hi] = labels[pos[lo:hi] - at * block_rows]
            yield pd.Series(out)

    return label(position)


def shard_rows(
    docs: DataFrame,
    n_shards: int,
    seed: int = SEED,
    pinned: bool = False,
    shard_col: str = "shard",
    slot_col: str = "slot",
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """All rows of ``docs`` with ``shard`` (int, 0 .. n_shards-1) and ``slot`` (long).

    Shard sizes differ by at most one row; slots run gapless from 0 inside each
    shard; each assignment of rows to (shard, slot) is equally likely.
    ``pinned`` says that ``docs`` is read straight from Parquet files, whose row
    order is fixed; any other frame is first written to the shared folder.

    Nulls, empty or long texts and repeated rows play no part: a row is placed
    by its position alone.  An empty table gives an empty result; with fewer
    rows than shards the last shards stay empty.  Input columns named like the
    two outputs are replaced; all others pass through.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    rows = without(docs, shard_col, slot_col)
    if not pinned:
        rows = scratch_table(rows)
    meta = rows.metadataColumn("_metadata")
    placed = rows.withColumns({"__file": meta["file_path"], "__row": meta["row_index"]})
    files = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    total = files.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    cells = max(1, -(-total // (n_shards * cell_rows)))
    key = F.xxhash64(F.lit(seed), F.col("__pos"))
    labelled = (
        placed.join(F.broadcast(offsets), "__file")  # one row per input file
        .withColumn("__pos", F.col("__before") + F.col("__row"))
        .withColumn(shard_col, shard_of(F.col("__pos"), total, n_shards, seed, block_rows))
        .withColumn("__key", key)
        .withColumn("__cell", F.pmod("__key", F.lit(cells)).cast("int"))
        .drop("__file", "__row", "__before")
    )
    earlier = Window.partitionBy(shard_col).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        labelled.groupBy(shard_col, "__cell")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(shard_col, "__cell", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    )
    inside = Window.partitionBy(shard_col, "__cell").orderBy("__key", "__pos")
    out = (
        labelled.withColumn("__rank", F.row_number().over(inside))
        .join(starts, [shard_col, "__cell"])
        .withColumn(slot_col, (F.col("__start") + F.col("__rank") - 1).cast("long"))
    )
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], shard_col, slot_col)
