"""Join building blocks.

Broadcast policy:
* ``broadcast_bounded`` hints a broadcast only after proving the side has at
  most ``max_rows`` rows (an incremental take that stops early) and, unless
  Catalyst's estimate is small anyway, at most ``BROADCAST_BYTES`` of values;
  beyond the bounds it returns the frame unhinted, so Catalyst/AQE choose a
  shuffled join.
* Frames that are bounded by construction (literal parameter tables, a
  post-aggregate of a bounded key) may use ``F.broadcast`` directly.
* Everything else is left to Catalyst's size estimate and AQE's runtime
  conversion (``autoBroadcastJoinThreshold``).

NULL foreign keys (walk-in customers: a large share of sales) all hash to the
same reducer in a shuffled join.  ``left_lookup`` spreads them by joining on
(key-or-salt, is-null) so those rows never match and never pile up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dimension sides are projected to a key and one or two narrow columns
# before the check, so 1M rows stay in the tens of MB per broadcast.
DIM_BROADCAST_ROWS = 1_000_000
DEFAULT_BROADCAST_ROWS = DIM_BROADCAST_ROWS
NULL_SALT_BUCKETS = 512
BROADCAST_BYTES = 256 << 20
#: estimates up to this are not measured
SMALL_ESTIMATE = 32 << 20
#: partitions that the hottest key could fill by itself in ``spread_left_join``
SPREAD = 200


def row_bound_holds(df: DataFrame, max_rows: int) -> bool:
    """True iff ``df`` has at most ``max_rows`` rows.

    ``offset(n).isEmpty()`` runs as an incremental take: a few partitions
    first, more only if needed, stopping as soon as row n+1 exists, with
    zero-width rows returned.  (``limit(n+1).count()`` would launch every
    partition of a huge table.)
    """
    return df.offset(max_rows).isEmpty()


def byte_bound_holds(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True iff the values of ``df`` (few rows, see ``row_bound_holds``) fit in ``max_bytes``."""
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if not texts or estimate <= min(SMALL_ESTIMATE, max_bytes):
        return True
    size = F.lit(8 * len(df.columns)).cast("long")
    for c in texts:
        size = size + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    return (df.agg(F.sum(size)).first()[0] or 0) <= max_bytes


def may_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> bool:
    return row_bound_holds(df, max_rows) and byte_bound_holds(df)


def broadcast_bounded(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Broadcast-hint ``df`` only when its rows and bytes are proven to be few."""
    return F.broadcast(df) if may_broadcast(df, max_rows) else df


def spread_left_join(
    fact: DataFrame, dim: DataFrame, fact_key: str, salt_col: str, dim_key: str = "id", spread: int = SPREAD, counted: DataFrame | None = None
) -> DataFrame:
    """Left equi-join whose hot keys are dealt over many tasks, on both sides.

    One partial aggregate counts the fact's keys.  A key with more than a
    ``spread``-th of all rows is hot, so there are fewer than ``spread``; its fact
    rows are dealt over as many salts as it has such shares, and its ``dim`` row is
    repeated once per salt.  Other keys keep one salt, null keys (which match
    nothing) are dealt over all.  The hot-key table is bounded by construction.
    ``counted`` is a frame with the fact's keys that is cheaper to count.
    """
    keys = fact if counted is None else counted
    counts = keys.where(F.col(fact_key).isNotNull()).groupBy(F.col(fact_key).alias("_hk")).agg(F.count(F.lit(1)).alias("_n"))
    total = keys.agg(F.count(F.lit(1))).scalar()
    hot = counts.where(F.col("_n") * spread > total).select("_hk", F.least(F.lit(spread), F.ceil(F.col("_n") * spread / total)).cast("int").alias("_salts"))
    hot = F.broadcast(hot)
    salts = F.when(F.col(fact_key).isNull(), F.lit(spread)).otherwise(F.coalesce("_salts", F.lit(1)))
    dealt = (
        fact.join(hot, F.col(fact_key) == F.col("_hk"), "left")
        .withColumn("_salt", F.pmod(F.xxhash64(salt_col), salts).cast("int"))
        .drop("_hk", "_salts")
    )
    many = (
        dim.withColumnRenamed(dim_key, "_dk")
        .join(hot, F.col("_dk") == F.col("_hk"), "left")
        .withColumn("_ds", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_hk", "_salts")
    )
    return dealt.join(many, (F.col(fact_key) == F.col("_dk")) & (F.col("_salt") == F.col("_ds")), "left").drop("_dk", "_salt", "_ds")


def party_lookup(fact: DataFrame, dim: DataFrame, fact_key: str, salt_col: str, counted: DataFrame | None = None) -> DataFrame:
    """Broadcast lookup of a small dimension, else a join with dealt hot keys."""
    if may_broadcast(dim, DIM_BROADCAST_ROWS):
        return left_lookup(fact, F.broadcast(dim), fact_key)
    return spread_left_join(fact, dim, fact_key, salt_col, counted=counted)


def left_lookup(
    fact: DataFrame,
    dim: DataFrame,
    fact_key: str,
    dim_key: str = "id",
    salt_col: str | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Left equi-join ``fact.fact_key = dim.dim_key`` that keeps NULL keys spread.

    ``dim`` columns other than ``dim_key`` are appended (rename them first to
    avoid clashes).  When ``salt_col`` is given, rows with a NULL key are
    joined on a salted surrogate paired with an is-null flag, which can never
    match a dimension row; the result equals a plain left join.
    """
    if broadcast_rows is not None:
        dim = broadcast_bounded(dim, broadcast_rows)
    if salt_col is None:
        return fact.join(dim.withColumnRenamed(dim_key, "_dk"), F.col(fact_key) == F.col("_dk"), "left").drop("_dk")
    salt = -1 - F.pmod(F.xxhash64(F.col(salt_col)), F.lit(NULL_SALT_BUCKETS))
    f = fact.withColumn("_lk_null", F.col(fact_key).isNull()).withColumn(
        "_lk", F.coalesce(F.col(fact_key), salt)
    )
    d = dim.withColumnRenamed(dim_key, "_dk").withColumn("_dk_null", F.lit(False))
    cond = (F.col("_lk") == F.col("_dk")) & (F.col("_lk_null") == F.col("_dk_null"))
    return f.join(d, cond, "left").drop("_lk", "_lk_null", "_dk", "_dk_null")


def semi(df: DataFrame, keys: DataFrame, on: Column | str | list) -> DataFrame:
    """EXISTS: rows of ``df`` with a partner in ``keys``."""
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: Column | str | list) -> DataFrame:
    """NOT EXISTS: rows of ``df`` without a partner in ``keys``."""
    return df.join(keys, on, "left_anti")


def split_referenced(keys: DataFrame, facts: DataFrame, key: str, fk: str) -> tuple[DataFrame, DataFrame]:
    """Split candidate ``keys`` into (referenced, unreferenced) by ``facts.fk``.

    The fact side is reduced to its distinct non-null foreign keys by a
    partial + final aggregate before the semi/anti joins, so the shuffle
    carries one row per key per map task.
    """
    refs = facts.select(F.col(fk).alias("_ref")).where(F.col("_ref").isNotNull()).distinct()
    cond = F.col(key) == F.col("_ref")
    return keys.join(refs, cond, "left_semi"), keys.join(refs, cond, "left_anti")


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)
