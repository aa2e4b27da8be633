"""Order-dependent operators on range partitions: prefix sums, carried values
and dense positions over a total order, without a one-partition window.

Narrow rows (keys and values only) are range-partitioned by the order and
written once to the shared checkpoint folder, which fixes each row's partition.
What earlier partitions contribute is one row per partition (and key), so the
second step never sees the data again in one place: a hot key spreads over as
many partitions as it fills.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillspark.operators.ids import global_positions, store_once

PART = "_part"


def ranged(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned by ``order``, with the number of its partition in
    ``_part``.  Without ``parts``, adaptive execution joins small partitions."""
    split = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return store_once(split.withColumn(PART, F.spark_partition_id()))


def running_sums(parts: DataFrame, by: str, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """``parts`` (from ``ranged`` by (by, *order)) plus, for each entry of
    ``values``, its sum over the earlier rows of the same ``by`` (exclusive)."""
    valued = parts.withColumns({f"_v_{n}": v for n, v in values.items()})
    totals = valued.groupBy(PART, by).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy(by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = totals.select(PART, by, *[F.coalesce(F.sum(f"_t_{n}").over(before), zero).alias(f"_o_{n}") for n in values])
    inside = Window.partitionBy(PART, by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = valued.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), zero) for n in values})
    both = within.join(offsets, [PART, by])
    return both.select(*parts.columns, *[(F.col(f"_o_{n}") + F.col(f"_i_{n}")).cast("long").alias(n) for n in values])


def carry_last(parts: DataFrame, order: list[str], values: list[str], is_set: Column) -> DataFrame:
    """``parts`` (from ``ranged`` by the columns ``order``) with ``values`` replaced by those
    of the last row at or before each row for which ``is_set`` holds."""
    held = parts.withColumn("_held", F.when(is_set, F.struct(*values)))
    inside = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # the last set row of each partition: found without a window over its rows
    last = held.where("_held IS NOT NULL").groupBy(PART).agg(F.max_by("_held", F.struct(*order)).alias("_last"))
    numbers = parts.select(PART).distinct().join(last, PART, "left")  # one row per partition
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = numbers.select(PART, F.last("_last", ignorenulls=True).over(before).alias("_before"))
    both = held.withColumn("_here", F.last("_held", ignorenulls=True).over(inside)).join(F.broadcast(carried), PART)
    value = F.coalesce("_here", "_before")
    rest = [c for c in parts.columns if c not in values]
    return both.select(*rest, *[value[v].alias(v) for v in values])


def next_value(parts: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``parts`` (from ``ranged`` by the columns ``order``) plus ``value`` of the following row (null for the last)."""
    inside = Window.partitionBy(PART).orderBy(*order)
    firsts = parts.groupBy(PART).agg(F.min_by(value, F.struct(*order)).alias("_first"))
    after = firsts.select(PART, F.lead("_first").over(Window.orderBy(PART)).alias("_after"))
    is_last = F.row_number().over(Window.partitionBy(PART).orderBy(*[F.col(c).desc() for c in order])) == 1
    both = parts.withColumn(out, F.lead(value).over(inside)).withColumn("_is_last", is_last).join(F.broadcast(after), PART)
    return both.select(*parts.columns, F.when(F.col("_is_last"), F.col("_after")).otherwise(F.col(out)).alias(out))


def with_position(df: DataFrame, order: list[Column], uses: list[str], key: list[str], pos_col: str = "position") -> DataFrame:
    """``df`` plus its 1-based position under ``order``, a total order over ``uses``.

    Only ``key`` (unique) and ``uses`` are sorted and stored; the position
    joins back by ``key``, so the wide rows move once, evenly, by their key.
    """
    narrow = df.select(*dict.fromkeys([*key, *uses]))
    placed = global_positions(narrow, order, pos_col).select(*[F.col(k).alias(f"_pk_{k}") for k in key], pos_col)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_pk_{k}")) for k in key])
    return df.join(placed, same).select(*[F.col(f"`{c}`") for c in df.columns], pos_col)
