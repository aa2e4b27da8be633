"""Sorts, limits, top-k and paging.

Every limited sort carries a total order (the build adds the id last), so
results are deterministic.  ``orderBy(...).limit(k)`` plans as
``TakeOrderedAndProject``: each task keeps its own top k and only k rows
per task reach the final merge -- no global sort of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillspark.functions.text import fold
from tillspark.operators.joins import row_bound_holds
from tillspark.operators.ordered import with_position
from tillspark.operators.selection import from_rank

PAGE_SIZE = 10
TOP_K = 5
#: newest first, id last, as (column, descending) pairs
RECENT_KEYS = [("date", True), ("time", True), ("id", True)]
# W2 numbers up to this many rows in one partition, counted first.
ORDINAL_ROWS = 10_000


def top_k(df: DataFrame, order: list[Column], k: int = TOP_K, rank_col: str | None = None) -> DataFrame:
    """First ``k`` rows by ``order``; optionally numbered 1..k.

    The numbering window runs over the <= k rows left after the limit.
    """
    top = df.orderBy(*order).limit(k)
    if rank_col:
        top = top.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)).cast("long"))
    return top


def name_order(name: str = "name", key: str = "id") -> list[Column]:
    """T5: name order regardless of case and accents (general_ci), id as tie-break."""
    return [fold(name).asc(), F.col(name).asc(), F.col(key).asc()]


def recent_order(date: str = "date", time: str | None = "time", key: str = "id") -> list[Column]:
    """Newest first, id last."""
    cols = [F.col(date).desc()]
    if time:
        cols.append(F.col(time).desc())
    cols.append(F.col(key).desc())
    return cols


def with_ordinal(df: DataFrame, order: list[Column], uses: list[str], key: str = "id", col: str = "ordinal") -> DataFrame:
    """1-based position in ``order``, a total order over the columns ``uses``.

    A frame counted to hold few rows is numbered in one partition; any other by
    ``with_position``."""
    if row_bound_holds(df.select(key), ORDINAL_ROWS):
        return df.withColumn(col, F.row_number().over(Window.orderBy(*order)).cast("long"))
    return with_position(df, order, uses, [key], col)


def page(df: DataFrame, number: int, keys: list[tuple[str, bool]], size: int = PAGE_SIZE) -> DataFrame:
    """``LIMIT size OFFSET (number-1)*size`` under ``keys``, (column,
    descending) pairs that form a total order.

    ``from_rank`` first filters off whole ranges that lie before the page, so
    every task of the final top-k keeps a few thousand rows at any depth."""
    rest, skip = from_rank(df, keys, max(number - 1, 0) * size)
    order = [F.col(k).desc() if d else F.col(k).asc() for k, d in keys]
    return rest.orderBy(*order).offset(skip).limit(size)


def page_after(df: DataFrame, last: dict, keys: list[tuple[str, bool]], size: int = PAGE_SIZE) -> DataFrame:
    """T7, keyset form: the ``size`` rows that follow ``last`` in the order
    given by ``keys`` ((column, descending) pairs forming a total order).

    A filter on the keys plus a top-k: no offset, so any page costs the same
    (each task keeps ``size`` rows).  ``last`` holds the key values of the
    previous page's final row.
    """
    from functools import reduce

    conds = []
    for i, (col, desc) in enumerate(keys):
        c, v = F.col(col), F.lit(last[col])
        beyond = c < v if desc else c > v
        equal_prefix = [F.col(k) == F.lit(last[k]) for k, _ in keys[:i]]
        conds.append(reduce(lambda a, b: a & b, equal_prefix, beyond) if equal_prefix else beyond)
    after = reduce(lambda a, b: a | b, conds)
    order = [F.col(k).desc() if d else F.col(k).asc() for k, d in keys]
    return df.where(after).orderBy(*order).limit(size)
