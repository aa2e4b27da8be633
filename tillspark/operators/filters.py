"""Predicates (P4-P14).  Each returns a lazily filtered DataFrame; Catalyst
pushes the comparisons on scan columns into the Parquet reader."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.functions.text import is_blank_param, search_match
from tillspark.operators.joins import any_of


def lines_of(details: DataFrame, tx_id: int, key: str = "tx_id") -> DataFrame:
    """Key-equality filter (one sale's lines)."""
    return details.where(F.col(key) == F.lit(tx_id))


def active_users(users: DataFrame) -> DataFrame:
    """P5."""
    return users.where(F.col("status") == "active")


def _in_months(df: DataFrame, start=None, end=None) -> DataFrame:
    """The same bounds on the partition column of a month-partitioned sale table
    (``sources.export.with_month``): whole folders are pruned before any file opens."""
    if "month" not in df.columns:
        return df
    if start is not None:
        df = df.where(F.col("month") >= F.trunc(F.lit(start).cast("date"), "month"))
    return df if end is None else df.where(F.col("month") <= F.lit(end).cast("date"))


def on_date(df: DataFrame, day: dt.date, col: str = "date") -> DataFrame:
    """P6."""
    return _in_months(df.where(F.col(col) == F.lit(day)), day, day)


def date_range(df: DataFrame, start: dt.date | str | None = None, end: dt.date | str | None = None, col: str = "date") -> DataFrame:
    """Optional, inclusive bounds; an empty bound applies no filter."""
    if start not in (None, ""):
        df = _in_months(df.where(F.col(col) >= F.lit(start).cast("date")), start=start)
    if end not in (None, ""):
        df = _in_months(df.where(F.col(col) <= F.lit(end).cast("date")), end=end)
    return df


def period_filter(df: DataFrame, start: dt.date, end: dt.date, col: str = "date") -> DataFrame:
    """P8:``BETWEEN start AND end``."""
    return _in_months(df.where(F.col(col).between(F.lit(start), F.lit(end))), start, end)


def search(df: DataFrame, col: str, text: str | None) -> DataFrame:
    """P10: substring search; blank (incl. ``"0"``) means no filter."""
    return df if is_blank_param(text) else df.where(search_match(col, text))


def search_any(df: DataFrame, cols: list[str], text: str | None) -> DataFrame:
    """Substring search over several columns, OR-ed."""
    if is_blank_param(text):
        return df
    return df.where(any_of([search_match(c, text) for c in cols]))


def low_stock(products: DataFrame, strict: bool = False) -> DataFrame:
    """Stock at (``<=``) or strictly below (``<``) its minimum."""
    cond: Column = F.col("stock") < F.col("min_stock") if strict else F.col("stock") <= F.col("min_stock")
    return products.where(cond)


def ledger_filter(
    tx: DataFrame,
    search_text: str | None = None,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
) -> DataFrame:
    """The ledger's optional filters assembled on a lazy frame."""
    return date_range(search(tx, "invoice_no", search_text), start, end)
