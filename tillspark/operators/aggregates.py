"""Aggregations.

All plan as partial (map-side) + final hash aggregates, so a hot key
(a best seller, a regular customer) is pre-combined inside every task before
the shuffle and never concentrates raw rows in one reducer.  Sums of money
stay ``bigint`` (exact, order-independent); averages are ``sum / count`` of
the exact sum in double, never a running double sum.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.functions.text import ci_key
from tillspark.operators.filters import period_filter


def zero():
    """A bigint 0 literal (built lazily: needs an active session)."""
    return F.lit(0).cast("long")


def exact_avg(total: Column, count: Column) -> Column:
    """``total / count`` in double, 0 when there are no rows (A9 guard)."""
    return F.when(count > 0, total.cast("double") / count.cast("double")).otherwise(F.lit(0.0))


def revenue_summary(tx: DataFrame) -> DataFrame:
    """A1 + A2 + A9: one row (revenue, tx_count, average); empty -> 0, 0, 0."""
    agg = tx.agg(
        F.coalesce(F.sum("total"), zero()).alias("revenue"),
        F.count(F.lit(1)).alias("tx_count"),
    )
    return agg.withColumn("average", exact_avg(F.col("revenue"), F.col("tx_count")))


def row_count(df: DataFrame, alias: str = "total_rows") -> DataFrame:
    """A2: ``COUNT(*)`` as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias(alias))


def daily_revenue(tx: DataFrame) -> DataFrame:
    """A4: total per day."""
    return tx.groupBy("date").agg(F.sum("total").alias("total"))


def lines_in_period(details: DataFrame, tx: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Lines of the sales dated in [start, end].

    The header side is filtered (pushed to the scan) and cut to its id
    before the join, so only qualifying keys are shuffled/broadcast.
    """
    ids = period_filter(tx, start, end).select(F.col("id").alias("_tx"))
    return details.join(ids, F.col("tx_id") == F.col("_tx"), "inner").drop("_tx")


def product_sales(lines: DataFrame, by_name_only: bool = False) -> DataFrame:
    """A5 (key product_id, product_name) / A6 (key name, case-insensitive).

    A6 groups on ``ci_key(name)`` like the general_ci collation and shows the
    smallest spelling of the group as its name.
    """
    sums = [F.sum("qty").cast("long").alias("qty_sold"), F.sum("subtotal").alias("revenue")]
    if by_name_only:
        return (
            lines.groupBy(ci_key("product_name").alias("name_key"))
            .agg(F.min("product_name").alias("product_name"), *sums)
            .drop("name_key")
        )
    return lines.groupBy("product_id", "product_name").agg(*sums)


def customer_totals(tx: DataFrame) -> DataFrame:
    """A8 input: per-customer count and spend over sales with a customer."""
    return (
        tx.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("tx_count"), F.sum("total").alias("total_spent"))
    )


def units_sold(lines: DataFrame) -> DataFrame:
    """Units sold per product."""
    return lines.groupBy("product_id").agg(F.sum("qty").cast("long").alias("units_sold"))


def basket_subtotal(lines: DataFrame, key: str = "invoice_no") -> DataFrame:
    """A10: basket subtotal per sale."""
    return lines.groupBy(key).agg(F.sum("subtotal").alias("subtotal"))


def item_counts(details: DataFrame) -> DataFrame:
    """J8 input: number of lines per sale."""
    return details.groupBy("tx_id").agg(F.count(F.lit(1)).alias("items"))
