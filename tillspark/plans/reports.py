"""The period sales report and its parts.

One filtered header frame feeds the rows, the summary and the daily
series; only bounded results (top 5, one row per day) are small enough to
show.  The full row list is written, never collected.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillspark.functions.dates import axis_label, period_bounds
from tillspark.functions.labels import WALK_IN_VIEW, label_or
from tillspark.functions.text import ci_key
from tillspark.operators.aggregates import daily_revenue, lines_in_period, product_sales, revenue_summary
from tillspark.operators.filters import period_filter
from tillspark.operators.joins import party_lookup
from tillspark.operators.topk import TOP_K, top_k

CHART_HEIGHT = 150


def with_parties(
    tx: DataFrame,
    users: DataFrame,
    customers: DataFrame,
    cashier_label: str | None = None,
    customer_label: str | None = None,
) -> DataFrame:
    """Sale headers + cashier name + customer name (both left joins).

    Staff and customers are broadcast after checked bounds; beyond them the join
    is shuffled, with hot cashiers, regular customers and walk-ins (NULL) dealt
    over many tasks by counts.
    """
    j = party_lookup(tx, users.select("id", F.col("name").alias("cashier_name")), "cashier_id", "id")
    j = party_lookup(j, customers.select("id", F.col("name").alias("customer_name")), "customer_id", "id", counted=tx)
    if cashier_label is not None:
        j = j.withColumn("cashier_name", label_or("cashier_name", cashier_label))
    if customer_label is not None:
        j = j.withColumn("customer_name", label_or("customer_name", customer_label))
    return j


VIEW_COLUMNS = [
    "invoice_no",
    "date",
    "time",
    "cashier_name",
    "customer_name",
    "subtotal",
    "discount",
    "total",
    "paid",
    "change",
]


def sales_report_view(tx: DataFrame, users: DataFrame, customers: DataFrame) -> DataFrame:
    """Header + cashier (NULL when missing) + customer (``UMUM`` when none)."""
    return with_parties(tx, users, customers, None, WALK_IN_VIEW).select(*VIEW_COLUMNS)


def report_rows(
    tx: DataFrame, users: DataFrame, customers: DataFrame, period: str | None, as_of: dt.date
) -> DataFrame:
    """R11 rows: the view filtered to the period (the filter runs before the joins)."""
    start, end = period_bounds(period, as_of)
    return sales_report_view(period_filter(tx, start, end), users, customers)


def report_summary(tx: DataFrame, period: str | None, as_of: dt.date) -> DataFrame:
    """Revenue, count and zero-guarded average of the period."""
    start, end = period_bounds(period, as_of)
    return revenue_summary(period_filter(tx, start, end).select("total"))


def report_daily(tx: DataFrame, period: str | None, as_of: dt.date) -> DataFrame:
    """A4: total per day in the period."""
    start, end = period_bounds(period, as_of)
    return daily_revenue(period_filter(tx, start, end).select("date", "total"))


def scale_to_max(daily: DataFrame, height: int = CHART_HEIGHT) -> DataFrame:
    """W3 + A11 + F11: bar height ``total / max * height`` (0 if max is 0).

    Runs over the aggregated series (one row per day), which is bounded by
    the calendar, so the unpartitioned max window is small.
    """
    peak = F.max("total").over(Window.partitionBy())
    return daily.select(
        "date",
        "total",
        axis_label("date").alias("label"),
        peak.alias("peak"),
        F.when(peak > 0, F.col("total").cast("double") / peak.cast("double") * height)
        .otherwise(F.lit(0.0))
        .alias("bar_height"),
    )


def report_chart(tx: DataFrame, period: str | None, as_of: dt.date) -> DataFrame:
    return scale_to_max(report_daily(tx, period, as_of))


def top_products_qty(
    details: DataFrame, tx: DataFrame, period: str | None, as_of: dt.date, k: int = TOP_K
) -> DataFrame:
    """A5 + J5 + T3 + W1: best sellers of the period by quantity, ranked."""
    start, end = period_bounds(period, as_of)
    lines = lines_in_period(details.select("tx_id", "product_id", "product_name", "qty", "subtotal"), tx, start, end)
    order = [
        F.col("qty_sold").desc(),
        F.col("revenue").desc(),
        F.col("product_id").asc(),
        F.col("product_name").asc(),
    ]
    return top_k(product_sales(lines), order, k, rank_col="rank")


def top_products_revenue(details: DataFrame, k: int = TOP_K) -> DataFrame:
    """A6 + T4: all-time best sellers by revenue, grouped by name only."""
    sales = product_sales(details.select("product_name", "qty", "subtotal"), by_name_only=True)
    order = [F.col("revenue").desc(), ci_key("product_name").asc(), F.col("product_name").asc()]
    return top_k(sales, order, k, rank_col="rank")


def sales_report(
    tx: DataFrame,
    details: DataFrame,
    users: DataFrame,
    customers: DataFrame,
    period: str | None,
    as_of: dt.date,
) -> dict[str, DataFrame]:
    """The whole period report as lazy frames sharing one filtered
    header frame: ``rows`` (write it, do not collect), ``summary`` (one
    row), ``top_products`` (<= 5 rows) and ``chart`` (one row per day)."""
    start, end = period_bounds(period, as_of)
    in_period = period_filter(tx, start, end)
    return {
        "rows": sales_report_view(in_period, users, customers),
        "summary": revenue_summary(in_period.select("total")),
        "top_products": top_products_qty(details, tx, period, as_of),
        "chart": scale_to_max(daily_revenue(in_period.select("date", "total"))),
    }
