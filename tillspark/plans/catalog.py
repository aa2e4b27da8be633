"""R2 / R3 / R10 and the dashboard (R1): catalogue, categories, users."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.functions.labels import (
    DEFAULT_UNIT,
    availability_label,
    blank_or,
    initial,
    member_label,
    role_label,
    status_label,
)
from tillspark.operators.aggregates import zero
from tillspark.operators.filters import active_users, low_stock, on_date
from tillspark.operators.joins import DIM_BROADCAST_ROWS, broadcast_bounded, left_lookup
from tillspark.operators.topk import TOP_K, name_order, recent_order, top_k, with_ordinal



def with_category(products: DataFrame, categories: DataFrame) -> DataFrame:
    """J2 + P1: every product column plus the category name (left join)."""
    c = broadcast_bounded(categories.select("id", F.col("name").alias("category_name")), DIM_BROADCAST_ROWS)
    return left_lookup(products, c, "category_id", salt_col="id")


def product_list(products: DataFrame, categories: DataFrame) -> DataFrame:
    """R2: products + category, display labels."""
    j = with_category(products, categories)
    return j.select(
        *products.columns,
        "category_name",
        blank_or("category_name").alias("category_label"),
        blank_or("barcode").alias("barcode_label"),
        blank_or("unit", DEFAULT_UNIT).alias("unit_label"),
        availability_label("stock").alias("availability"),
    )


def category_counts(categories: DataFrame, products: DataFrame) -> DataFrame:
    """Categories with their product count (0 when empty) and ordinal.

    Products are reduced to one count per category (partial aggregate)
    before the join, so the join sees one row per category on both sides.
    """
    counts = (
        products.where(F.col("category_id").isNotNull())
        .groupBy("category_id")
        .agg(F.count(F.lit(1)).alias("product_count"))
    )
    j = categories.join(counts, categories["id"] == counts["category_id"], "left").drop("category_id")
    j = j.withColumn("product_count", F.coalesce("product_count", zero()))
    return with_ordinal(j, name_order(), ["name", "id"])


def user_list(users: DataFrame) -> DataFrame:
    """Users without the secret column, with display labels."""
    return users.drop("password_digest").select(
        "*",
        role_label("role").alias("role_label"),
        status_label("status").alias("status_label"),
        initial("name").alias("initial"),
    )


def active_user_list(users: DataFrame) -> DataFrame:
    """P5: active accounts only, without the secret column."""
    return active_users(users).drop("password_digest")


def dashboard_kpis(tx: DataFrame, products: DataFrame, customers: DataFrame, as_of: dt.date) -> DataFrame:
    """R1 figures as one row: revenue of ``as_of``, product and customer counts.

    Three one-row aggregates combined by scalar subqueries (no join).
    """
    revenue = on_date(tx.select("date", "total"), as_of).agg(
        F.coalesce(F.sum("total"), zero()).alias("today_revenue"),
        F.count(F.lit(1)).alias("today_transactions"),
    )
    n_products = products.select("id").agg(F.count(F.lit(1))).scalar()
    n_customers = customers.select("id").agg(F.count(F.lit(1))).scalar()
    return revenue.select(
        "today_revenue",
        "today_transactions",
        n_products.alias("total_products"),
        n_customers.alias("total_customers"),
    )


def recent_sales(tx: DataFrame, users: DataFrame, n: int = TOP_K) -> DataFrame:
    """Latest ``n`` sales with cashier and Member/Umum label.

    The top-n is cut on the header table first; only n rows meet the users.
    """
    cut = top_k(tx.select("id", "invoice_no", "date", "time", "total", "customer_id", "cashier_id"), recent_order(), n)
    u = broadcast_bounded(users.select("id", F.col("name").alias("cashier_name")), DIM_BROADCAST_ROWS)
    j = left_lookup(cut, u, "cashier_id")
    return j.select(
        "id", "invoice_no", "date", "time", "total", "customer_id", "cashier_name",
        member_label("customer_id").alias("customer_type"),
    )


def low_stock_top(products: DataFrame, n: int = TOP_K) -> DataFrame:
    """The ``n`` lowest stocks among products at or below minimum."""
    low = low_stock(products.select("id", "name", "stock", "min_stock"))
    return top_k(low, [F.col("stock").asc_nulls_first(), F.col("id").asc()], n)


def dashboard(
    tx: DataFrame, products: DataFrame, customers: DataFrame, users: DataFrame, as_of: dt.date
) -> dict[str, DataFrame]:
    """The dashboard's figures, five latest sales and five lowest stocks."""
    return {
        "kpis": dashboard_kpis(tx, products, customers, as_of),
        "recent_sales": recent_sales(tx, users),
        "low_stock": low_stock_top(products),
    }
