"""Customer roll-ups, search and purchase history.

The reference runs one count/sum statement per listed customer (N+1); here
sales are aggregated once per customer (partial + final aggregate, so a
regular customer with a huge share of sales is pre-combined per task) and
joined to the customer list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.operators.aggregates import zero, customer_totals, exact_avg
from tillspark.operators.filters import search_any
from tillspark.operators.joins import DIM_BROADCAST_ROWS, broadcast_bounded, party_lookup

CUSTOMER_COLUMNS = ["id", "name", "phone", "email", "address", "created_at"]


def customer_list(customers: DataFrame, tx: DataFrame, search_text: str | None = None) -> DataFrame:
    """Customers (optionally searched by name OR phone) with
    their number of sales and total spend (0, 0 when none)."""
    c = search_any(customers.select(*CUSTOMER_COLUMNS), ["name", "phone"], search_text)
    totals = customer_totals(tx.select("customer_id", "total"))
    j = c.join(totals, c["id"] == totals["customer_id"], "left").drop("customer_id")
    return j.select(
        *CUSTOMER_COLUMNS,
        F.coalesce("tx_count", zero()).alias("total_transactions"),
        F.coalesce("total_spent", zero()).alias("total_spent"),
    )


def customer_avg_basket(customers: DataFrame, tx: DataFrame) -> DataFrame:
    """Average sale total per customer (inner: walk-ins and
    customers without sales drop out).  Aggregate first, then join."""
    totals = customer_totals(tx.select("customer_id", "total"))
    c = customers.select(F.col("id"), F.col("name").alias("customer_name"))
    j = totals.join(c, totals["customer_id"] == c["id"], "inner")
    return j.select(
        "customer_id",
        "customer_name",
        exact_avg(F.col("total_spent"), F.col("tx_count")).alias("avg_basket"),
    )


def customer_history(customers: DataFrame, tx: DataFrame, users: DataFrame) -> DataFrame:
    """Every customer's sales with cashier name, one row per sale."""
    sales = tx.where(F.col("customer_id").isNotNull()).select(
        "customer_id", "invoice_no", "date", "time", "total", "cashier_id"
    )
    named = party_lookup(sales, users.select("id", F.col("name").alias("cashier_name")), "cashier_id", "invoice_no")
    c = broadcast_bounded(
        customers.select(F.col("id").alias("_cid"), F.col("name").alias("customer_name")), DIM_BROADCAST_ROWS
    )
    j = named.join(c, F.col("customer_id") == F.col("_cid"), "inner")
    return j.select("customer_id", "customer_name", "invoice_no", "date", "time", "total", "cashier_name")


def customer_history_doc(customers: DataFrame, tx: DataFrame, users: DataFrame) -> DataFrame:
    """The history as JSON documents, one per (customer, sale).

    A customer's history is not gathered into one array: a regular customer
    may hold a large share of all sales, and one document per sale keeps
    every task's share bounded.  NULL fields are kept as ``null``.
    """
    h = customer_history(customers, tx, users)
    doc = F.struct(
        F.struct(F.col("customer_id").alias("id"), F.col("customer_name").alias("name")).alias("customer"),
        F.struct("invoice_no", "date", "time", "total", "cashier_name").alias("transaction"),
    )
    return h.select("customer_id", "invoice_no", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))
