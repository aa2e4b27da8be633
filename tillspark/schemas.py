"""Declared schemas of the retail star schema (snake_case, money as bigint).

Fact ``transactions`` (sale headers) with detail ``tx_details`` (sale lines);
dimensions ``users`` (cashiers), ``customers``, ``products`` -> ``categories``;
parameter table ``discount_rules``.  ``tx_details.product_name`` and
``.price`` are snapshots taken at sale time, so reports read them directly.
Time of day is a zero-padded ``HH:mm:ss`` string.
"""

from __future__ import annotations

from pyspark.sql import types as T

L = T.LongType()
S = T.StringType()
D = T.DateType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


CATEGORIES = T.StructType([_f("id", L, False), _f("name", S, False), _f("desc", S)])

CUSTOMERS = T.StructType(
    [
        _f("id", L, False),
        _f("name", S, False),
        _f("phone", S),
        _f("email", S),
        _f("address", S),
        _f("created_at", D),
    ]
)

DISCOUNT_RULES = T.StructType(
    [
        _f("id", L, False),
        _f("name", S, False),
        _f("type", S, False),
        _f("value", L, False),
        _f("min_purchase", L, False),
        _f("max_discount", L),
        _f("is_active", T.BooleanType(), False),
        _f("start_date", D),
        _f("end_date", D),
    ]
)

PRODUCTS = T.StructType(
    [
        _f("id", L, False),
        _f("name", S, False),
        _f("category_id", L),
        _f("barcode", S),
        _f("cost", L, False),
        _f("price", L, False),
        _f("stock", L),
        _f("min_stock", L),
        _f("unit", S),
        _f("status", S),
    ]
)

TRANSACTIONS = T.StructType(
    [
        _f("id", L, False),
        _f("invoice_no", S, False),
        _f("date", D, False),
        _f("time", S, False),
        _f("cashier_id", L, False),
        _f("customer_id", L),
        _f("subtotal", L, False),
        _f("discount", L, False),
        _f("total", L, False),
        _f("paid", L, False),
        _f("change", L, False),
        _f("status", S, False),
        _f("discount_type", S, False),
        _f("discount_value", L, False),
        _f("discount_amount", L, False),
    ]
)

TX_DETAILS = T.StructType(
    [
        _f("tx_id", L, False),
        _f("product_id", L, False),
        _f("product_name", S, False),
        _f("qty", T.IntegerType(), False),
        _f("price", L, False),
        _f("subtotal", L, False),
    ]
)

USERS = T.StructType(
    [
        _f("id", L, False),
        _f("name", S, False),
        _f("username", S, False),
        _f("password_digest", S),
        _f("role", S, False),
        _f("status", S, False),
        _f("created_at", D),
    ]
)

SALE_ITEM = T.StructType(
    [
        _f("product_id", L),
        _f("name", S),
        _f("qty", T.IntegerType()),
        _f("price", T.DoubleType()),
        _f("subtotal", T.DoubleType()),
    ]
)

# Nested sale document as posted at checkout: header fields plus items.
# Money may arrive fractional (client floats) and is rounded on ingest.
SALE_DOCUMENT = T.StructType(
    [
        _f("invoice_no", S),
        _f("date", D),
        _f("time", S),
        _f("cashier_id", L),
        _f("customer_id", L),
        _f("subtotal", T.DoubleType()),
        _f("discount_type", S),
        _f("discount_value", T.DoubleType()),
        _f("discount", T.DoubleType()),
        _f("total", T.DoubleType()),
        _f("paid", T.DoubleType()),
        _f("change", T.DoubleType()),
        _f("items", T.ArrayType(SALE_ITEM)),
    ]
)

TABLES = {
    "categories": CATEGORIES,
    "customers": CUSTOMERS,
    "discount_rules": DISCOUNT_RULES,
    "products": PRODUCTS,
    "transactions": TRANSACTIONS,
    "tx_details": TX_DETAILS,
    "users": USERS,
}

# Column defaults of the reference DDL, kept as-is.
DEFAULTS = {
    "products": {"stock": 0, "min_stock": 5, "unit": "pcs", "status": "TERSEDIA"},
    "transactions": {
        "status": "completed",
        "discount_type": "flat",
        "discount_value": 0,
        "discount_amount": 0,
    },
    "discount_rules": {"min_purchase": 0, "is_active": True},
    "users": {"status": "active"},
}
