"""Batch validators (Q1-Q5): the client-side form and cart checks as
column rules.  ``errors`` lists the failed rules (``'; '``-joined, empty
when none); ``accepted`` is true when nothing failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.functions.money import parse_float, parse_int
from tillspark.functions.text import clean

# Validation messages (wording of this library).
E_NAME = "name required"
E_CATEGORY = "category required"
E_NUMBER = "cost, price and stock must be numbers"
E_PRICE = "price below cost"
E_USERNAME = "username required"
E_PASSWORD = "password required for new users"
E_EMPTY_CART = "empty cart"
E_UNDERPAID = "paid below total"


def _blank(c: Column) -> Column:
    return c.isNull() | (clean(c) == "")


def with_errors(df: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """Attach ``errors`` / ``accepted`` from (failure condition, message) pairs."""
    msgs = F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in rules]))
    return df.withColumn("errors", F.concat_ws("; ", msgs)).withColumn("accepted", F.size(msgs) == 0)


def validate_products(batch: DataFrame) -> DataFrame:
    """Q1: name and category required; cost/price/stock numeric; price >= cost.

    Input columns are raw text (form fields): name, category_id, cost, price, stock.
    """
    cat = parse_int(F.col("category_id"))
    cost, price, stock = parse_float(F.col("cost")), parse_float(F.col("price")), parse_int(F.col("stock"))
    return with_errors(
        batch,
        [
            (_blank(F.col("name")), E_NAME),
            (cat.isNull() | (cat == 0), E_CATEGORY),
            (cost.isNull() | price.isNull() | stock.isNull(), E_NUMBER),
            (F.coalesce(price < cost, F.lit(False)), E_PRICE),
        ],
    )


def validate_customers(batch: DataFrame) -> DataFrame:
    """Q2: customer name required."""
    return with_errors(batch, [(_blank(F.col("name")), E_NAME)])


def validate_categories(batch: DataFrame) -> DataFrame:
    """Q2: category name required."""
    return with_errors(batch, [(_blank(F.col("name")), E_NAME)])


def validate_users(batch: DataFrame, key: str = "id") -> DataFrame:
    """Q2: name and username required; password required for new users."""
    new = F.col(key).isNull() | (F.col(key) <= 0)
    return with_errors(
        batch,
        [
            (_blank(F.col("name")), E_NAME),
            (_blank(F.col("username")), E_USERNAME),
            (new & _blank(F.col("password")), E_PASSWORD),
        ],
    )


def validate_sales(headers: DataFrame) -> DataFrame:
    """Q3: non-empty cart (``n_items`` > 0); paid >= total."""
    return with_errors(
        headers,
        [
            (F.coalesce(F.col("n_items"), F.lit(0)) <= 0, E_EMPTY_CART),
            (F.coalesce(F.col("paid") < F.col("total"), F.lit(False)), E_UNDERPAID),
        ],
    )


def cart_lines(events: DataFrame, keys: tuple[str, ...] | list[str] = ("invoice_no",)) -> DataFrame:
    """Q5: repeated adds of a product sum into one line; a total <= 0 removes it."""
    return (
        events.groupBy(*keys, "product_id")
        .agg(F.sum("qty").cast("long").alias("qty"))
        .where(F.col("qty") > 0)
    )
