"""Stock operators (M10, M11, M13), set-based forms of the two stored
procedures and of the per-line decrement at checkout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.functions.labels import stock_status
from tillspark.operators.aggregates import zero, units_sold

RESTOCK_FACTOR = 2


def refresh_status(products: DataFrame) -> DataFrame:
    """Recompute ``status`` for every product."""
    return products.withColumn("status", stock_status("stock", "min_stock"))


def restock(products: DataFrame) -> DataFrame:
    """Where stock < minimum, stock += 2 * minimum (one pass)."""
    s, m = F.col("stock"), F.col("min_stock")
    return products.withColumn("stock", F.when(s < m, s + RESTOCK_FACTOR * m).otherwise(s))


def apply_stock(products: DataFrame, lines: DataFrame) -> DataFrame:
    """Stock minus units sold (may go negative, as in the reference).

    Lines are reduced to one row per product (partial aggregate) before the
    join, so a best seller never ships its raw lines through the shuffle.
    """
    sold = units_sold(lines.select("product_id", "qty"))
    j = products.join(sold, products["id"] == sold["product_id"], "left").drop("product_id")
    return j.withColumn("units_sold", F.coalesce("units_sold", zero())).withColumn(
        "stock", F.col("stock") - F.col("units_sold")
    )
