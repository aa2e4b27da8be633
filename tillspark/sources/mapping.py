"""Driver test tables -> the retail model (FIXTURES.md section 3).

The same expressions are written in DuckDB SQL in ``tillspark.oracle.mapping``
so that both engines see the same model rows.  ``as_of`` = 2001-07-19; the
data runs to 2001-08-01, so later sales exercise the future cut-off.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark import schemas
from tillspark.functions.money import change_due, int_div, round_double
from tillspark.functions.text import digest, zero_pad
from tillspark.operators.pricing import TIER_SCHEMA, quote_columns
from tillspark.sources.tables import literal_table, read_table

AS_OF = dt.date(2001, 7, 19)

# The categories are the part-type words of the test tables.
CATEGORY_ROWS = [
    (1, "ECONOMY", None),
    (2, "LARGE", None),
    (3, "MEDIUM", None),
    (4, "PROMO", None),
    (5, "SMALL", None),
    (6, "STANDARD", None),
    (7, "EMPTY", None),
]
# The discount rules, which must equal the seed's for the golden answers.
RULE_ROWS = [
    (1, "Belanja 100rb", "percent", 5, 100000, None, True, None, None),
    (2, "Belanja 200rb", "percent", 10, 200000, None, True, None, None),
    (3, "Potongan 10rb", "flat", 10000, 50000, None, True, None, None),
    (4, "Potongan 25rb", "flat", 25000, 100000, None, True, None, None),
]

CASHIER_MODULUS = 8  # cashier_id = orderkey % 8, and -1, which has no user row, instead of 7
WALK_IN_MODULUS = 5  # customer_id NULL when custkey % 5 = 0
UNCATEGORISED_MODULUS = 11  # category_id NULL when partkey % 11 = 0
PAID_STEP = 50000  # tendered cash rounded up to this step


def _constant_tiers(as_of: dt.date) -> list[tuple]:
    """The tiers of ``RULE_ROWS``: a constant of this mapping like the rows themselves
    (``rule_tiers`` evaluates rule tables that are data)."""
    best: dict[int, tuple] = {}
    for rule in sorted(RULE_ROWS, reverse=True):
        key, _name, kind, value, threshold, cap, active, start, end = rule
        if active and (start or as_of) <= as_of <= (end or as_of):
            best[threshold] = (key, kind, value, cap)
    edges = sorted(best)
    return [(*best[lo], lo, hi) for lo, hi in zip(edges, [*edges[1:], None])]


@dataclass
class TestModel:
    spark: SparkSession
    sf_dir: str
    as_of: dt.date = AS_OF

    def raw(self, name: str, columns: list[str]) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name, columns)

    @cached_property
    def categories(self) -> DataFrame:
        return literal_table(self.spark, CATEGORY_ROWS, schemas.CATEGORIES)

    @cached_property
    def discount_rules(self) -> DataFrame:
        return literal_table(self.spark, RULE_ROWS, schemas.DISCOUNT_RULES)

    @property
    def tiers(self) -> DataFrame:
        """Discount tiers valid on ``as_of``."""
        return literal_table(self.spark, _constant_tiers(self.as_of), TIER_SCHEMA)

    def _tier_columns(self, amount: Column) -> dict[str, Column]:
        """The columns of the tier (of ``_constant_tiers``) that holds ``amount``, null where none does."""
        out = {}
        for field in TIER_SCHEMA.fields[:-2]:
            value = F.lit(None).cast(field.dataType)
            for tier in _constant_tiers(self.as_of):
                row = dict(zip(TIER_SCHEMA.fieldNames(), tier))
                inside = amount >= row["lo"] if row["hi"] is None else (amount >= row["lo"]) & (amount < row["hi"])
                value = F.when(inside, F.lit(row[field.name]).cast(field.dataType)).otherwise(value)
            out[field.name] = value
        return out

    @property
    def users(self) -> DataFrame:
        s = self.raw("supplier", ["s_suppkey", "s_name"])
        k = F.col("s_suppkey")
        return s.select(
            k.alias("id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("user"), k.cast("string")).alias("username"),
            digest(F.concat(F.lit("pw"), k.cast("string"))).alias("password_digest"),
            F.when(k == 0, "admin").otherwise("kasir").alias("role"),
            F.when(k % 3 == 2, "inactive").otherwise("active").alias("status"),
            F.lit(None).cast("date").alias("created_at"),
        )

    @property
    def customers(self) -> DataFrame:
        c = self.raw("customer", ["c_custkey", "c_name"])
        k = F.col("c_custkey")
        return c.select(
            k.alias("id"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("08"), zero_pad(k, 10)).alias("phone"),
            F.lit(None).cast("string").alias("email"),
            F.lit(None).cast("string").alias("address"),
            F.lit(None).cast("date").alias("created_at"),
        )

    @property
    def products(self) -> DataFrame:
        p = self.raw("part", ["p_partkey", "p_name", "p_type", "p_size", "p_retailprice"])
        cats = F.broadcast(self.categories.select(F.col("id").alias("_cid"), F.col("name").alias("_cname")))
        k, size, rp = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
        j = p.join(cats, F.col("p_type") == F.col("_cname"), "left")
        return j.select(
            k.alias("id"),
            F.col("p_name").alias("name"),
            F.when(k % UNCATEGORISED_MODULUS == 0, F.lit(None)).otherwise(F.col("_cid")).alias("category_id"),
            F.concat(F.lit("899"), zero_pad(k, 10)).alias("barcode"),
            F.floor(rp * 0.8).cast("long").alias("cost"),
            round_double(rp).alias("price"),
            ((k * 7 + size) % 40).cast("long").alias("stock"),
            (5 + size % 10).cast("long").alias("min_stock"),
            F.lit("pcs").alias("unit"),
            F.lit("TERSEDIA").alias("status"),
        )

    @property
    def transactions(self) -> DataFrame:
        o = self.raw("orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])
        k = F.col("o_orderkey")
        base = o.select(
            k.alias("id"),
            F.concat(F.lit("INV-"), zero_pad(k, 7)).alias("invoice_no"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.concat(zero_pad((k * 7) % 24, 2), F.lit(":"), zero_pad((k * 13) % 60, 2), F.lit(":00")).alias("time"),
            F.when(k % CASHIER_MODULUS == CASHIER_MODULUS - 1, F.lit(-1).cast("long"))
            .otherwise(k % CASHIER_MODULUS)
            .alias("cashier_id"),
            F.when(F.col("o_custkey") % WALK_IN_MODULUS == 0, F.lit(None))
            .otherwise(F.col("o_custkey"))
            .alias("customer_id"),
            round_double("o_totalprice").alias("subtotal"),
        )
        # constant tiers are constants of the row's expression: no join, and nothing of it where no discount is read
        quoted = base.withColumns(self._tier_columns(F.col("subtotal"))).select(*base.columns, *quote_columns("subtotal"))
        total = F.col("subtotal") - F.col("discount_amount")
        paid = int_div(total + (PAID_STEP - 1), PAID_STEP) * PAID_STEP
        return quoted.select(
            "id",
            "invoice_no",
            "date",
            "time",
            "cashier_id",
            "customer_id",
            "subtotal",
            F.col("discount_amount").alias("discount"),
            total.alias("total"),
            paid.alias("paid"),
            change_due(paid, total).alias("change"),
            F.lit("completed").alias("status"),
            "discount_type",
            "discount_value",
            "discount_amount",
        )

    @property
    def tx_lines(self) -> DataFrame:
        """Sale lines without the product-name snapshot: lineitem alone.

        Every line's product exists (foreign key, RESTRICT on delete), so the
        join that fetches the name drops no line; operators that never read
        the name use this frame and skip a lineitem-sized join.
        """
        li = self.raw("lineitem", ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"])
        qty = F.col("l_quantity").cast("int")
        price = round_double(F.col("l_extendedprice") / F.col("l_quantity"))
        return li.select(
            F.col("l_orderkey").alias("tx_id"),
            F.col("l_partkey").alias("product_id"),
            qty.alias("qty"),
            price.alias("price"),
            (qty.cast("long") * price).alias("subtotal"),
        )

    @property
    def tx_details(self) -> DataFrame:
        """Sale lines with the product name as snapshotted at sale time."""
        p = self.raw("part", ["p_partkey", "p_name"])
        j = self.tx_lines.join(p, F.col("product_id") == F.col("p_partkey"), "inner")
        return j.select("tx_id", "product_id", F.col("p_name").alias("product_name"), "qty", "price", "subtotal")

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)


def load_model(spark: SparkSession, sf_dir: str, as_of: dt.date = AS_OF) -> TestModel:
    return TestModel(spark, sf_dir, as_of)
