"""Change batches derived from the driver's tables, to drive the mutation,
validation and ingest operators over whole tables.

* products: PROMO items repriced to 90 % (updates); sold-out items relisted
  as new products (inserts, defaults for stock, minimum and unit).
* categories: each used category's description becomes its product count
  (updates); every part brand becomes a new category (inserts).
* customers: BUILDING-segment customers get an e-mail and address
  (updates); every supplier becomes a customer (inserts).
* users: every supplier as a staff record -- existing ones updated (an empty
  password keeps the stored digest), others inserted (rejected when they
  carry no password).
* sales: every stored sale re-posted at checkout (flat header + line rows);
  the store holds sales before ``STORE_CUTOFF``; discounted sales are
  posted twice.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.functions.money import int_div
from tillspark.functions.text import digest, zero_pad
from tillspark.sources.documents import HEADER_FIELDS
from tillspark.sources.mapping import TestModel

PROMO_CATEGORY_ID = 4
STORE_CUTOFF = dt.date(1999, 1, 1)
ARCHIVE_CUTOFF = dt.date(1996, 1, 1)
RELIST_SUFFIX = " (baru)"


def campaign_rules(m: TestModel) -> DataFrame:
    """A long rule table (one rule per order): thresholds with ties, percent and
    flat values, caps, validity windows with open ends, one in ten inactive."""
    o = m.raw("orders", ["o_orderkey", "o_orderdate"])
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return o.select(
        k.alias("id"),
        F.concat(F.lit("Kampanye "), k.cast("string")).alias("name"),
        F.when(k % 2 == 0, "percent").otherwise("flat").alias("type"),
        F.when(k % 2 == 0, k % 30).otherwise((k * 37) % 9000).alias("value"),
        ((k * 7919) % 500000).alias("min_purchase"),
        F.when(k % 3 == 0, F.lit(20000).cast("long")).alias("max_discount"),
        (k % 10 != 0).alias("is_active"),
        F.when(k % 4 == 0, day).alias("start_date"),
        F.when(k % 5 == 0, F.date_add(day, 400)).alias("end_date"),
    )


def product_changes(m: TestModel) -> DataFrame:
    p = m.products
    updates = p.where(F.col("category_id") == PROMO_CATEGORY_ID).select(
        "id", "name", "category_id", "barcode", "cost",
        int_div(F.col("price") * 9 + 5, 10).alias("price"),
        "stock", "min_stock", "unit",
    )
    inserts = p.where(F.col("stock") == 0).select(
        F.lit(None).cast("long").alias("id"),
        F.concat("name", F.lit(RELIST_SUFFIX)).alias("name"),
        "category_id",
        F.concat(F.lit("R"), "barcode").alias("barcode"),
        "cost",
        "price",
        F.lit(None).cast("long").alias("stock"),
        F.lit(None).cast("long").alias("min_stock"),
        F.lit(None).cast("string").alias("unit"),
    )
    return updates.unionByName(inserts)


def category_changes(m: TestModel) -> DataFrame:
    counts = (
        m.products.where(F.col("category_id").isNotNull())
        .groupBy("category_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cats = F.broadcast(m.categories.select("id", "name"))
    updates = counts.join(cats, counts["category_id"] == cats["id"], "inner").select(
        "id", "name", F.concat(F.col("n").cast("string"), F.lit(" produk")).alias("desc")
    )
    inserts = m.raw("part", ["p_brand"]).distinct().select(
        F.lit(None).cast("long").alias("id"), F.col("p_brand").alias("name"), F.lit(None).cast("string").alias("desc")
    )
    return updates.unionByName(inserts)


def customer_changes(m: TestModel) -> DataFrame:
    c = m.raw("customer", ["c_custkey", "c_name", "c_mktsegment"]).where(F.col("c_mktsegment") == "BUILDING")
    updates = c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("08"), zero_pad("c_custkey", 10)).alias("phone"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("Segment "), F.col("c_mktsegment")).alias("address"),
    )
    s = m.raw("supplier", ["s_suppkey", "s_name"])
    inserts = s.select(
        F.lit(None).cast("long").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("09"), zero_pad("s_suppkey", 10)).alias("phone"),
        F.lit(None).cast("string").alias("email"),
        F.lit(None).cast("string").alias("address"),
    )
    return updates.unionByName(inserts)


def user_changes(m: TestModel) -> DataFrame:
    """Raw staff form rows: id (NULL = new), name, username, role, status, password.

    The balance decides: up to 5,000 an update; above, a new record, whose username
    ten suppliers share (up to 8,750) or whose username is already stored.
    """
    s = m.raw("supplier", ["s_suppkey", "s_name", "s_acctbal"])
    k, balance = F.col("s_suppkey"), F.col("s_acctbal")
    shared = (balance > 5000) & (balance <= 8750)
    no_password = (balance <= 2500) | ((balance > 5000) & (balance <= 5500))
    return s.select(
        F.when(balance <= 5000, k).alias("id"),
        F.upper("s_name").alias("name"),
        F.when(shared, F.concat(F.lit("new"), (k - k % 10).cast("string")))
        .otherwise(F.concat(F.lit("user"), k.cast("string")))
        .alias("username"),
        F.when(k == 0, "admin").otherwise("kasir").alias("role"),
        F.lit("active").alias("status"),
        F.when(no_password, F.lit("")).otherwise(F.concat(F.lit("pw-"), k.cast("string"))).alias("password"),
    )


def password_digest(password: str = "password"):
    """Digest of a supplied password; empty when none was supplied."""
    p = F.col(password)
    return F.when(F.coalesce(p, F.lit("")) == "", F.lit("")).otherwise(digest(p))


def product_form_rows(m: TestModel) -> DataFrame:
    """Product form submissions as raw text (what the client posts)."""
    p = m.products
    return p.select(
        "id",
        "name",
        F.coalesce(F.col("category_id").cast("string"), F.lit("")).alias("category_id"),
        F.col("cost").cast("string").alias("cost"),
        F.col("price").cast("string").alias("price"),
        F.col("stock").cast("string").alias("stock"),
    )


def sale_rows(m: TestModel, with_reposts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Every stored sale as received at checkout, in flat form: one header
    row per document (``doc_id``, header fields, ``n_items``) and its line
    rows.  Optionally every discounted sale is posted a second time (a new
    ``doc_id`` for the same invoice).  Money arrives as the client's floats.
    """
    from tillspark.operators.aggregates import item_counts

    tx = m.transactions
    counts = item_counts(m.tx_lines.select("tx_id"))
    money = ["subtotal", "discount_value", "discount", "total", "paid", "change"]
    headers = tx.join(counts, tx["id"] == counts["tx_id"], "left").select(
        F.col("id").cast("string").alias("doc_id"),
        *[F.col(c).cast("double").alias(c) if c in money else F.col(c) for c in HEADER_FIELDS],
        F.coalesce(F.col("items"), F.lit(0)).cast("int").alias("n_items"),
    )
    lines = m.tx_details.select(
        F.col("tx_id").cast("string").alias("doc_id"),
        "product_id",
        F.col("product_name").alias("name"),
        "qty",
        F.col("price").cast("double").alias("price"),
        F.col("subtotal").cast("double").alias("subtotal"),
    )
    if with_reposts:
        again = headers.where(F.col("discount") > 0).withColumn("doc_id", F.concat("doc_id", F.lit("#2")))
        headers = headers.unionByName(again)
    return headers, lines


def posted_bodies(m: TestModel) -> DataFrame:
    """(message_id, body): every sale as posted JSON text.  By sale number, some
    bodies are cut off (97), blank (89), an object without fields (83), hold text
    where a number belongs (71), or arrive twice (79)."""
    item = F.to_json(F.struct("product_id", F.col("product_name").alias("name"), "qty", "price", "subtotal"))
    carts = m.tx_details.select("tx_id", item.alias("item")).groupBy("tx_id").agg(
        F.expr("listagg(item, ',') WITHIN GROUP (ORDER BY item)").alias("items")  # a cart, as one document holds it
    )
    tx = m.transactions
    head = F.to_json(F.struct(*[F.col(c) for c in HEADER_FIELDS]), {"ignoreNullFields": "false"})
    whole = F.concat(F.rtrim(head, F.lit("}")), F.lit(',"items":['), F.coalesce("items", F.lit("")), F.lit("]}"))
    k = F.col("id")
    body = (
        F.when(k % 97 == 0, F.substring(whole, F.lit(1), F.length(whole) - 9))
        .when(k % 89 == 0, F.lit("  "))
        .when(k % 83 == 0, F.lit("{}"))
        .when(k % 71 == 0, F.regexp_replace(whole, '"paid":[0-9.E]+', '"paid":"lunas"'))
        .otherwise(whole)
    )
    posted = tx.join(carts, k == F.col("tx_id"), "left").select(k.alias("message_id"), body.alias("body"))
    return posted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("message_id") % 79 == 0, 2).otherwise(1)))).drop("_copy")


def accented(c: str) -> Column:
    """Every second name with marks on its vowels, every third in capitals."""
    marked = F.translate(F.col(c), "aeiou", "áèîõü")
    return F.when(F.col("id") % 2 == 0, marked).when(F.col("id") % 3 == 0, F.upper(c)).otherwise(F.col(c))


def delete_request(m: TestModel) -> dict[str, DataFrame]:
    """One request over all keyed tables, some keys unknown, two categories used."""
    unknown = m.spark.range(-3, -1).select(F.col("id").alias("key"))
    every = lambda df, n: df.where(F.col("id") % n == 0).select(F.col("id").alias("key"))
    return {
        "transactions": m.transactions.where((F.col("id") % 29 != 0) | (F.col("cashier_id") == 5)).select(F.col("id").alias("key")),
        "products": every(m.products, 3).union(unknown),
        "users": m.users.select(F.col("id").alias("key")),
        "customers": every(m.customers, 4),
        "categories": m.spark.range(2, 9, 3).select(F.col("id").alias("key")),
    }


def store(m: TestModel) -> DataFrame:
    """Sales already held by the store when the batch arrives."""
    return m.transactions.where(F.col("date") < F.lit(STORE_CUTOFF))
