"""Batch ingestion of sales.

Input is flat: one header row per received document and its line rows,
linked by ``doc_id``.  Nested JSON documents (S4) are exploded once at the
source by ``split_documents``; nothing downstream gathers lines back into
arrays, so no sale is ever collected into one task.

header rows -> one document per invoice (first by date, time) ->
already-stored check -> cart checks -> stock check in sale order ->
accepted headers (new ids after the store's maximum) and lines.

The reference inserts line by line without a transaction, so a failure
leaves partial data; here every output derives from one input batch and a
sale is accepted whole or not at all.

Stock rule in batch form (``operators.admission``): the outcome equals ringing
the sales up one by one in (date, time, invoice) order.  A sale is accepted
whole if every product is in stock after the sales accepted before it; sales
that fail any rule take nothing.

``decide`` computes the decision frame once (in the shared folder); all four
outputs -- decisions, header rows, line rows with their ``tx_id`` and the stock
taken per product -- derive from it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tillspark.functions.money import round_double, round_money
from tillspark.functions.text import ci_key
from tillspark.operators.admission import admit_sales
from tillspark.operators.aggregates import units_sold
from tillspark.operators.ids import store_once
from tillspark.operators.joins import DIM_BROADCAST_ROWS, broadcast_bounded
from tillspark.operators.ordered import with_position
from tillspark.operators.quality import E_EMPTY_CART, cart_lines, validate_sales
from tillspark.sources.documents import HEADER_FIELDS

# Ingest decisions (wording of this library).
ACCEPTED = "accepted"
ALREADY_STORED = "already stored"
UNKNOWN_PRODUCT = "unknown product"
NO_STOCK = "insufficient stock"
NO_INVOICE = "invoice required"

MONEY = ["subtotal", "discount_value", "discount", "total", "paid", "change"]
LINE_FIELDS = ["product_id", "name", "qty", "price", "subtotal"]


def split_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested documents -> (header rows, line rows), both keyed by ``doc_id``.

    ``doc_id`` is the SHA-256 of the whole body, so byte-identical re-posts
    share it; they collapse to one document before its lines are exploded.
    ``n_items`` keeps the cart size for the empty-cart rule.
    """
    body = F.to_json(F.struct(*[F.col(c) for c in docs.columns]))
    d = docs.withColumn("doc_id", F.sha2(body, 256))
    headers = d.select(
        "doc_id",
        *HEADER_FIELDS,
        F.when(F.col("items").isNull(), F.lit(0)).otherwise(F.size("items")).alias("n_items"),
    )
    lines = (
        d.select("doc_id", "items")
        .dropDuplicates(["doc_id"])
        .select("doc_id", F.explode("items").alias("it"))
        .select("doc_id", *[F.col(f"it.{c}").alias(c) for c in LINE_FIELDS])
    )
    return headers, lines


def first_per_invoice(headers: DataFrame) -> DataFrame:
    """M8 within the batch: one document per case-insensitive invoice number,
    the earliest by (date, time, invoice_no, total, paid, doc_id), plus the
    number of copies received.  A document without an invoice number stands alone.

    ``row_number() = 1`` plans as a partial ``WindowGroupLimit`` before the
    shuffle, so every task forwards at most one header per invoice (a
    repeated invoice never piles up in one reducer); the copy count is a
    partial + final hash aggregate.  Both sides are unique per invoice when
    joined.
    """
    d = headers.withColumn("invoice_key", ci_key("invoice_no"))
    alone = F.when(F.col("invoice_key").isNull(), F.col("doc_id"))  # documents without an invoice number
    d = d.withColumn("_alone", alone)
    order = Window.partitionBy("invoice_key", "_alone").orderBy("date", "time", "invoice_no", "total", "paid", "doc_id")
    first = d.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == 1).drop("_rn")
    copies = d.groupBy(F.col("invoice_key").alias("_ck"), F.col("_alone").alias("_ca")).agg(F.count(F.lit(1)).alias("copies"))
    j = first.join(copies, F.col("invoice_key").eqNullSafe(F.col("_ck")) & F.col("_alone").eqNullSafe(F.col("_ca")), "inner")
    return j.select("invoice_key", "copies", *headers.columns)


def _rounded(df: DataFrame, c: str) -> Column:
    return round_double(c) if df.schema[c].dataType == DoubleType() else round_money(c)


def _stored_keys(store_tx: DataFrame, flag: str) -> DataFrame:
    return store_tx.select(ci_key("invoice_no").alias("_sk")).distinct().withColumn(flag, F.lit(True))


def decide(headers: DataFrame, lines: DataFrame, store_tx: DataFrame, products: DataFrame) -> DataFrame:
    d = first_per_invoice(headers)
    d = d.select(*[_rounded(d, c).alias(c) if c in MONEY else F.col(c) for c in d.columns])
    stored = _stored_keys(store_tx, "_stored")
    d = d.join(stored, d["invoice_key"] == stored["_sk"], "left").drop("_sk")
    # ``d`` feeds two branches (the stock check and the final decision);
    # they prune different columns, so Spark would not reuse the exchange and
    # would rescan the batch.  Read the batch once: store the winners.
    d = store_once(validate_sales(d))
    eligible = d.where(F.col("_stored").isNull() & F.col("accepted") & F.col("invoice_key").isNotNull()).select("doc_id", "invoice_key", "date", "time")

    sale_lines = lines.select("doc_id", "product_id", "qty").join(eligible, "doc_id")
    merged = cart_lines(sale_lines, ["invoice_key", "date", "time"])
    p = broadcast_bounded(
        products.select(F.col("id").alias("_pid"), F.col("stock").alias("_stock")), DIM_BROADCAST_ROWS
    )
    checked = store_once(merged.join(p, F.col("product_id") == F.col("_pid"), "left"))
    per_sale = checked.groupBy("invoice_key").agg(F.bool_and(F.col("_pid").isNotNull()).alias("_known"))
    known = checked.join(per_sale.where("_known").select("invoice_key"), "invoice_key", "left_semi")
    admitted = admit_sales(known, "invoice_key", "product_id", ["date", "time", "invoice_key"], "qty", "_stock")
    per_sale = per_sale.join(admitted.withColumnRenamed("admitted", "_fits"), "invoice_key", "left")
    d = d.join(per_sale, "invoice_key", "left")
    decision = (
        F.when(F.col("invoice_key").isNull(), F.lit(NO_INVOICE))
        .when(F.col("_stored").isNotNull(), F.lit(ALREADY_STORED))
        .when(~F.col("accepted"), F.col("errors"))
        .when(F.col("_known").isNull(), F.lit(E_EMPTY_CART))
        .when(~F.col("_known"), F.lit(UNKNOWN_PRODUCT))
        .when(~F.col("_fits"), F.lit(NO_STOCK))
        .otherwise(F.lit(ACCEPTED))
    )
    return d.withColumn("decision", decision).drop("_stored", "_known", "_fits", "errors", "accepted")


def dedup_report(headers: DataFrame, store_tx: DataFrame) -> DataFrame:
    """M8: copies received per invoice and whether the store already holds it."""
    d = first_per_invoice(headers.select("doc_id", "invoice_no", "date", "time", "total", "paid"))
    stored = _stored_keys(store_tx, "already_stored")
    j = d.join(stored, d["invoice_key"] == stored["_sk"], "left")
    return j.select("invoice_no", "copies", F.coalesce("already_stored", F.lit(False)).alias("already_stored"))


class Ingested(NamedTuple):
    """The outputs of one batch, all of one decision frame."""

    decisions: DataFrame
    headers: DataFrame
    lines: DataFrame
    stock: DataFrame


def accepted_headers(decided: DataFrame, store_tx: DataFrame, last_id: int | None = None) -> DataFrame:
    """Header rows of accepted sales with ids after ``last_id`` (None: the store's maximum).

    ``discount_amount`` is 0 as in the reference insert, which omits it.
    """
    acc = decided.where(F.col("decision") == ACCEPTED)
    rows = acc.select(
        "doc_id",
        *HEADER_FIELDS,
        F.lit("completed").alias("status"),
        F.lit(0).cast("long").alias("discount_amount"),
    )
    rows = store_once(rows)  # numbering reads them three times: for the range bounds, the sort and the join
    highest = store_tx.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long"))
    start = highest.scalar() if last_id is None else F.lit(last_id).cast("long")
    order = ["date", "time", "invoice_no"]
    numbered = with_position(rows, [F.col(c) for c in order], order, ["doc_id"], "_pos")
    return numbered.withColumn("id", (start + F.col("_pos")).cast("long")).drop("_pos")


def accepted_lines(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """Line rows of the accepted headers, in the columns of ``tx_details``."""
    j = lines.join(heads.select("doc_id", F.col("id").alias("tx_id"), "invoice_no"), "doc_id")
    return j.select(
        "tx_id",
        "invoice_no",
        "product_id",
        F.col("name").alias("product_name"),
        "qty",
        _rounded(lines, "price").alias("price"),
        _rounded(lines, "subtotal").alias("subtotal"),
    )


def stock_taken(accepted: DataFrame, products: DataFrame) -> DataFrame:
    """Products whose stock the accepted lines change: taken units and new stock."""
    sold = units_sold(accepted.select("product_id", "qty"))
    j = products.select("id", "stock").join(sold, F.col("id") == F.col("product_id"))
    return j.select("id", "units_sold", (F.col("stock") - F.col("units_sold")).alias("stock"))


def ingest(
    headers: DataFrame, lines: DataFrame, store_tx: DataFrame, products: DataFrame, last_id: int | None = None
) -> Ingested:
    """M12 in one pass over one decision frame."""
    decided = store_once(decide(headers, lines, store_tx, products))
    heads = accepted_headers(decided, store_tx, last_id)
    rows = accepted_lines(heads, lines)
    return Ingested(decided.select("invoice_no", "copies", "decision"), heads.drop("doc_id"), rows, stock_taken(rows, products))


def ingest_decisions(headers: DataFrame, lines: DataFrame, store_tx: DataFrame, products: DataFrame) -> DataFrame:
    """Decision per invoice: accepted or the first failed rule."""
    return decide(headers, lines, store_tx, products).select("invoice_no", "copies", "decision")


def ingest_headers(headers: DataFrame, lines: DataFrame, store_tx: DataFrame, products: DataFrame) -> DataFrame:
    return accepted_headers(decide(headers, lines, store_tx, products), store_tx).drop("doc_id")


def ingest_lines(headers: DataFrame, lines: DataFrame, store_tx: DataFrame, products: DataFrame) -> DataFrame:
    return accepted_lines(accepted_headers(decide(headers, lines, store_tx, products), store_tx), lines)


def ingest_stock(headers: DataFrame, lines: DataFrame, store_tx: DataFrame, products: DataFrame) -> DataFrame:
    return stock_taken(ingest_lines(headers, lines, store_tx, products), products)
