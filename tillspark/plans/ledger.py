"""The sales ledger (filter, item counts, paging, page info, exports).

The per-row ``(SELECT COUNT(*) FROM tx_details WHERE txId = t.id)`` becomes
a pre-aggregated count per sale + left join + ``coalesce(n, 0)`` (sales
without lines must show 0).  A page needs counts for at most ``size`` sales,
so ``ledger_page`` cuts the page first and counts only those sales' lines
(a broadcast of <= size ids filters the detail scan map-side).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.functions.dates import display_date
from tillspark.functions.labels import CASHIER_EXPORT, CASHIER_LEDGER, WALK_IN_LEDGER, product_label
from tillspark.functions.money import line_subtotal, page_count
from tillspark.functions.text import is_blank_param
from tillspark.operators.aggregates import basket_subtotal, item_counts, row_count
from tillspark.operators.filters import ledger_filter
from tillspark.operators.joins import DIM_BROADCAST_ROWS, broadcast_bounded, row_bound_holds, semi
from tillspark.operators.topk import PAGE_SIZE, RECENT_KEYS, page
from tillspark.plans.reports import VIEW_COLUMNS, with_parties

LEDGER_COLUMNS = [
    "id",
    "invoice_no",
    "date",
    "time",
    "cashier_name",
    "customer_name",
    "subtotal",
    "discount",
    "discount_type",
    "total",
    "paid",
    "change",
    "status",
]


def with_item_count(tx: DataFrame, details: DataFrame) -> DataFrame:
    """Number of lines per sale, 0 for sales without lines."""
    counts = item_counts(details.select("tx_id"))
    j = tx.join(counts, tx["id"] == counts["tx_id"], "left").drop("tx_id")
    return j.withColumn("items", F.coalesce(F.col("items"), F.lit(0).cast("long")))


def _lines_of(details: DataFrame, sales: DataFrame, search_text, start, end) -> DataFrame:
    """The lines to count: those of the filtered sales, if there is a filter.

    Few sales (counted) filter the line scan map-side, so only their lines are
    counted and shuffled; without a filter, or with many sales, all lines are
    reduced to counts first, which shuffles less than the lines themselves."""
    if is_blank_param(search_text) and start in (None, "") and end in (None, ""):
        return details
    ids = sales.select(F.col("id").alias("_sid"))
    if not row_bound_holds(ids, DIM_BROADCAST_ROWS):
        return details
    return semi(details.select("tx_id"), F.broadcast(ids), F.col("tx_id") == F.col("_sid"))


def ledger(
    tx: DataFrame,
    users: DataFrame,
    customers: DataFrame,
    details: DataFrame,
    search_text: str | None = None,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
) -> DataFrame:
    """R5 rows (unpaged): filter first, then parties, then item counts."""
    f = ledger_filter(tx, search_text, start, end)
    parties = with_parties(f, users, customers, CASHIER_LEDGER, WALK_IN_LEDGER).select(*LEDGER_COLUMNS)
    return with_item_count(parties, _lines_of(details, f, search_text, start, end))


def ledger_page(
    tx: DataFrame,
    users: DataFrame,
    customers: DataFrame,
    details: DataFrame,
    number: int,
    search_text: str | None = None,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    size: int = PAGE_SIZE,
) -> DataFrame:
    """T7 on R5: newest first (date, time, id descending)."""
    f = ledger_filter(tx, search_text, start, end)
    cut = page(f, number, RECENT_KEYS, size)
    parties = with_parties(cut, users, customers, CASHIER_LEDGER, WALK_IN_LEDGER).select(*LEDGER_COLUMNS)
    ids = F.broadcast(cut.select(F.col("id").alias("_pid")))
    page_lines = semi(details.select("tx_id"), ids, F.col("tx_id") == F.col("_pid"))
    return with_item_count(parties, page_lines)


def ledger_page_info(
    tx: DataFrame,
    number: int,
    search_text: str | None = None,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    size: int = PAGE_SIZE,
) -> DataFrame:
    """A2 + A12: total rows, pages and current page.  Counts the unjoined
    filtered headers, as the reference does (no join needed to count)."""
    n = row_count(ledger_filter(tx.select("invoice_no", "date"), search_text, start, end), "total_rows")
    return n.select(
        "total_rows",
        page_count("total_rows", size).alias("total_pages"),
        F.lit(number).cast("long").alias("current_page"),
    )


def sales_by_party(tx: DataFrame, users: DataFrame, customers: DataFrame) -> DataFrame:
    """J1 check query: invoice, cashier (NULL if none), customer (``UMUM``), total."""
    return with_parties(tx, users, customers, None, "UMUM").select(
        "invoice_no", "cashier_name", "customer_name", "total"
    )


def transaction_lines(details: DataFrame, tx_ids: DataFrame) -> DataFrame:
    """Lines of the given sales (semi join on the ids)."""
    keys = tx_ids.select(F.col("id").alias("_k"))
    lines = semi(details, keys, F.col("tx_id") == F.col("_k"))
    return lines.select(
        "tx_id",
        "product_id",
        "product_name",
        F.col("qty").alias("quantity"),
        "price",
        line_subtotal("qty", "price").alias("line_total"),
    )


def named_lines(details: DataFrame, products: DataFrame, tx_ids: DataFrame) -> DataFrame:
    """J7 + F21: lines with the product's current name, ``Produk #<id>`` when gone."""
    keys = tx_ids.select(F.col("id").alias("_k"))
    lines = semi(details.select("tx_id", "product_id", "qty", "price"), keys, F.col("tx_id") == F.col("_k"))
    p = broadcast_bounded(products.select(F.col("id").alias("_pid"), F.col("name").alias("_pname")), DIM_BROADCAST_ROWS)
    j = lines.join(p, F.col("product_id") == F.col("_pid"), "left")
    return j.select(
        "tx_id",
        "product_id",
        F.col("qty").alias("quantity"),
        "price",
        product_label("_pname", "product_id").alias("product_name"),
    )


EXPORT_LEDGER_COLUMNS = [
    "invoice_no",
    "date_text",
    "cashier_name",
    "customer_name",
    "items",
    "subtotal",
    "discount",
    "discount_type",
    "total",
    "paid",
    "change",
]
# CSV header rows of the two ledger exports and the report export.
LEDGER_CSV_HEADER = [
    "NO. TRANSAKSI",
    "TANGGAL",
    "KASIR",
    "PELANGGAN",
    "ITEMS",
    "SUBTOTAL",
    "DISKON",
    "TIPE DISKON",
    "TOTAL",
    "BAYAR",
    "KEMBALIAN",
]
LEDGER_DATEONLY_CSV_HEADER = LEDGER_CSV_HEADER[:7] + ["TIPE"] + LEDGER_CSV_HEADER[8:]
REPORT_CSV_HEADER = [
    "NO. TRANSAKSI",
    "TANGGAL",
    "KASIR",
    "PELANGGAN",
    "SUBTOTAL",
    "DISKON",
    "TOTAL",
    "BAYAR",
    "KEMBALIAN",
]


def export_ledger_rows(
    tx: DataFrame,
    users: DataFrame,
    customers: DataFrame,
    details: DataFrame,
    search_text: str | None = None,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    with_time: bool = True,
) -> DataFrame:
    """S5 / S7 rows: ``-`` for a missing cashier, ``Umum`` for walk-ins."""
    f = ledger_filter(tx, search_text, start, end)
    j = with_parties(f, users, customers, CASHIER_EXPORT, WALK_IN_LEDGER)
    j = with_item_count(j, _lines_of(details, f, search_text, start, end))
    return j.select(
        "invoice_no",
        display_date("date", "time" if with_time else None).alias("date_text"),
        "cashier_name",
        "customer_name",
        "items",
        "subtotal",
        "discount",
        "discount_type",
        "total",
        "paid",
        "change",
        "date",
        "time",
        "id",
    )


def export_report_rows(view_rows: DataFrame) -> DataFrame:
    """S6 rows from the period-filtered report view (``VIEW_COLUMNS``)."""
    assert set(VIEW_COLUMNS) <= set(view_rows.columns)
    return view_rows.select(
        "invoice_no",
        display_date("date", "time").alias("date_text"),
        "cashier_name",
        "customer_name",
        "subtotal",
        "discount",
        "total",
        "paid",
        "change",
        "date",
        "time",
    )


def basket_check(tx: DataFrame, details: DataFrame) -> DataFrame:
    """A10 as a data-quality report: the stored header subtotal against the
    sum of the sale's line subtotals (0 for a sale without lines).  The
    reference trusts client totals, so the two can disagree."""
    sums = basket_subtotal(details.select("tx_id", "subtotal"), key="tx_id").withColumnRenamed(
        "subtotal", "lines_subtotal"
    )
    j = tx.select("id", "invoice_no", "subtotal").join(sums, tx["id"] == sums["tx_id"], "left").drop("tx_id")
    lines_total = F.coalesce(F.col("lines_subtotal"), F.lit(0).cast("long"))
    return j.select(
        "id", "invoice_no", "subtotal", lines_total.alias("lines_subtotal"),
        (F.col("subtotal") == lines_total).alias("consistent"),
    )
