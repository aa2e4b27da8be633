"""Registered queries: each key runs an operator over the whole mapped test
tables (``sources.mapping``) and carries the equivalent DuckDB SQL."""

from __future__ import annotations

from tillspark.functions.labels import CASHIER_EXPORT, CASHIER_LEDGER, WALK_IN_LEDGER, WALK_IN_VIEW
from tillspark.oracle.mapping import AS_OF_SQL, sale_list_sql, with_model
from tillspark.plans import ledger as ledger_plans
from tillspark.plans import reports
from tillspark.registry import register
from tillspark.sources.mapping import AS_OF, load_model

REPORT_PERIOD = "month"


def _bounds_sql(period: str) -> tuple[str, str]:
    from tillspark.functions.dates import period_bounds

    s, e = period_bounds(period, AS_OF)
    return f"DATE '{s.isoformat()}'", f"DATE '{e.isoformat()}'"


# --------------------------------------------------------------------------
# Scans
# --------------------------------------------------------------------------


@register("scan_products", with_model("SELECT * FROM products", ["products"]))
def scan_products(spark, sf_dir):
    from tillspark.sources.tables import scan

    return scan(load_model(spark, sf_dir).products)


# --------------------------------------------------------------------------
# R11 period report
# --------------------------------------------------------------------------

_S, _E = _bounds_sql(REPORT_PERIOD)

TOP_QTY_SQL = with_model(
    f"""
SELECT product_id, product_name, qty_sold, revenue,
       row_number() OVER (ORDER BY qty_sold DESC, revenue DESC, product_id, product_name) AS rank
FROM (SELECT d.product_id, d.product_name, CAST(SUM(d.qty) AS BIGINT) AS qty_sold,
             CAST(SUM(d.subtotal) AS BIGINT) AS revenue
      FROM tx_details d JOIN transactions t ON d.tx_id = t.id
      WHERE t.date BETWEEN {_S} AND {_E}
      GROUP BY d.product_id, d.product_name) s
ORDER BY qty_sold DESC, revenue DESC, product_id, product_name
LIMIT 5""",
    ["tx_details", "transactions"],
)


@register("top_products_qty", TOP_QTY_SQL)
def top_products_qty(spark, sf_dir):
    m = load_model(spark, sf_dir)
    return reports.top_products_qty(m.tx_details, m.transactions, REPORT_PERIOD, m.as_of)


def _view_sql(tail: str = "") -> str:
    return sale_list_sql(reports.VIEW_COLUMNS, None, WALK_IN_VIEW, tail)


@register("sales_report_view", _view_sql())
def sales_report_view(spark, sf_dir):
    m = load_model(spark, sf_dir)
    return reports.sales_report_view(m.transactions, m.users, m.customers)


def _report_rows(period):
    def fn(spark, sf_dir):
        m = load_model(spark, sf_dir)
        return reports.report_rows(m.transactions, m.users, m.customers, period, m.as_of)

    return fn


for _period in ("today", "week", "month", "all"):
    _ps, _pe = _bounds_sql(_period)
    register(f"report_{_period}", _view_sql(f"WHERE date BETWEEN {_ps} AND {_pe}"))(
        _report_rows(_period)
    )


@register(
    "report_summary",
    with_model(
        f"""
SELECT CAST(COALESCE(SUM(total), 0) AS BIGINT) AS revenue, COUNT(*) AS tx_count,
       CASE WHEN COUNT(*) > 0 THEN CAST(SUM(total) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) ELSE 0.0 END AS average
FROM transactions WHERE date BETWEEN {_S} AND {_E}""",
        ["transactions"],
    ),
)
def report_summary(spark, sf_dir):
    m = load_model(spark, sf_dir)
    return reports.report_summary(m.transactions, REPORT_PERIOD, m.as_of)


_AS, _AE = _bounds_sql("all")


@register(
    "report_daily",
    with_model(
        f"""SELECT date, CAST(SUM(total) AS BIGINT) AS total FROM transactions
WHERE date BETWEEN {_AS} AND {_AE} GROUP BY date""",
        ["transactions"],
    ),
)
def report_daily(spark, sf_dir):
    m = load_model(spark, sf_dir)
    return reports.report_daily(m.transactions, "all", m.as_of)


@register(
    "report_chart",
    with_model(
        f"""
SELECT date, total, strftime(date, '%m-%d') AS label, MAX(total) OVER () AS peak,
       CASE WHEN MAX(total) OVER () > 0
            THEN CAST(total AS DOUBLE) / CAST(MAX(total) OVER () AS DOUBLE) * 150 ELSE 0.0 END AS bar_height
FROM (SELECT date, CAST(SUM(total) AS BIGINT) AS total FROM transactions
      WHERE date BETWEEN {_AS} AND {_AE} GROUP BY date) d""",
        ["transactions"],
    ),
)
def report_chart(spark, sf_dir):
    m = load_model(spark, sf_dir)
    return reports.report_chart(m.transactions, "all", m.as_of)


@register(
    "top_products_revenue",
    with_model(
        """
SELECT product_name, qty_sold, revenue,
       row_number() OVER (ORDER BY revenue DESC, lower(rtrim(product_name)), product_name) AS rank
FROM (SELECT min(product_name) AS product_name, CAST(SUM(qty) AS BIGINT) AS qty_sold,
             CAST(SUM(subtotal) AS BIGINT) AS revenue
      FROM tx_details GROUP BY lower(rtrim(product_name))) s
ORDER BY revenue DESC, lower(rtrim(product_name)), product_name LIMIT 5""",
        ["tx_details"],
    ),
)
def top_products_revenue(spark, sf_dir):
    m = load_model(spark, sf_dir)
    return reports.top_products_revenue(m.tx_details)


@register(
    "customer_avg_basket",
    with_model(
        """
SELECT c.id AS customer_id, c.name AS customer_name,
       CAST(SUM(t.total) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS avg_basket
FROM customers c JOIN transactions t ON c.id = t.customer_id GROUP BY c.id, c.name""",
        ["customers", "transactions"],
    ),
)
def customer_avg_basket(spark, sf_dir):
    from tillspark.plans import crm

    m = load_model(spark, sf_dir)
    return crm.customer_avg_basket(m.customers, m.transactions)


# --------------------------------------------------------------------------
# R5-R7 ledger
# --------------------------------------------------------------------------

LEDGER_SEARCH = "12"
LEDGER_START = "1998-01-01"
LEDGER_PAGE = 3

_LEDGER_WHERE = f"WHERE invoice_no ILIKE '%{LEDGER_SEARCH}%' AND date BETWEEN DATE '{LEDGER_START}' AND {AS_OF_SQL}"


def _ledger_sql(tail: str = "") -> str:
    return sale_list_sql([*ledger_plans.LEDGER_COLUMNS, "items"], CASHIER_LEDGER, WALK_IN_LEDGER, tail)


def _ledger_args(m, filtered: bool):
    # Item counts read only line keys: the name-free line frame suffices.
    if filtered:
        return (m.transactions, m.users, m.customers, m.tx_lines, LEDGER_SEARCH, LEDGER_START, m.as_of)
    return (m.transactions, m.users, m.customers, m.tx_lines)


@register("ledger", _ledger_sql())
def ledger_all(spark, sf_dir):
    from tillspark.plans import ledger

    return ledger.ledger(*_ledger_args(load_model(spark, sf_dir), False))


@register("ledger_filtered", _ledger_sql(_LEDGER_WHERE))
def ledger_filtered(spark, sf_dir):
    from tillspark.plans import ledger

    return ledger.ledger(*_ledger_args(load_model(spark, sf_dir), True))


@register("ledger_page", _ledger_sql(f"ORDER BY date DESC, time DESC, id DESC LIMIT 10 OFFSET {(LEDGER_PAGE - 1) * 10}"))
def ledger_page(spark, sf_dir):
    from tillspark.plans import ledger

    m = load_model(spark, sf_dir)
    return ledger.ledger_page(m.transactions, m.users, m.customers, m.tx_lines, LEDGER_PAGE)


@register(
    "ledger_page_info",
    with_model(
        f"""SELECT COUNT(*) AS total_rows, CAST(ceil(COUNT(*) / 10.0) AS BIGINT) AS total_pages,
       CAST({LEDGER_PAGE} AS BIGINT) AS current_page FROM transactions {_LEDGER_WHERE}""",
        ["transactions"],
    ),
)
def ledger_page_info(spark, sf_dir):
    from tillspark.plans import ledger

    m = load_model(spark, sf_dir)
    return ledger.ledger_page_info(m.transactions, LEDGER_PAGE, LEDGER_SEARCH, LEDGER_START, m.as_of)


@register("sales_by_party", sale_list_sql(["invoice_no", "cashier_name", "customer_name", "total"], None, WALK_IN_VIEW))
def sales_by_party(spark, sf_dir):
    from tillspark.plans import ledger

    m = load_model(spark, sf_dir)
    return ledger.sales_by_party(m.transactions, m.users, m.customers)


def _filtered_ids(m):
    from tillspark.operators.filters import ledger_filter

    return ledger_filter(m.transactions.select("id", "invoice_no", "date"), LEDGER_SEARCH, LEDGER_START, m.as_of)


@register(
    "transaction_lines",
    with_model(
        f"""SELECT d.tx_id, d.product_id, d.product_name, d.qty AS quantity, d.price,
       CAST(d.qty AS BIGINT) * d.price AS line_total
FROM tx_details d WHERE d.tx_id IN (SELECT id FROM transactions {_LEDGER_WHERE})""",
        ["tx_details", "transactions"],
    ),
)
def transaction_lines(spark, sf_dir):
    from tillspark.plans import ledger

    m = load_model(spark, sf_dir)
    return ledger.transaction_lines(m.tx_details, _filtered_ids(m))


@register(
    "transaction_lines_named",
    with_model(
        f"""SELECT d.tx_id, d.product_id, d.qty AS quantity, d.price,
       COALESCE(NULLIF(p.name, ''), 'Produk #' || CAST(d.product_id AS VARCHAR)) AS product_name
FROM tx_details d LEFT JOIN products p ON d.product_id = p.id
WHERE d.tx_id IN (SELECT id FROM transactions {_LEDGER_WHERE})""",
        ["tx_details", "transactions", "products"],
    ),
)
def transaction_lines_named(spark, sf_dir):
    from tillspark.plans import ledger

    m = load_model(spark, sf_dir)
    return ledger.named_lines(m.tx_lines, m.products, _filtered_ids(m))


def _export_sql(with_time: bool) -> str:
    return sale_list_sql(ledger_plans.EXPORT_LEDGER_COLUMNS, CASHIER_EXPORT, WALK_IN_LEDGER, _LEDGER_WHERE, with_time)


def _export_ledger(with_time):
    def fn(spark, sf_dir):
        from tillspark.plans import ledger

        m = load_model(spark, sf_dir)
        rows = ledger.export_ledger_rows(*_ledger_args(m, True), with_time=with_time)
        return rows.select(*ledger.EXPORT_LEDGER_COLUMNS)

    return fn


register("export_ledger", _export_sql(True))(_export_ledger(True))
register("export_ledger_dateonly", _export_sql(False))(_export_ledger(False))

_REPORT_COLUMNS = [c for c in reports.VIEW_COLUMNS if c not in ("date", "time")] + ["date_text"]


@register("export_report", sale_list_sql(_REPORT_COLUMNS, None, WALK_IN_VIEW, f"WHERE date BETWEEN {_S} AND {_E}"))
def export_report(spark, sf_dir):
    from tillspark.plans import ledger

    m = load_model(spark, sf_dir)
    rows = reports.report_rows(m.transactions, m.users, m.customers, REPORT_PERIOD, m.as_of)
    return ledger.export_report_rows(rows).drop("date", "time")


# --------------------------------------------------------------------------
# R1 dashboard, R2/R3 catalogue, R10 users
# --------------------------------------------------------------------------


@register(
    "product_list",
    with_model(
        """
SELECT p.*, c.name AS category_name, COALESCE(NULLIF(c.name, ''), '-') AS category_label,
       COALESCE(NULLIF(p.barcode, ''), '-') AS barcode_label, COALESCE(NULLIF(p.unit, ''), 'pcs') AS unit_label,
       CASE WHEN p.stock > 0 THEN 'Tersedia' ELSE 'Habis' END AS availability
FROM products p LEFT JOIN categories c ON p.category_id = c.id""",
        ["products", "categories"],
    ),
)
def product_list(spark, sf_dir):
    from tillspark.plans import catalog

    m = load_model(spark, sf_dir)
    return catalog.product_list(m.products, m.categories)


@register(
    "category_counts",
    with_model(
        """
SELECT id, name, "desc", product_count,
       row_number() OVER (ORDER BY lower(name), name, id) AS ordinal
FROM (SELECT c.id, c.name, c."desc", COUNT(p.id) AS product_count
      FROM categories c LEFT JOIN products p ON c.id = p.category_id GROUP BY c.id, c.name, c."desc") s""",
        ["categories", "products"],
    ),
)
def category_counts(spark, sf_dir):
    from tillspark.plans import catalog

    m = load_model(spark, sf_dir)
    return catalog.category_counts(m.categories, m.products)


@register(
    "low_stock",
    with_model(
        """SELECT id, name, stock, min_stock FROM products WHERE stock <= min_stock
ORDER BY stock NULLS FIRST, id LIMIT 5""",
        ["products"],
    ),
)
def low_stock(spark, sf_dir):
    from tillspark.plans import catalog

    return catalog.low_stock_top(load_model(spark, sf_dir).products)


@register(
    "user_list",
    with_model(
        """
SELECT id, name, username, role, status, created_at,
       CASE WHEN role = 'admin' THEN 'Administrator' ELSE 'Kasir' END AS role_label,
       CASE WHEN status = 'active' THEN 'Aktif' ELSE 'Non-aktif' END AS status_label,
       upper(substring(name, 1, 1)) AS initial
FROM users""",
        ["users"],
    ),
)
def user_list(spark, sf_dir):
    from tillspark.plans import catalog

    return catalog.user_list(load_model(spark, sf_dir).users)


@register(
    "active_users",
    with_model(
        "SELECT id, name, username, role, status, created_at FROM users WHERE status = 'active'",
        ["users"],
    ),
)
def active_users(spark, sf_dir):
    from tillspark.plans import catalog

    return catalog.active_user_list(load_model(spark, sf_dir).users)


@register(
    "recent_sales",
    with_model(
        """
SELECT id, invoice_no, date, time, total, customer_id, who_sold AS cashier_name,
       CASE WHEN COALESCE(customer_id, 0) <> 0 THEN 'Member' ELSE 'Umum' END AS customer_type
FROM named_sales ORDER BY date DESC, time DESC, id DESC LIMIT 5""",
        ["named_sales"],
    ),
)
def recent_sales(spark, sf_dir):
    from tillspark.plans import catalog

    m = load_model(spark, sf_dir)
    return catalog.recent_sales(m.transactions, m.users)


@register(
    "dashboard_kpis",
    with_model(
        f"""
SELECT CAST(COALESCE(SUM(total), 0) AS BIGINT) AS today_revenue, COUNT(*) AS today_transactions,
       (SELECT COUNT(*) FROM products) AS total_products, (SELECT COUNT(*) FROM customers) AS total_customers
FROM transactions WHERE date = {AS_OF_SQL}""",
        ["transactions", "products", "customers"],
    ),
)
def dashboard_kpis(spark, sf_dir):
    from tillspark.plans import catalog

    m = load_model(spark, sf_dir)
    return catalog.dashboard_kpis(m.transactions, m.products, m.customers, m.as_of)


# --------------------------------------------------------------------------
# R8/R9 customers
# --------------------------------------------------------------------------

CUSTOMER_SEARCH = "12"


def _customers_sql(where: str = "") -> str:
    return with_model(
        f"""
SELECT c.id, c.name, c.phone, c.email, c.address, c.created_at,
       COALESCE(s.n, 0) AS total_transactions, CAST(COALESCE(s.spent, 0) AS BIGINT) AS total_spent
FROM customers c LEFT JOIN (SELECT customer_id, COUNT(*) AS n, SUM(total) AS spent FROM transactions
                            WHERE customer_id IS NOT NULL GROUP BY customer_id) s ON s.customer_id = c.id
{where}""",
        ["customers", "transactions"],
    )


@register("customer_totals", _customers_sql())
def customer_totals(spark, sf_dir):
    from tillspark.plans import crm

    m = load_model(spark, sf_dir)
    return crm.customer_list(m.customers, m.transactions)


@register(
    "customer_search",
    _customers_sql(f"WHERE c.name ILIKE '%{CUSTOMER_SEARCH}%' OR c.phone ILIKE '%{CUSTOMER_SEARCH}%'"),
)
def customer_search(spark, sf_dir):
    from tillspark.plans import crm

    m = load_model(spark, sf_dir)
    return crm.customer_list(m.customers, m.transactions, CUSTOMER_SEARCH)


_HISTORY_SQL = """SELECT customer_id, who_bought AS customer_name, invoice_no, date, time, total, who_sold AS cashier_name
FROM named_sales WHERE who_bought IS NOT NULL"""


@register("customer_history", with_model(_HISTORY_SQL, ["named_sales"]))
def customer_history(spark, sf_dir):
    from tillspark.plans import crm

    m = load_model(spark, sf_dir)
    return crm.customer_history(m.customers, m.transactions, m.users)


@register(
    "customer_history_doc",
    with_model(
        f"""
SELECT customer_id, invoice_no,
       CAST(to_json({{'customer': {{'id': customer_id, 'name': customer_name}},
                      'transaction': {{'invoice_no': invoice_no, 'date': date, 'time': time, 'total': total,
                                       'cashier_name': cashier_name}}}}) AS VARCHAR) AS document
FROM ({_HISTORY_SQL}) h""",
        ["named_sales"],
    ),
)
def customer_history_doc(spark, sf_dir):
    from tillspark.plans import crm

    m = load_model(spark, sf_dir)
    return crm.customer_history_doc(m.customers, m.transactions, m.users)


# --------------------------------------------------------------------------
# Inventory
# --------------------------------------------------------------------------


@register(
    "stock_status",
    with_model(
        """SELECT id, name, stock, min_stock,
       CASE WHEN stock = 0 THEN 'HABIS' WHEN stock <= min_stock THEN 'STOK MENIPIS' ELSE 'TERSEDIA' END AS status
FROM products""",
        ["products"],
    ),
)
def stock_status(spark, sf_dir):
    from tillspark.operators.inventory import refresh_status

    p = load_model(spark, sf_dir).products.select("id", "name", "stock", "min_stock", "status")
    return refresh_status(p)


@register(
    "restock",
    with_model(
        """SELECT id, name, CASE WHEN stock < min_stock THEN stock + 2 * min_stock ELSE stock END AS stock, min_stock
FROM products""",
        ["products"],
    ),
)
def restock(spark, sf_dir):
    from tillspark.operators.inventory import restock as restock_op

    return restock_op(load_model(spark, sf_dir).products.select("id", "name", "stock", "min_stock"))


@register(
    "apply_stock",
    with_model(
        """SELECT p.id, p.name, p.min_stock, CAST(COALESCE(s.units, 0) AS BIGINT) AS units_sold,
       p.stock - CAST(COALESCE(s.units, 0) AS BIGINT) AS stock
FROM products p LEFT JOIN (SELECT product_id, SUM(qty) AS units FROM tx_details GROUP BY product_id) s
  ON s.product_id = p.id""",
        ["products", "tx_details"],
    ),
)
def apply_stock(spark, sf_dir):
    from tillspark.operators.inventory import apply_stock as apply_op

    m = load_model(spark, sf_dir)
    return apply_op(m.products.select("id", "name", "stock", "min_stock"), m.tx_lines)


# --------------------------------------------------------------------------
# R4 discounts
# --------------------------------------------------------------------------


@register(
    "discount_quote",
    with_model(
        """
SELECT b.id, b.subtotal, t.rule_id, COALESCE(t.rule_type, 'flat') AS discount_type,
       COALESCE(t.rule_value, 0) AS discount_value,
       CASE WHEN t.rule_type IS NULL THEN 0.0 ELSE
            LEAST(CASE WHEN t.rule_type = 'percent' THEN
                   CASE WHEN t.max_discount > 0 AND b.subtotal * t.rule_value / 100.0 > t.max_discount
                        THEN CAST(t.max_discount AS DOUBLE) ELSE b.subtotal * t.rule_value / 100.0 END
                 ELSE CAST(t.rule_value AS DOUBLE) END, CAST(b.subtotal AS DOUBLE)) END AS discount_exact,
       CASE WHEN t.rule_type IS NULL THEN 0 ELSE
            LEAST(CASE WHEN t.rule_type = 'percent' THEN
                   CASE WHEN t.max_discount > 0 AND b.subtotal * t.rule_value > t.max_discount * 100
                        THEN t.max_discount ELSE (b.subtotal * t.rule_value + 50) // 100 END
                 ELSE t.rule_value END, b.subtotal) END AS discount_amount
FROM tx_base b LEFT JOIN rule_tiers t ON b.subtotal >= t.lo AND (t.hi IS NULL OR b.subtotal < t.hi)""",
        ["tx_base", "rule_tiers"],
    ),
)
def discount_quote(spark, sf_dir):
    from tillspark.operators.pricing import discount_quote as quote

    m = load_model(spark, sf_dir)
    q = quote(m.transactions.select("id", "subtotal"), m.discount_rules, m.as_of)
    return q.drop("total_after_discount")


@register(
    "discount_tiers",
    with_model(
        """
SELECT t.rule_id, t.rule_type, t.rule_value, t.lo, t.hi, COUNT(b.id) AS sales
FROM rule_tiers t LEFT JOIN tx_base b ON b.subtotal >= t.lo AND (t.hi IS NULL OR b.subtotal < t.hi)
GROUP BY t.rule_id, t.rule_type, t.rule_value, t.lo, t.hi""",
        ["tx_base", "rule_tiers"],
    ),
)
def discount_tiers(spark, sf_dir):
    from tillspark.operators.pricing import tier_usage

    m = load_model(spark, sf_dir)
    return tier_usage(m.transactions.select("id", "subtotal"), m.discount_rules, m.as_of)


# --------------------------------------------------------------------------
# Scalar functions over whole tables
# --------------------------------------------------------------------------


@register(
    "format_rupiah",
    with_model(
        """
SELECT id, total, 'Rp ' || replace(format('{:,}', total), ',', '.') AS total_text,
       'Rp ' || replace(format('{:,}', CAST(round(subtotal * 0.975) AS BIGINT)), ',', '.') AS member_price_text
FROM transactions""",
        ["transactions"],
    ),
)
def format_rupiah(spark, sf_dir):
    from pyspark.sql import functions as F

    from tillspark.functions.money import format_rupiah as fmt

    tx = load_model(spark, sf_dir).transactions
    return tx.select("id", "total", fmt("total").alias("total_text"),
                     fmt(F.col("subtotal") * 0.975).alias("member_price_text"))


@register(
    "parse_rupiah",
    with_model(
        """
SELECT id, total, COALESCE(TRY_CAST(regexp_replace('Rp ' || replace(format('{:,}', total), ',', '.'),
                                                   '[^0-9]', '', 'g') AS BIGINT), 0) AS parsed,
       COALESCE(TRY_CAST(regexp_replace(time, '[^0-9]', '', 'g') AS BIGINT), 0) AS time_digits
FROM transactions""",
        ["transactions"],
    ),
)
def parse_rupiah(spark, sf_dir):
    from tillspark.functions.money import format_rupiah as fmt
    from tillspark.functions.money import parse_rupiah as parse

    tx = load_model(spark, sf_dir).transactions
    return tx.select("id", "total", parse(fmt("total")).alias("parsed"), parse("time").alias("time_digits"))


@register(
    "md5_digest",
    with_model("SELECT id, invoice_no, md5(invoice_no) AS invoice_digest FROM transactions", ["transactions"]),
)
def md5_digest(spark, sf_dir):
    from tillspark.functions.text import digest

    tx = load_model(spark, sf_dir).transactions
    return tx.select("id", "invoice_no", digest("invoice_no").alias("invoice_digest"))


@register(
    "invoice_instant",
    with_model(
        """
SELECT id, millis, 'INV-' || CAST(millis AS VARCHAR) AS invoice_id, millis AS decoded_millis,
       strftime(epoch_ms(millis), '%H:%M') AS clock
FROM (SELECT id, epoch_ms(strptime(CAST(date AS VARCHAR) || ' ' || time, '%Y-%m-%d %H:%M:%S')) AS millis
      FROM transactions) s""",
        ["transactions"],
    ),
)
def invoice_instant(spark, sf_dir):
    from pyspark.sql import functions as F

    from tillspark.functions.dates import clock_time, invoice_id, invoice_millis, sale_instant_millis

    tx = load_model(spark, sf_dir).transactions
    s = tx.select("id", sale_instant_millis("date", "time").alias("millis"))
    s = s.withColumn("invoice_id", invoice_id("millis"))
    return s.select(
        "id", "millis", "invoice_id", invoice_millis(F.col("invoice_id")).alias("decoded_millis"),
        clock_time("millis").alias("clock"),
    )


@register(
    "clean_customers",
    with_model(
        """
SELECT id, trim(name, ' ' || chr(9) || chr(10) || chr(13) || chr(11)) AS name,
       trim(phone, ' ' || chr(9) || chr(10) || chr(13) || chr(11)) AS phone,
       upper(substring(trim(name, ' ' || chr(9) || chr(10) || chr(13) || chr(11)), 1, 1)) AS initial
FROM customers""",
        ["customers"],
    ),
)
def clean_customers(spark, sf_dir):
    from tillspark.functions.labels import initial
    from tillspark.functions.text import clean

    c = load_model(spark, sf_dir).customers
    return c.select("id", clean("name").alias("name"), clean("phone").alias("phone"),
                    initial(clean("name")).alias("initial"))


# --------------------------------------------------------------------------
# Mutations (M1-M9), guarded deletes, referential actions
# --------------------------------------------------------------------------

def _cmp_set(cols: list[str], cur: str = "p", new: str = "u", key: str = "id") -> str:
    return ", ".join(f"CASE WHEN {new}.{key} IS NOT NULL THEN {new}.{c} ELSE {cur}.{c} END AS {c}" for c in cols)


_PRODUCT_UPDATE_COLS = ["name", "category_id", "barcode", "cost", "price", "stock", "min_stock", "unit"]


@register(
    "upsert_products",
    with_model(
        f""",
upd AS (SELECT id, name, category_id, barcode, cost, (price * 9 + 5) // 10 AS price, stock, min_stock, unit
        FROM products WHERE category_id = 4),
ins AS (SELECT name || ' (baru)' AS name, category_id, 'R' || barcode AS barcode, cost, price
        FROM products WHERE stock = 0)
SELECT p.id, {_cmp_set(_PRODUCT_UPDATE_COLS)}, p.status FROM products p LEFT JOIN upd u ON p.id = u.id
UNION ALL
SELECT (SELECT MAX(id) FROM products) + row_number() OVER (ORDER BY barcode) AS id, name, category_id, barcode,
       cost, price, CAST(0 AS BIGINT) AS stock, CAST(5 AS BIGINT) AS min_stock, 'pcs' AS unit, 'TERSEDIA' AS status
FROM ins""",
        ["products"],
    ),
)
def upsert_products(spark, sf_dir):
    from pyspark.sql import functions as F

    from tillspark.operators.mutations import upsert
    from tillspark.schemas import DEFAULTS
    from tillspark.sources.changes import product_changes

    m = load_model(spark, sf_dir)
    return upsert(m.products, product_changes(m), "id", _PRODUCT_UPDATE_COLS, [F.col("barcode")], DEFAULTS["products"])


@register(
    "with_defaults",
    with_model(
        """SELECT name || ' (baru)' AS name, category_id, 'R' || barcode AS barcode, cost, price,
       CAST(0 AS BIGINT) AS stock, CAST(5 AS BIGINT) AS min_stock, 'pcs' AS unit, 'TERSEDIA' AS status
FROM products WHERE stock = 0""",
        ["products"],
    ),
)
def with_defaults_q(spark, sf_dir):
    from pyspark.sql import functions as F

    from tillspark.operators.mutations import is_new_key, with_defaults
    from tillspark.schemas import DEFAULTS, PRODUCTS
    from tillspark.sources.changes import product_changes

    m = load_model(spark, sf_dir)
    new = product_changes(m).where(is_new_key("id")).drop("id")
    return with_defaults(new, DEFAULTS["products"], PRODUCTS).select(
        *[F.col(c) for c in ["name", "category_id", "barcode", "cost", "price", "stock", "min_stock", "unit", "status"]]
    )


@register(
    "upsert_categories",
    with_model(
        """,
upd AS (SELECT c.id, c.name, CAST(s.n AS VARCHAR) || ' produk' AS "desc"
        FROM categories c JOIN (SELECT category_id, COUNT(*) AS n FROM products WHERE category_id IS NOT NULL
                                GROUP BY category_id) s ON s.category_id = c.id),
ins AS (SELECT DISTINCT p_brand AS name FROM part)
SELECT c.id, CASE WHEN u.id IS NOT NULL THEN u.name ELSE c.name END AS name,
       CASE WHEN u.id IS NOT NULL THEN u."desc" ELSE c."desc" END AS "desc"
FROM categories c LEFT JOIN upd u ON c.id = u.id
UNION ALL
SELECT (SELECT MAX(id) FROM categories) + row_number() OVER (ORDER BY name) AS id, name, CAST(NULL AS VARCHAR) AS "desc"
FROM ins""",
        ["categories", "products"],
    ),
)
def upsert_categories(spark, sf_dir):
    from pyspark.sql import functions as F

    from tillspark.operators.mutations import upsert
    from tillspark.sources.changes import category_changes

    m = load_model(spark, sf_dir)
    return upsert(m.categories, category_changes(m), "id", ["name", "desc"], [F.col("name")])


_CUSTOMER_UPDATE_COLS = ["name", "phone", "email", "address"]


@register(
    "upsert_customers",
    with_model(
        f""",
upd AS (SELECT c_custkey AS id, c_name AS name, printf('08%010d', c_custkey) AS phone,
               lower(c_name) || '@example.com' AS email, 'Segment ' || c_mktsegment AS address
        FROM customer WHERE c_mktsegment = 'BUILDING'),
ins AS (SELECT s_name AS name, printf('09%010d', s_suppkey) AS phone FROM supplier)
SELECT p.id, {_cmp_set(_CUSTOMER_UPDATE_COLS)}, p.created_at FROM customers p LEFT JOIN upd u ON p.id = u.id
UNION ALL
SELECT (SELECT MAX(id) FROM customers) + row_number() OVER (ORDER BY phone) AS id, name, phone,
       CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS address, {AS_OF_SQL} AS created_at
FROM ins""",
        ["customers"],
    ),
)
def upsert_customers(spark, sf_dir):
    from pyspark.sql import functions as F

    from tillspark.operators.mutations import upsert
    from tillspark.sources.changes import customer_changes

    m = load_model(spark, sf_dir)
    return upsert(
        m.customers, customer_changes(m), "id", _CUSTOMER_UPDATE_COLS, [F.col("phone")], {"created_at": m.as_of}
    )


_USER_CTES = """,
chg AS (SELECT CASE WHEN s_acctbal <= 5000 THEN s_suppkey END AS id, upper(s_name) AS name,
               CASE WHEN s_acctbal > 5000 AND s_acctbal <= 8750
                    THEN 'new' || CAST(s_suppkey - s_suppkey % 10 AS VARCHAR)
                    ELSE 'user' || CAST(s_suppkey AS VARCHAR) END AS username,
               CASE WHEN s_suppkey = 0 THEN 'admin' ELSE 'kasir' END AS role, 'active' AS status,
               CASE WHEN s_acctbal <= 2500 OR (s_acctbal > 5000 AND s_acctbal <= 5500) THEN ''
                    ELSE 'pw-' || CAST(s_suppkey AS VARCHAR) END AS password
        FROM supplier),
upd AS (SELECT * FROM chg WHERE id > 0),
news AS (SELECT *, row_number() OVER (PARTITION BY lower(username) ORDER BY id NULLS FIRST, username, name) AS nth,
                lower(username) IN (SELECT lower(username) FROM users) AS known
         FROM chg WHERE (id IS NULL OR id <= 0) AND password <> '')"""


@register(
    "upsert_users",
    with_model(
        f"""{_USER_CTES}
SELECT p.id, {_cmp_set(["name", "username"])},
       CASE WHEN u.password <> '' THEN md5(u.password) ELSE p.password_digest END AS password_digest,
       {_cmp_set(["role", "status"])}, p.created_at
FROM users p LEFT JOIN upd u ON p.id = u.id
UNION ALL
SELECT (SELECT MAX(id) FROM users) + row_number() OVER (ORDER BY username) AS id, name, username,
       md5(password) AS password_digest, role, status, {AS_OF_SQL} AS created_at
FROM news WHERE nth = 1 AND NOT known""",
        ["users"],
    ),
)
def upsert_users(spark, sf_dir):
    return _upsert_users(spark, sf_dir)[0]


@register(
    "upsert_users_rejected",
    with_model(
        f"""{_USER_CTES}
SELECT id, name, username, role, status, 'username taken' AS errors, FALSE AS accepted
FROM news WHERE nth > 1 OR known
UNION ALL
SELECT id, name, username, role, status, 'password required for new users' AS errors, FALSE AS accepted
FROM chg WHERE (id IS NULL OR id <= 0) AND password = ''""",
        ["users"],
    ),
)
def upsert_users_rejected(spark, sf_dir):
    return _upsert_users(spark, sf_dir)[1]


def _upsert_users(spark, sf_dir):
    from tillspark.plans.master_data import upsert_users as run
    from tillspark.sources.changes import user_changes

    m = load_model(spark, sf_dir)
    return run(m.users, user_changes(m), m.as_of)


def _guard_sql(table: str, cols: str, fact: str, fk: str, protected: str = "") -> str:
    prot = f"WHEN d.id IN ({protected}) THEN 'rejected: protected' " if protected else ""
    return f"""
SELECT {cols}, CASE {prot}WHEN d.id IN (SELECT {fk} FROM {fact} WHERE {fk} IS NOT NULL)
                    THEN 'rejected: referenced' ELSE 'deleted' END AS decision
FROM {table} d"""


@register(
    "guarded_delete_category",
    with_model(_guard_sql("categories", 'd.id, d.name, d."desc"', "products", "category_id"), ["categories", "products"]),
)
def guarded_delete_category(spark, sf_dir):
    from tillspark.operators.mutations import guarded_delete

    m = load_model(spark, sf_dir)
    return guarded_delete(m.categories, "id", m.products, "category_id")


@register(
    "guarded_delete_customer",
    with_model(
        _guard_sql("customers", "d.id, d.name, d.phone, d.email, d.address, d.created_at", "transactions", "customer_id"),
        ["customers", "transactions"],
    ),
)
def guarded_delete_customer(spark, sf_dir):
    from tillspark.operators.mutations import guarded_delete

    m = load_model(spark, sf_dir)
    return guarded_delete(m.customers, "id", m.transactions, "customer_id")


@register(
    "guarded_delete_user",
    with_model(
        _guard_sql("users", "d.id, d.name, d.username, d.password_digest, d.role, d.status, d.created_at",
                   "transactions", "cashier_id", "1"),
        ["users", "transactions"],
    ),
)
def guarded_delete_user(spark, sf_dir):
    from tillspark.operators.mutations import guarded_delete

    m = load_model(spark, sf_dir)
    return guarded_delete(m.users, "id", m.transactions, "cashier_id", protected=(1,))


@register(
    "guarded_delete_product",
    with_model(
        _guard_sql("products", "d.*", "tx_details", "product_id").replace("SELECT d.*, CASE", "SELECT d.*, CASE"),
        ["products", "tx_details"],
    ),
)
def guarded_delete_product(spark, sf_dir):
    from tillspark.operators.mutations import guarded_delete

    m = load_model(spark, sf_dir)
    return guarded_delete(m.products, "id", m.tx_lines, "product_id")


@register(
    "on_delete_set_null",
    with_model(
        """SELECT t.id, CASE WHEN t.customer_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
                  THEN NULL ELSE t.customer_id END AS customer_id, t.invoice_no
FROM transactions t""",
        ["transactions"],
    ),
)
def on_delete_set_null(spark, sf_dir):
    from pyspark.sql import functions as F

    from tillspark.operators.mutations import on_delete_set_null as set_null

    m = load_model(spark, sf_dir)
    gone = m.raw("customer", ["c_custkey", "c_mktsegment"]).where(F.col("c_mktsegment") == "AUTOMOBILE")
    tx = m.transactions.select("id", "customer_id", "invoice_no")
    return set_null(tx, gone.select("c_custkey"), "customer_id", salt_col="id")


@register(
    "on_delete_cascade",
    with_model(
        """SELECT * FROM tx_details WHERE tx_id NOT IN (SELECT id FROM transactions WHERE date < DATE '1996-01-01')""",
        ["tx_details", "transactions"],
    ),
)
def on_delete_cascade(spark, sf_dir):
    from pyspark.sql import functions as F

    from tillspark.operators.mutations import on_delete_cascade as cascade
    from tillspark.sources.changes import ARCHIVE_CUTOFF

    m = load_model(spark, sf_dir)
    gone = m.transactions.where(F.col("date") < F.lit(ARCHIVE_CUTOFF)).select("id")
    return cascade(m.tx_details, gone, "tx_id")


# --------------------------------------------------------------------------
# Validation and ingest
# --------------------------------------------------------------------------

_PARSE_INT = "TRY_CAST(regexp_extract({c}, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT)"
_PARSE_FLOAT = "TRY_CAST(regexp_extract({c}, '^\\s*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)', 1) AS DOUBLE)"
_TRIM = "trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(11))"


def _errors_sql(rules: list[tuple[str, str]]) -> str:
    parts = ", ".join(f"CASE WHEN {cond} THEN '{msg}' END" for cond, msg in rules)
    none = " AND ".join(f"NOT COALESCE({cond}, FALSE)" for cond, _ in rules)
    return f"concat_ws('; ', {parts}) AS errors, ({none}) AS accepted"


_PRODUCT_FORM = """form AS (SELECT id, name, COALESCE(CAST(category_id AS VARCHAR), '') AS category_id,
       CAST(cost AS VARCHAR) AS cost, CAST(price AS VARCHAR) AS price, CAST(stock AS VARCHAR) AS stock FROM products)"""


def _product_rules() -> list[tuple[str, str]]:
    cat = _PARSE_INT.format(c="category_id")
    cost, price = _PARSE_FLOAT.format(c="cost"), _PARSE_FLOAT.format(c="price")
    stock = _PARSE_INT.format(c="stock")
    return [
        (f"(name IS NULL OR {_TRIM.format(c='name')} = '')", "name required"),
        (f"({cat} IS NULL OR {cat} = 0)", "category required"),
        (f"({cost} IS NULL OR {price} IS NULL OR {stock} IS NULL)", "cost, price and stock must be numbers"),
        (f"COALESCE({price} < {cost}, FALSE)", "price below cost"),
    ]


@register(
    "validate_products",
    with_model(f""", {_PRODUCT_FORM}
SELECT id, name, category_id, cost, price, stock, {_errors_sql(_product_rules())} FROM form""", ["products"]),
)
def validate_products(spark, sf_dir):
    from tillspark.operators.quality import validate_products as check
    from tillspark.sources.changes import product_form_rows

    return check(product_form_rows(load_model(spark, sf_dir)))


@register(
    "validate_customers",
    with_model(
        f"""SELECT id, name, phone, email, address, created_at,
       {_errors_sql([(f"(name IS NULL OR {_TRIM.format(c='name')} = '')", "name required")])} FROM customers""",
        ["customers"],
    ),
)
def validate_customers(spark, sf_dir):
    from tillspark.operators.quality import validate_customers as check

    return check(load_model(spark, sf_dir).customers)


@register(
    "cart_lines",
    """SELECT printf('INV-%07d', l_orderkey) AS invoice_no, l_partkey AS product_id,
       CAST(SUM(CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS INTEGER) ELSE CAST(l_quantity AS INTEGER) END)
            AS BIGINT) AS qty
FROM lineitem GROUP BY l_orderkey, l_partkey
HAVING SUM(CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS INTEGER) ELSE CAST(l_quantity AS INTEGER) END) > 0""",
)
def cart_lines_q(spark, sf_dir):
    from pyspark.sql import functions as F

    from tillspark.functions.text import zero_pad
    from tillspark.operators.quality import cart_lines
    from tillspark.sources.tables import read_table

    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_quantity", "l_returnflag"])
    q = F.col("l_quantity").cast("int")
    events = li.select(
        F.concat(F.lit("INV-"), zero_pad("l_orderkey", 7)).alias("invoice_no"),
        F.col("l_partkey").alias("product_id"),
        F.when(F.col("l_returnflag") == "R", -q).otherwise(q).alias("qty"),
    )
    return cart_lines(events)


@register(
    "resolve_columns",
    """SELECT o_orderkey AS invoice_no, o_custkey AS customer_id, o_orderstatus, o_totalprice,
       CAST(o_orderdate AS DATE) AS date, o_orderpriority FROM orders""",
)
def resolve_columns_q(spark, sf_dir):
    from pyspark.sql import functions as F

    from tillspark.sources.drift import resolve_columns
    from tillspark.sources.tables import read_table

    spellings = {
        "invoice_no": ["invoiceNo", "invoice_number", "o_orderkey"],
        "customer_id": ["customerId", "customer_id", "o_custkey"],
        "cashier_id": ["cashierId", "cashier_id", "user_id"],
        "date": ["o_orderdate"],
    }
    df = resolve_columns(read_table(spark, sf_dir, "orders"), spellings)
    return df.withColumn("date", F.col("date").cast("date"))


_STORE_CUT = "DATE '1999-01-01'"
_INGEST_CTES = f""",
items AS (SELECT tx_id, COUNT(*) AS n_items FROM tx_details GROUP BY tx_id),
docs AS (SELECT t.*, COALESCE(i.n_items, 0) AS n_items, t.date < {_STORE_CUT} AS stored
         FROM transactions t LEFT JOIN items i ON i.tx_id = t.id),
elig AS (SELECT * FROM docs WHERE NOT stored AND n_items > 0 AND paid >= total),
cl AS (SELECT e.invoice_no, e.date, e.time, d.product_id, SUM(d.qty) AS qty
       FROM elig e JOIN tx_details d ON d.tx_id = e.id
       GROUP BY e.invoice_no, e.date, e.time, d.product_id HAVING SUM(d.qty) > 0),
carts AS (SELECT cl.invoice_no, cl.date, cl.time, bool_and(p.id IS NOT NULL) AS known,
                 list(cl.product_id ORDER BY cl.product_id) AS ps, list(cl.qty ORDER BY cl.product_id) AS qs
          FROM cl LEFT JOIN products p ON p.id = cl.product_id GROUP BY cl.invoice_no, cl.date, cl.time),
queue AS (SELECT *, row_number() OVER (ORDER BY date, time, lower(rtrim(invoice_no))) AS k FROM carts WHERE known),
shelf AS (SELECT list(COALESCE(stock, -1) ORDER BY i) AS left_over
          FROM range(0, (SELECT MAX(id) FROM products) + 1) r(i) LEFT JOIN products p ON p.id = r.i),
till AS (  -- one sale after the other; left_over[product + 1] is what the shelf still holds
  SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS invoice_no, FALSE AS fits, left_over FROM shelf
  UNION ALL
  SELECT n.k, n.invoice_no, n.fits,
         CASE WHEN n.fits THEN list_transform(n.left_over, lambda x, i: x - COALESCE(n.qs[list_position(n.ps, i - 1)], 0))
              ELSE n.left_over END
  FROM (SELECT q.k, q.invoice_no, q.ps, q.qs, t.left_over,
               list_bool_and(list_transform(q.ps, lambda p, j: t.left_over[p + 1] >= q.qs[j])) AS fits
        FROM till t JOIN queue q ON q.k = t.k + 1) n
),
chk AS (SELECT c.invoice_no, c.known, COALESCE(t.fits, FALSE) AS fits FROM carts c LEFT JOIN till t ON t.invoice_no = c.invoice_no),
decided AS (SELECT d.*, CASE WHEN d.stored THEN 'already stored'
                             WHEN d.n_items = 0 AND d.paid < d.total THEN 'empty cart; paid below total'
                             WHEN d.n_items = 0 THEN 'empty cart' WHEN d.paid < d.total THEN 'paid below total'
                             WHEN c.known IS NULL THEN 'empty cart' WHEN NOT c.known THEN 'unknown product'
                             WHEN NOT c.fits THEN 'insufficient stock' ELSE 'accepted' END AS decision
            FROM docs d LEFT JOIN chk c ON c.invoice_no = d.invoice_no)"""
_INGEST_USES = ["transactions", "tx_details", "products"]


def _ingest_sql(body: str) -> str:
    return with_model(_INGEST_CTES + "\n" + body, _INGEST_USES).replace("WITH ", "WITH RECURSIVE ", 1)


def _ingest_inputs(spark, sf_dir, with_reposts=False):
    from tillspark.sources import changes

    m = load_model(spark, sf_dir)
    headers, lines = changes.sale_rows(m, with_reposts)
    return headers, lines, changes.store(m), m.products


@register(
    "ingest_validate",
    _ingest_sql("SELECT invoice_no, CAST(1 AS BIGINT) AS copies, decision FROM decided"),
)
def ingest_validate(spark, sf_dir):
    from tillspark.plans import ingest

    return ingest.ingest_decisions(*_ingest_inputs(spark, sf_dir))


_NEW_ID = f"""(SELECT MAX(id) FROM transactions WHERE date < {_STORE_CUT}) + row_number() OVER (ORDER BY date, time, invoice_no)"""


@register(
    "ingest_headers",
    _ingest_sql(
        f"""SELECT {_NEW_ID} AS id,
       invoice_no, date, time, cashier_id, customer_id, subtotal, discount_type, discount_value, discount, total,
       paid, change, 'completed' AS status, CAST(0 AS BIGINT) AS discount_amount
FROM decided WHERE decision = 'accepted'"""
    ),
)
def ingest_headers(spark, sf_dir):
    from tillspark.plans import ingest

    return ingest.ingest_headers(*_ingest_inputs(spark, sf_dir))


@register(
    "ingest_lines",
    _ingest_sql(
        f"""SELECT a.tx_id, a.invoice_no, l.product_id, l.product_name, l.qty, l.price, l.subtotal
FROM (SELECT *, {_NEW_ID} AS tx_id FROM decided WHERE decision = 'accepted') a JOIN tx_details l ON l.tx_id = a.id"""
    ),
)
def ingest_lines(spark, sf_dir):
    from tillspark.plans import ingest

    return ingest.ingest_lines(*_ingest_inputs(spark, sf_dir))


@register(
    "ingest_stock",
    _ingest_sql(
        """SELECT p.id, CAST(s.units AS BIGINT) AS units_sold, CAST(p.stock - s.units AS BIGINT) AS stock
FROM products p JOIN (SELECT l.product_id, SUM(l.qty) AS units FROM decided a JOIN tx_details l ON l.tx_id = a.id
                      WHERE a.decision = 'accepted' GROUP BY l.product_id) s ON s.product_id = p.id"""
    ),
)
def ingest_stock(spark, sf_dir):
    from tillspark.plans import ingest

    return ingest.ingest_stock(*_ingest_inputs(spark, sf_dir))


@register(
    "ingest_dedup",
    with_model(
        f"""SELECT invoice_no, CAST(CASE WHEN discount > 0 THEN 2 ELSE 1 END AS BIGINT) AS copies,
       date < {_STORE_CUT} AS already_stored FROM transactions""",
        ["transactions"],
    ),
)
def ingest_dedup(spark, sf_dir):
    from tillspark.plans import ingest

    headers, _lines, store_tx, _ = _ingest_inputs(spark, sf_dir, with_reposts=True)
    return ingest.dedup_report(headers, store_tx)


@register(
    "basket_subtotal",
    with_model(
        """SELECT t.id, t.invoice_no, t.subtotal, CAST(COALESCE(s.lines_subtotal, 0) AS BIGINT) AS lines_subtotal,
       t.subtotal = COALESCE(s.lines_subtotal, 0) AS consistent
FROM transactions t
LEFT JOIN (SELECT tx_id, SUM(subtotal) AS lines_subtotal FROM tx_details GROUP BY tx_id) s ON s.tx_id = t.id""",
        ["transactions", "tx_details"],
    ),
)
def basket_subtotal_q(spark, sf_dir):
    from tillspark.plans.ledger import basket_check

    m = load_model(spark, sf_dir)
    return basket_check(m.transactions, m.tx_lines)


@register(
    "validate_categories",
    with_model(
        f""",
chg AS (SELECT c.id, c.name, CAST(s.n AS VARCHAR) || ' produk' AS "desc"
        FROM categories c JOIN (SELECT category_id, COUNT(*) AS n FROM products WHERE category_id IS NOT NULL
                                GROUP BY category_id) s ON s.category_id = c.id
        UNION ALL
        SELECT CAST(NULL AS BIGINT) AS id, p_brand AS name, CAST(NULL AS VARCHAR) AS "desc"
        FROM (SELECT DISTINCT p_brand FROM part) b)
SELECT id, name, "desc", {_errors_sql([(f"(name IS NULL OR {_TRIM.format(c='name')} = '')", "name required")])} FROM chg""",
        ["categories", "products"],
    ),
)
def validate_categories(spark, sf_dir):
    from tillspark.operators.quality import validate_categories as check
    from tillspark.sources.changes import category_changes

    return check(category_changes(load_model(spark, sf_dir)))
