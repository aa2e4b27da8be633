"""Registered queries beyond the base set: operators at sizes, orders and inputs
that the base queries do not reach (long rule tables, ordered lists, deep pages,
posted JSON, requested deletes, maintained summaries)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillspark.functions.labels import CASHIER_EXPORT, CASHIER_LEDGER, WALK_IN_LEDGER
from tillspark.oracle.mapping import AS_OF_SQL, sale_list_sql, with_model
from tillspark.plans import ledger as ledger_plans
from tillspark.registry import register
from tillspark.sources.mapping import load_model

# --------------------------------------------------------------------------
# P13, W4, J10, T8, F7, R4 with a long rule table
# --------------------------------------------------------------------------

_CAMPAIGNS = f""",
campaigns AS (
  SELECT o_orderkey AS id, 'Kampanye ' || CAST(o_orderkey AS VARCHAR) AS name,
         CASE WHEN o_orderkey % 2 = 0 THEN 'percent' ELSE 'flat' END AS type,
         CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 30 ELSE (o_orderkey * 37) % 9000 END AS value,
         (o_orderkey * 7919) % 500000 AS min_purchase,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(20000 AS BIGINT) END AS max_discount, o_orderkey % 10 <> 0 AS is_active,
         CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS start_date,
         CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderdate AS DATE) + 400 END AS end_date
  FROM orders),
valid AS (SELECT * FROM campaigns
          WHERE is_active AND COALESCE(start_date, {AS_OF_SQL}) <= {AS_OF_SQL} AND COALESCE(end_date, {AS_OF_SQL}) >= {AS_OF_SQL}),
best AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY min_purchase ORDER BY id) = 1)"""


def _campaigns(spark, sf_dir):
    from tillspark.sources.changes import campaign_rules

    m = load_model(spark, sf_dir)
    return m, campaign_rules(m)


@register("campaign_rules_valid", with_model(f"{_CAMPAIGNS}\nSELECT * FROM valid", ["tx_base"]))
def campaign_rules_valid(spark, sf_dir):
    from tillspark.operators.pricing import valid_rules

    m, rules = _campaigns(spark, sf_dir)
    return valid_rules(rules, m.as_of)


@register(
    "campaign_quote",
    with_model(
        f"""{_CAMPAIGNS},
quoted AS (
  SELECT b.id, b.subtotal, r.id AS rule_id, COALESCE(r.type, 'flat') AS discount_type, COALESCE(r.value, 0) AS discount_value,
         CASE WHEN r.id IS NULL THEN 0
              WHEN r.type = 'flat' THEN LEAST(r.value, b.subtotal)
              WHEN COALESCE(r.max_discount, 0) > 0 THEN LEAST(CAST(b.subtotal * r.value AS DECIMAL(18, 2)) / 100, r.max_discount)
              ELSE CAST(b.subtotal * r.value AS DECIMAL(18, 2)) / 100 END AS exact
  FROM tx_base b ASOF LEFT JOIN best r ON b.subtotal >= r.min_purchase)
SELECT id, subtotal, rule_id, discount_type, discount_value, CAST(exact AS DOUBLE) AS discount_exact,
       CAST(round(CAST(exact AS DECIMAL(18, 2))) AS BIGINT) AS discount_amount,
       CAST(round(CAST(subtotal - CAST(exact AS DECIMAL(18, 2)) AS DECIMAL(18, 2))) AS BIGINT) AS total_after_discount
FROM quoted""",
        ["tx_base"],
    ),
)
def campaign_quote(spark, sf_dir):
    from tillspark.operators.pricing import discount_quote

    m, rules = _campaigns(spark, sf_dir)
    return discount_quote(m.transactions.select("id", "subtotal"), rules, m.as_of)


@register(
    "campaign_tiers",
    with_model(
        f"""{_CAMPAIGNS},
hits AS (SELECT r.id, COUNT(*) AS sales FROM tx_base b ASOF JOIN best r ON b.subtotal >= r.min_purchase GROUP BY r.id)
SELECT t.id AS rule_id, t.type AS rule_type, t.value AS rule_value, t.min_purchase AS lo,
       lead(t.min_purchase) OVER (ORDER BY t.min_purchase) AS hi, COALESCE(h.sales, 0) AS sales
FROM best t LEFT JOIN hits h ON h.id = t.id""",
        ["tx_base"],
    ),
)
def campaign_tiers(spark, sf_dir):
    from tillspark.operators.pricing import tier_usage

    m, rules = _campaigns(spark, sf_dir)
    return tier_usage(m.transactions.select("id", "subtotal"), rules, m.as_of)


# --------------------------------------------------------------------------
# Posted JSON bodies
# --------------------------------------------------------------------------

_POSTED = """,
posted AS (
  SELECT t.*, COALESCE(i.n, 0) AS n_items, COALESCE(i.units, 0) AS units,
         CASE WHEN id % 97 = 0 THEN 'malformed' WHEN id % 89 = 0 OR id % 83 = 0 THEN 'empty' WHEN id % 71 = 0 THEN 'malformed' END AS problem
  FROM transactions t
  LEFT JOIN (SELECT tx_id, COUNT(*) AS n, SUM(qty) AS units FROM tx_details GROUP BY tx_id) i ON i.tx_id = t.id)"""


@register(
    "json_documents",
    with_model(
        f"""{_POSTED}
SELECT id AS message_id, problem, CASE WHEN problem IS NULL THEN invoice_no END AS invoice_no,
       CASE WHEN problem IS NULL THEN date END AS date, CASE WHEN problem IS NULL THEN customer_id END AS customer_id,
       CASE WHEN problem IS NULL THEN CAST(total AS DOUBLE) END AS total,
       CASE WHEN problem IS NULL THEN CAST(n_items AS INTEGER) END AS n_items,
       CASE WHEN problem IS NULL THEN CAST(units AS BIGINT) END AS units
FROM posted, range(CASE WHEN id % 79 = 0 THEN 2 ELSE 1 END)""",
        ["transactions", "tx_details"],
    ),
)
def json_documents(spark, sf_dir):
    from tillspark.sources.changes import posted_bodies
    from tillspark.sources.documents import parse_posted

    parsed = parse_posted(posted_bodies(load_model(spark, sf_dir)))
    units = F.aggregate("items", F.lit(0).cast("long"), lambda acc, i: acc + i["qty"])
    return parsed.select("message_id", "problem", "invoice_no", "date", "customer_id", "total", F.size("items").alias("n_items"), units.alias("units"))


@register(
    "json_lines",
    with_model(
        f"""{_POSTED}
SELECT p.invoice_no, d.product_id, d.product_name AS name, d.qty, CAST(d.price AS DOUBLE) AS price, CAST(d.subtotal AS DOUBLE) AS subtotal
FROM posted p JOIN tx_details d ON d.tx_id = p.id WHERE p.problem IS NULL""",
        ["transactions", "tx_details"],
    ),
)
def json_lines(spark, sf_dir):
    """Lines of the sale documents; a body that arrives twice counts once."""
    from tillspark.sources.changes import posted_bodies
    from tillspark.sources.documents import posted_lines

    return posted_lines(posted_bodies(load_model(spark, sf_dir)))


# --------------------------------------------------------------------------
# Ordered lists with their positions, deep pages
# --------------------------------------------------------------------------

_BY_NAME = "lower(name), name, id"
_NEWEST = "date DESC, time DESC, id DESC"


def _numbered(base: str, order: str, drop: str = "") -> str:
    """Oracle of a list: the list's own oracle, numbered by a plain window."""
    from tillspark import registry
    from tillspark.plans import queries  # noqa: F401 -- registers the lists

    return f"SELECT * {drop}, row_number() OVER (ORDER BY {order}) AS position FROM ({registry.ORACLE[base]}) list"


def _list(base: str, order, uses: list[str], key: str):
    """``order`` is a function: columns exist only once there is a session."""

    def fn(spark, sf_dir):
        from tillspark import registry
        from tillspark.operators.ordered import with_position

        return with_position(registry.QUERIES[base](spark, sf_dir), order(), uses, [key])

    return fn


def _register_lists() -> None:
    from tillspark.operators.topk import name_order, recent_order

    for base in ("product_list", "customer_totals", "user_list"):
        register(f"{base}_ordered", _numbered(base, _BY_NAME))(_list(base, name_order, ["name", "id"], "id"))
    register("ledger_ordered", _numbered("ledger", _NEWEST))(_list("ledger", recent_order, ["date", "time", "id"], "id"))
    invoices = lambda: recent_order(key="invoice_no")
    uses = ["date", "time", "invoice_no"]
    register("report_rows_ordered", _numbered("report_month", "date DESC, time DESC, invoice_no DESC"))(
        _list("report_month", invoices, uses, "invoice_no")
    )
    register("customer_history_ordered", _numbered("customer_history", "customer_id, date DESC, time DESC, invoice_no DESC"))(
        _list("customer_history", lambda: [F.col("customer_id"), *invoices()], ["customer_id", *uses], "invoice_no")
    )


_register_lists()


@register(
    "export_ledger_ordered",
    sale_list_sql([*ledger_plans.EXPORT_LEDGER_COLUMNS, f"row_number() OVER (ORDER BY {_NEWEST}) AS position"], CASHIER_EXPORT, WALK_IN_LEDGER),
)
def export_ledger_ordered(spark, sf_dir):
    """S5 rows with the line number they have in the ordered CSV."""
    from tillspark.operators.ordered import with_position
    from tillspark.operators.topk import recent_order
    from tillspark.plans import ledger

    m = load_model(spark, sf_dir)
    rows = ledger.export_ledger_rows(m.transactions, m.users, m.customers, m.tx_lines)
    return with_position(rows, recent_order(), ["date", "time", "id"], ["id"]).select(*ledger.EXPORT_LEDGER_COLUMNS, "position")

DEEP_PAGE = 1200
_LEDGER = sale_list_sql([*ledger_plans.LEDGER_COLUMNS, "items"], CASHIER_LEDGER, WALK_IN_LEDGER)


@register("ledger_deep_page", _LEDGER + f" ORDER BY {_NEWEST} LIMIT 10 OFFSET {(DEEP_PAGE - 1) * 10}")
def ledger_deep_page(spark, sf_dir):
    from tillspark.plans import ledger

    m = load_model(spark, sf_dir)
    return ledger.ledger_page(m.transactions, m.users, m.customers, m.tx_lines, DEEP_PAGE)


# --------------------------------------------------------------------------
# Text compared without case and accents
# --------------------------------------------------------------------------


def _accented_sql(col: str, key: str = "id") -> str:
    return (
        f"CASE WHEN {key} % 2 = 0 THEN translate({col}, 'aeiou', 'áèîõü') WHEN {key} % 3 = 0 THEN upper({col}) ELSE {col} END"
    )


@register(
    "accent_search",
    with_model(
        f""",
named AS (SELECT id, {_accented_sql("name")} AS name, phone FROM customers)
SELECT *, row_number() OVER (ORDER BY strip_accents(lower(name)), name, id) AS position
FROM named WHERE strip_accents(lower(name)) LIKE '%customer#00000_1%' OR phone LIKE '%000077%'""",
        ["customers"],
    ),
)
def accent_search(spark, sf_dir):
    """P11 and T5 over names with and without accents and capitals."""
    from tillspark.operators.filters import search_any
    from tillspark.operators.ordered import with_position
    from tillspark.operators.topk import name_order
    from tillspark.sources.changes import accented

    c = load_model(spark, sf_dir).customers.select("id", accented("name").alias("name"), "phone")
    found = search_any(c, ["name"], "CÚSTOMER#00000_1").unionByName(search_any(c, ["phone"], "000077")).distinct()
    return with_position(found, name_order(), ["name", "id"], ["id"])


@register(
    "accent_dedup",
    with_model(
        f""",
batch AS (SELECT id, {_accented_sql("username")} || CASE WHEN id % 5 = 0 THEN '-baru' ELSE '  ' END AS username FROM users)
SELECT b.id, b.username, b.id % 5 <> 0 AS taken FROM batch b""",
        ["users"],
    ),
)
def accent_dedup(spark, sf_dir):
    """M8: a username that differs from a stored one in case, accents or trailing blanks only is taken."""
    from tillspark.operators.mutations import reject_existing
    from tillspark.sources.changes import accented

    users = load_model(spark, sf_dir).users
    suffix = F.when(F.col("id") % 5 == 0, F.lit("-baru")).otherwise(F.lit("  "))
    batch = users.select("id", F.concat(accented("username"), suffix).alias("username"))
    fresh, taken = reject_existing(batch, users, F.col("username"), F.col("username"))
    return fresh.withColumn("taken", F.lit(False)).unionByName(taken.withColumn("taken", F.lit(True)))


@register(
    "accent_revenue",
    with_model(
        f""",
sold AS (SELECT {_accented_sql("product_name", "tx_id")} AS name, qty, subtotal FROM tx_details)
SELECT min(name) AS product_name, CAST(SUM(qty) AS BIGINT) AS qty_sold, CAST(SUM(subtotal) AS BIGINT) AS revenue
FROM sold GROUP BY rtrim(strip_accents(lower(name)))""",
        ["tx_details"],
    ),
)
def accent_revenue(spark, sf_dir):
    """Snapshots of one name in several spellings are one product."""
    from tillspark.operators.aggregates import product_sales
    from tillspark.sources.changes import accented

    lines = load_model(spark, sf_dir).tx_details
    named = lines.withColumnRenamed("tx_id", "id").withColumn("product_name", accented("product_name"))
    return product_sales(named, by_name_only=True)


# --------------------------------------------------------------------------
# M5-M7: one delete request over all tables
# --------------------------------------------------------------------------

_DELETE = """,
gone_tx AS (SELECT id FROM transactions WHERE id % 29 <> 0 OR cashier_id = 5),
left_tx AS (SELECT * FROM transactions WHERE id NOT IN (SELECT id FROM gone_tx)),
left_lines AS (SELECT * FROM tx_details WHERE tx_id NOT IN (SELECT id FROM gone_tx)),
gone_products AS (SELECT id FROM products WHERE id % 3 = 0 AND id NOT IN (SELECT product_id FROM left_lines)),
gone_users AS (SELECT id FROM users WHERE id <> 1 AND id NOT IN (SELECT cashier_id FROM left_tx)),
gone_customers AS (SELECT id FROM customers WHERE id % 4 = 0),
gone_categories AS (SELECT id FROM categories WHERE id IN (2, 5))"""
_DELETE_USES = ["transactions", "tx_details", "products", "users", "customers", "categories"]
_DELETED_TABLES = ["categories", "customers", "users", "products", "transactions", "tx_details"]


def _delete_run(spark, sf_dir):
    from tillspark.operators.key_graph import delete_requested
    from tillspark.sources.changes import delete_request

    m = load_model(spark, sf_dir)
    tables = {t: m.table(t) for t in _DELETED_TABLES}
    return delete_requested(tables, delete_request(m), protected={"users": (1,)})


@register(
    "delete_run",
    with_model(
        f"""{_DELETE}
SELECT 'categories' AS "table", id AS key, NULL::BIGINT AS ref, name AS label, NULL::BIGINT AS amount
FROM categories WHERE id NOT IN (SELECT id FROM gone_categories)
UNION ALL SELECT 'customers', id, NULL, name, NULL FROM customers WHERE id NOT IN (SELECT id FROM gone_customers)
UNION ALL SELECT 'users', id, NULL, username, NULL FROM users WHERE id NOT IN (SELECT id FROM gone_users)
UNION ALL SELECT 'products', id, CASE WHEN category_id IN (SELECT id FROM gone_categories) THEN NULL ELSE category_id END, name, stock
FROM products WHERE id NOT IN (SELECT id FROM gone_products)
UNION ALL SELECT 'transactions', id, CASE WHEN customer_id IN (SELECT id FROM gone_customers) THEN NULL ELSE customer_id END, invoice_no, total
FROM left_tx
UNION ALL SELECT 'tx_details', tx_id, product_id, product_name, subtotal FROM left_lines""",
        _DELETE_USES,
    ),
)
def delete_run(spark, sf_dir):
    """Key, pointer, label and amount of every row of the six new snapshots."""
    after = _delete_run(spark, sf_dir).tables
    none = F.lit(None).cast("long")
    shown = {
        "categories": ("id", none, "name", none),
        "customers": ("id", none, "name", none),
        "users": ("id", none, "username", none),
        "products": ("id", "category_id", "name", "stock"),
        "transactions": ("id", "customer_id", "invoice_no", "total"),
        "tx_details": ("tx_id", "product_id", "product_name", "subtotal"),
    }
    out = None
    for table, columns in shown.items():
        picked = [F.col(c) if isinstance(c, str) else c for c in columns]
        rows = after[table].select(F.lit(table).alias("table"), *[c.alias(n) for c, n in zip(picked, ("key", "ref", "label", "amount"))])
        out = rows if out is None else out.unionByName(rows)
    return out


@register(
    "delete_run_decisions",
    with_model(
        f"""{_DELETE},
asked AS (
  SELECT 'transactions' AS "table", id AS key, TRUE AS real, TRUE AS gone FROM gone_tx
  UNION ALL SELECT 'products', id, TRUE, id IN (SELECT id FROM gone_products) FROM products WHERE id % 3 = 0
  UNION ALL SELECT 'products', CAST(i AS BIGINT), FALSE, FALSE FROM range(-3, -1) r(i)
  UNION ALL SELECT 'users', id, TRUE, id IN (SELECT id FROM gone_users) FROM users
  UNION ALL SELECT 'customers', id, TRUE, TRUE FROM gone_customers
  UNION ALL SELECT 'categories', CAST(i AS BIGINT), i < 8, i < 8 FROM range(2, 9, 3) r(i))
SELECT "table", key, CASE WHEN gone THEN 'deleted' WHEN "table" = 'users' AND key = 1 THEN 'rejected: protected'
                          WHEN real THEN 'rejected: referenced' ELSE 'no such row' END AS decision FROM asked""",
        _DELETE_USES,
    ),
)
def delete_run_decisions(spark, sf_dir):
    return _delete_run(spark, sf_dir).decisions


# --------------------------------------------------------------------------
# A4, A8, A13 from maintained summaries
# --------------------------------------------------------------------------

_EPOCH_YEARS = (1997, 1999, 2001)  # sales before each year are one epoch; later ones are the open period


def _summary(m, kind):
    """Partials of three epochs and of the open period, added up; the middle
    epoch's walk-in sales are taken back."""
    from tillspark.operators import summaries

    tx = m.transactions.select("id", "date", "customer_id", "total")
    lines = m.tx_lines.join(tx.select("id", "date", F.col("customer_id").alias("_c")), F.col("tx_id") == F.col("id")).drop("id")
    rows = lines if kind.of_lines else tx.withColumn("_c", F.col("customer_id"))
    year = F.year("date")
    parts, before = [], 0
    for y in (*_EPOCH_YEARS, 9999):
        parts.append(summaries.partial(kind, rows.where((year >= before) & (year < y))))
        before = y
    void = rows.where((year >= _EPOCH_YEARS[0]) & (year < _EPOCH_YEARS[1]) & F.col("_c").isNull())
    return summaries.merged(kind, [*parts, summaries.partial(kind, void, -1)])


_SUMMARISED = f""",
live AS (SELECT * FROM transactions WHERE NOT (year(date) >= {_EPOCH_YEARS[0]} AND year(date) < {_EPOCH_YEARS[1]} AND customer_id IS NULL))"""


@register(
    "summary_daily",
    with_model(f"{_SUMMARISED}\nSELECT date, CAST(SUM(total) AS BIGINT) AS total FROM live WHERE date <= {AS_OF_SQL} GROUP BY date", ["transactions"]),
)
def summary_daily(spark, sf_dir):
    import datetime as dt

    from tillspark.operators import summaries

    m = load_model(spark, sf_dir)
    return summaries.daily_revenue(_summary(m, summaries.DAILY), dt.date(1970, 1, 1), m.as_of)


@register(
    "summary_customers",
    with_model(
        f"""{_SUMMARISED}
SELECT c.id, c.name, COUNT(t.id) AS total_transactions, CAST(COALESCE(SUM(t.total), 0) AS BIGINT) AS total_spent
FROM customers c LEFT JOIN live t ON t.customer_id = c.id GROUP BY c.id, c.name""",
        ["transactions", "customers"],
    ),
)
def summary_customers(spark, sf_dir):
    from tillspark.operators import summaries

    m = load_model(spark, sf_dir)
    return summaries.customer_totals(m.customers.select("id", "name"), _summary(m, summaries.CUSTOMERS))


@register(
    "summary_products",
    with_model(
        f"""{_SUMMARISED}
SELECT d.product_id, COUNT(*) AS rows, CAST(SUM(d.qty) AS BIGINT) AS qty, CAST(SUM(d.subtotal) AS BIGINT) AS subtotal
FROM live t JOIN tx_details d ON d.tx_id = t.id GROUP BY d.product_id""",
        ["transactions", "tx_details"],
    ),
)
def summary_products(spark, sf_dir):
    from tillspark.operators import summaries

    return _summary(load_model(spark, sf_dir), summaries.PRODUCTS)


# --------------------------------------------------------------------------
# Q2 with forms that fail, F19
# --------------------------------------------------------------------------

_STAFF_FORMS = """SELECT CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_suppkey END AS id,
         CASE WHEN s_suppkey % 7 = 0 THEN chr(9) || '  ' ELSE s_name END AS name,
         CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'u' || CAST(s_suppkey AS VARCHAR) END AS username,
         CASE s_suppkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE 'pw' END AS password FROM supplier"""


@register(
    "validate_users",
    f"""SELECT id, name, username, password, array_to_string(failed, '; ') AS errors, len(failed) = 0 AS accepted
FROM (SELECT *, list_filter([CASE WHEN trim(name, ' ' || chr(9)) = '' THEN 'name required' END,
                             CASE WHEN trim(COALESCE(username, '')) = '' THEN 'username required' END,
                             CASE WHEN id IS NULL AND trim(COALESCE(password, '')) = '' THEN 'password required for new users' END],
                            lambda e: e IS NOT NULL) AS failed
      FROM ({_STAFF_FORMS}) forms) checked""",
)
def validate_users(spark, sf_dir):
    """Staff forms as posted: some without a name, username or password."""
    from tillspark.operators.quality import validate_users as check
    from tillspark.sources.tables import read_table

    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name"])
    k = F.col("s_suppkey")
    forms = s.select(
        F.when(k % 2 != 0, k).alias("id"),
        F.when(k % 7 == 0, F.lit("\t  ")).otherwise(F.col("s_name")).alias("name"),
        F.when(k % 5 == 0, F.lit("")).when(k % 5 != 1, F.concat(F.lit("u"), k.cast("string"))).alias("username"),
        F.when(k % 3 == 0, F.lit(" ")).when(k % 3 == 2, F.lit("pw")).alias("password"),
    )
    return check(forms)


@register(
    "validate_names",
    """SELECT 'customer' AS form, c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'name required' ELSE '' END AS errors FROM customer
UNION ALL
SELECT 'category', p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'name required' ELSE '' END FROM part""",
)
def validate_names(spark, sf_dir):
    """Customer and category forms, some with a blank or missing name."""
    from tillspark.operators.quality import validate_categories, validate_customers
    from tillspark.sources.tables import read_table

    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"]).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name"]).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    customers = validate_customers(c.withColumn("name", F.when(F.col("id") % 9 == 0, F.lit("\r\n")).otherwise(F.col("name"))))
    categories = validate_categories(p.withColumn("name", F.when(F.col("id") % 4 != 0, F.col("name"))))
    shown = lambda df, form: df.select(F.lit(form).alias("form"), "id", "errors")
    return shown(customers, "customer").unionByName(shown(categories, "category"))


@register(
    "label_case",
    with_model(
        """SELECT p.id, upper(p.name) AS upper_name,
       array_to_string(list_transform(string_split(lower(p.name), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS title,
       upper(p.status[1:1]) AS initial FROM products p""",
        ["products"],
    ),
)
def label_case(spark, sf_dir):
    """F19 over product names and states."""
    from tillspark.functions.labels import initial, title, upper

    return load_model(spark, sf_dir).products.select("id", upper("name").alias("upper_name"), title("name").alias("title"), initial("status").alias("initial"))
