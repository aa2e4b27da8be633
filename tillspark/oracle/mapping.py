"""DuckDB text of the test-table mapping (mirror of ``sources.mapping``).

``with_model(body, uses)`` prepends the CTEs of the model tables that
``body`` reads (and their dependencies) to an oracle query.
"""

from __future__ import annotations

from tillspark.sources.mapping import AS_OF, CATEGORY_ROWS, RULE_ROWS

AS_OF_SQL = f"DATE '{AS_OF.isoformat()}'"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)


CTES: dict[str, tuple[str, list[str]]] = {
    "categories": (
        f"""SELECT CAST(id AS BIGINT) AS id, CAST(name AS VARCHAR) AS name, CAST("desc" AS VARCHAR) AS "desc"
            FROM (VALUES {_values(CATEGORY_ROWS)}) v(id, name, "desc")""",
        [],
    ),
    "discount_rules": (
        f"""SELECT CAST(id AS BIGINT) AS id, CAST(name AS VARCHAR) AS name, CAST(type AS VARCHAR) AS type,
                   CAST(value AS BIGINT) AS value, CAST(min_purchase AS BIGINT) AS min_purchase,
                   CAST(max_discount AS BIGINT) AS max_discount, CAST(is_active AS BOOLEAN) AS is_active,
                   CAST(start_date AS DATE) AS start_date, CAST(end_date AS DATE) AS end_date
            FROM (VALUES {_values(RULE_ROWS)})
                 v(id, name, type, value, min_purchase, max_discount, is_active, start_date, end_date)""",
        [],
    ),
    "rule_tiers": (
        f"""SELECT id AS rule_id, type AS rule_type, value AS rule_value, max_discount,
                   min_purchase AS lo, lead(min_purchase) OVER (ORDER BY min_purchase) AS hi
            FROM (SELECT *, row_number() OVER (PARTITION BY min_purchase ORDER BY id) AS rn
                  FROM discount_rules
                  WHERE is_active AND (start_date IS NULL OR start_date <= {AS_OF_SQL})
                    AND (end_date IS NULL OR end_date >= {AS_OF_SQL})) r
            WHERE rn = 1""",
        ["discount_rules"],
    ),
    "users": (
        """SELECT s_suppkey AS id, s_name AS name, 'user' || CAST(s_suppkey AS VARCHAR) AS username,
                  md5('pw' || CAST(s_suppkey AS VARCHAR)) AS password_digest,
                  CASE WHEN s_suppkey = 0 THEN 'admin' ELSE 'kasir' END AS role,
                  CASE WHEN s_suppkey % 3 = 2 THEN 'inactive' ELSE 'active' END AS status,
                  CAST(NULL AS DATE) AS created_at
           FROM supplier""",
        [],
    ),
    "customers": (
        """SELECT c_custkey AS id, c_name AS name, printf('08%010d', c_custkey) AS phone,
                  CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS address, CAST(NULL AS DATE) AS created_at
           FROM customer""",
        [],
    ),
    "products": (
        """SELECT p_partkey AS id, p_name AS name,
                  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE c.id END AS category_id,
                  printf('899%010d', p_partkey) AS barcode,
                  CAST(floor(p_retailprice * 0.8) AS BIGINT) AS cost,
                  CAST(round(p_retailprice) AS BIGINT) AS price,
                  CAST((p_partkey * 7 + p_size) % 40 AS BIGINT) AS stock,
                  CAST(5 + p_size % 10 AS BIGINT) AS min_stock,
                  'pcs' AS unit, 'TERSEDIA' AS status
           FROM part LEFT JOIN categories c ON part.p_type = c.name""",
        ["categories"],
    ),
    "tx_base": (
        """SELECT o_orderkey AS id, printf('INV-%07d', o_orderkey) AS invoice_no,
                  CAST(o_orderdate AS DATE) AS date,
                  printf('%02d:%02d:00', (o_orderkey * 7) % 24, (o_orderkey * 13) % 60) AS time,
                  CASE WHEN o_orderkey % 8 = 7 THEN CAST(-1 AS BIGINT) ELSE o_orderkey % 8 END AS cashier_id,
                  CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey END AS customer_id,
                  CAST(round(o_totalprice) AS BIGINT) AS subtotal
           FROM orders""",
        [],
    ),
    "tx_quoted": (
        """SELECT b.*, COALESCE(t.rule_type, 'flat') AS discount_type,
                  COALESCE(t.rule_value, 0) AS discount_value,
                  CASE WHEN t.rule_type IS NULL THEN 0 ELSE
                       LEAST(CASE WHEN t.rule_type = 'percent' THEN
                                   CASE WHEN t.max_discount > 0 AND b.subtotal * t.rule_value > t.max_discount * 100
                                        THEN t.max_discount ELSE (b.subtotal * t.rule_value + 50) // 100 END
                                 ELSE t.rule_value END, b.subtotal) END AS discount_amount
           FROM tx_base b LEFT JOIN rule_tiers t ON b.subtotal >= t.lo AND (t.hi IS NULL OR b.subtotal < t.hi)""",
        ["tx_base", "rule_tiers"],
    ),
    "transactions": (
        """SELECT id, invoice_no, date, time, cashier_id, customer_id, subtotal,
                  discount_amount AS discount, subtotal - discount_amount AS total,
                  ((subtotal - discount_amount + 49999) // 50000) * 50000 AS paid,
                  ((subtotal - discount_amount + 49999) // 50000) * 50000 - (subtotal - discount_amount) AS change,
                  'completed' AS status, discount_type, discount_value, discount_amount
           FROM tx_quoted""",
        ["tx_quoted"],
    ),
    "tx_details": (
        """SELECT l_orderkey AS tx_id, l_partkey AS product_id, p_name AS product_name,
                  CAST(l_quantity AS INTEGER) AS qty,
                  CAST(round(l_extendedprice / l_quantity) AS BIGINT) AS price,
                  CAST(l_quantity AS INTEGER) * CAST(round(l_extendedprice / l_quantity) AS BIGINT) AS subtotal
           FROM lineitem JOIN part ON l_partkey = p_partkey""",
        [],
    ),
}


CTES["named_sales"] = (
    """SELECT s.*, staff.who_sold, buyer.who_bought, COALESCE(cart.n_lines, 0) AS n_lines
       FROM transactions s
       LEFT JOIN (SELECT id AS cashier_id, name AS who_sold FROM users) staff USING (cashier_id)
       LEFT JOIN (SELECT id AS customer_id, name AS who_bought FROM customers) buyer USING (customer_id)
       LEFT JOIN (SELECT tx_id AS id, COUNT(*) AS n_lines FROM tx_details GROUP BY tx_id) cart USING (id)""",
    ["transactions", "users", "customers", "tx_details"],
)


def sale_list_sql(columns: list[str], cashier: str | None, walk_in: str, tail: str = "", with_time: bool = True) -> str:
    """Oracle of a list of sales: the columns that the operator promises, read
    from ``named_sales`` with the operator's labels for missing names."""
    day = "strftime(date, '%d/%m/%Y')"
    promised = {
        "cashier_name": "who_sold" if cashier is None else f"COALESCE(who_sold, {_lit(cashier)})",
        "customer_name": f"COALESCE(who_bought, {_lit(walk_in)})",
        "items": "n_lines",
        "date_text": f"{day} || ' ' || time" if with_time else day,
    }
    listed = ", ".join(f"{promised[c]} AS {c}" if c in promised else c for c in columns)
    return with_model(f"SELECT {listed} FROM named_sales {tail}", ["named_sales"])


def _closure(uses: list[str]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][1]:
            visit(dep)
        order.append(name)

    for u in uses:
        visit(u)
    return order


def with_model(body: str, uses: list[str]) -> str:
    """Prefix ``body`` with the CTEs for ``uses``; ``body`` may add its own
    CTEs by starting with ``, name AS (...)``."""
    names = _closure(uses)
    ctes = ",\n".join(f"{n} AS ({CTES[n][0]})" for n in names)
    body = body.strip()
    if body.startswith(","):
        return f"WITH {ctes}{body}"
    return f"WITH {ctes}\n{body}"
