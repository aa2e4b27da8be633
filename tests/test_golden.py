"""Golden answers on the seed-shaped fixture (FIXTURES.md section 1.3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillspark.functions.dates import period_bounds
from tillspark.operators.inventory import restock
from tillspark.operators.pricing import discount_quote
from tillspark.plans import catalog, crm, ledger, reports
from seed_rows import SEED_AS_OF

D = dt.date


def test_report_daily_all(seed):
    rows = reports.report_daily(seed["transactions"], "all", SEED_AS_OF).orderBy("date").collect()
    assert [(r.date, r.total) for r in rows] == [
        (D(2026, 6, 8), 40000),
        (D(2026, 6, 9), 15000),
        (D(2026, 6, 10), 82000),
        (D(2026, 6, 11), 277500),
        (D(2026, 6, 12), 211000),
    ]


@pytest.mark.parametrize(
    "period,as_of,revenue,count,avg",
    [
        ("month", SEED_AS_OF, 625500, 16, 39093.75),
        ("week", SEED_AS_OF, 625500, 16, 39093.75),
        ("today", SEED_AS_OF, 211000, 3, 211000 / 3),
        ("all", D(2026, 6, 11), 414500, 13, 414500 / 13),
    ],
)
def test_report_summary(seed, period, as_of, revenue, count, avg):
    r = reports.report_summary(seed["transactions"], period, as_of).collect()[0]
    assert (r.revenue, r.tx_count) == (revenue, count)
    assert r.average == pytest.approx(avg)


def test_period_bounds():
    assert period_bounds("today", SEED_AS_OF) == (SEED_AS_OF, SEED_AS_OF)
    assert period_bounds("week", SEED_AS_OF) == (D(2026, 6, 5), SEED_AS_OF)
    assert period_bounds("month", SEED_AS_OF) == (D(2026, 6, 1), SEED_AS_OF)
    assert period_bounds("other", SEED_AS_OF) == (D(1970, 1, 1), SEED_AS_OF)
    assert period_bounds(None, SEED_AS_OF) == (D(2026, 6, 1), SEED_AS_OF)


def test_top_products_qty_week(seed):
    rows = reports.top_products_qty(seed["tx_details"], seed["transactions"], "week", SEED_AS_OF).orderBy("rank").collect()
    assert [(r.product_id, r.qty_sold, r.revenue, r.rank) for r in rows] == [
        (6, 11, 275000, 1),
        (3, 8, 28000, 2),
        (11, 5, 100000, 3),
        (1, 5, 17500, 4),
        (2, 3, 13500, 5),
    ]


def test_top_products_revenue(seed):
    rows = reports.top_products_revenue(seed["tx_details"]).orderBy("rank").collect()
    assert [(r.product_name, r.revenue) for r in rows] == [
        ("Product 6", 275000),
        ("Product 786524", 150000),
        ("Product 11", 100000),
        ("Product 7", 30000),
        ("Product 3", 28000),
    ]


def test_recent_sales(seed):
    rows = catalog.recent_sales(seed["transactions"], seed["users"]).collect()
    got = sorted(rows, key=lambda r: (r.date, r.time, r.id), reverse=True)
    assert [r.id for r in got] == [16, 15, 14, 10, 9]
    assert {r.id: r.customer_type for r in rows}[15] == "Member"
    assert {r.id: r.customer_type for r in rows}[16] == "Umum"


def test_ledger_pages(seed):
    args = (seed["transactions"], seed["users"], seed["customers"], seed["tx_details"])
    p1 = ledger.ledger_page(*args, 1).collect()
    p2 = ledger.ledger_page(*args, 2).collect()
    key = lambda r: (r.date, r.time, r.id)
    assert [r.id for r in sorted(p1, key=key, reverse=True)] == [16, 15, 14, 10, 9, 8, 7, 6, 2, 1]
    assert [r.id for r in sorted(p2, key=key, reverse=True)] == [13, 12, 11, 3, 4, 5]
    info = ledger.ledger_page_info(seed["transactions"], 1).collect()[0]
    assert (info.total_rows, info.total_pages) == (16, 2)


def test_item_counts(seed):
    rows = ledger.ledger(seed["transactions"], seed["users"], seed["customers"], seed["tx_details"]).collect()
    items = {r.id: r.items for r in rows}
    assert items[3] == 3
    assert all(items[i] == 2 for i in (1, 2, 4, 5))
    assert items[12] == 0 and items[13] == 0
    assert all(items[i] == 1 for i in (6, 7, 8, 9, 10, 11, 14, 15, 16))


def test_ledger_labels(seed):
    rows = {r.id: r for r in ledger.ledger(seed["transactions"], seed["users"], seed["customers"], seed["tx_details"]).collect()}
    assert rows[2].customer_name == "Umum"
    assert rows[1].customer_name == "Customer 1"
    assert rows[16].cashier_name == "Cashier 4"


def test_customer_totals(seed):
    rows = crm.customer_list(seed["customers"], seed["transactions"]).collect()
    assert {r.id: (r.total_transactions, r.total_spent) for r in rows} == {
        1: (1, 35000),
        2: (1, 82000),
        3: (1, 15000),
        4: (1, 3500),
    }


def test_category_counts(seed):
    rows = catalog.category_counts(seed["categories"], seed["products"]).collect()
    assert {r.id: r.product_count for r in rows} == {1: 4, 2: 1, 3: 4, 4: 3, 5: 1, 6: 1, 7: 2}
    assert sorted(r.ordinal for r in rows) == list(range(1, 8))


def test_low_stock(seed):
    rows = catalog.low_stock_top(seed["products"]).collect()
    assert [r.id for r in rows] == [786526]


def test_restock_no_change(seed):
    before = {r.id: r.stock for r in seed["products"].collect()}
    after = {r.id: r.stock for r in restock(seed["products"]).collect()}
    assert before == after


def test_discount_quote_seed(seed):
    q = discount_quote(seed["transactions"].select("id", "subtotal"), seed["discount_rules"], SEED_AS_OF).collect()
    got = {r.id: (r.discount_type, r.discount_value, r.discount_amount) for r in q}
    for i in (8, 10, 16, 3):
        assert got[i] == ("flat", 10000, 10000)
    assert got[9] == ("percent", 5, 5000)
    assert got[14] == ("percent", 5, 7500)
    for i in (1, 2, 4, 5, 6, 7, 11, 12, 13, 15):
        assert got[i] == ("flat", 0, 0)


def test_sales_report_view_labels(seed):
    rows = reports.sales_report_view(seed["transactions"], seed["users"], seed["customers"]).collect()
    by_inv = {r.invoice_no: r for r in rows}
    assert by_inv["INV-0002"].customer_name == "UMUM"
    assert by_inv["INV-0001"].cashier_name == "Cashier 1"


def test_customer_avg_basket(seed):
    rows = crm.customer_avg_basket(seed["customers"], seed["transactions"]).collect()
    assert {r.customer_id: r.avg_basket for r in rows} == {1: 35000.0, 2: 82000.0, 3: 15000.0, 4: 3500.0}


def test_dashboard(seed):
    r = catalog.dashboard_kpis(seed["transactions"], seed["products"], seed["customers"], SEED_AS_OF).collect()[0]
    assert (r.today_revenue, r.today_transactions, r.total_products, r.total_customers) == (211000, 3, 16, 4)
    r = catalog.dashboard_kpis(seed["transactions"], seed["products"], seed["customers"], D(2026, 1, 1)).collect()[0]
    assert r.today_revenue == 0


def test_report_chart(seed):
    rows = {r.date: r for r in reports.report_chart(seed["transactions"], "all", SEED_AS_OF).collect()}
    top = rows[D(2026, 6, 11)]
    assert top.bar_height == pytest.approx(150.0) and top.label == "06-11"
    assert rows[D(2026, 6, 9)].bar_height == pytest.approx(15000 / 277500 * 150)


def test_transaction_lines(seed):
    ids = seed["transactions"].where(F.col("id") == 3)
    rows = ledger.transaction_lines(seed["tx_details"], ids).collect()
    assert sorted((r.product_id, r.quantity, r.line_total) for r in rows) == [(6, 2, 50000), (10, 2, 14000), (11, 1, 20000)]
