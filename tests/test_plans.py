"""Plan assertions: the physical shapes the operators promise at scale."""

import pytest

from tillspark import registry
from tillspark.operators.pricing import discount_quote
from tillspark.plans import reports
from tillspark.sources.mapping import load_model

SF = "/root/testdata/sf0.001"
registry.load_all()


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udf_gathering_or_cross_join_in_any_query(spark):
    for name, fn in registry.QUERIES.items():
        text = plan_text(fn(spark, SF))
        for marker in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas",
                       "collect_list", "collect_set", "CartesianProduct"):
            assert marker not in text, f"{name} plans {marker}"


def test_literal_tables_stay_in_the_jvm(spark):
    m = load_model(spark, SF)
    for df in (m.categories, m.discount_rules):
        assert "ExistingRDD" not in plan_text(df)


def test_dimensions_broadcast(spark):
    m = load_model(spark, SF)
    text = plan_text(reports.sales_report_view(m.transactions, m.users, m.customers))
    assert text.count("BroadcastHashJoin") >= 2


def test_discount_quote_keeps_sales_unshuffled(spark):
    m = load_model(spark, SF)
    sales = m.raw("orders", ["o_orderkey", "o_totalprice"]).selectExpr("o_orderkey AS id", "CAST(o_totalprice AS BIGINT) AS subtotal")
    df = discount_quote(sales, m.discount_rules, m.as_of)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in text
    # Exchanges exist only under the broadcast (rule tiers), never above the sales scan.
    scan_line = [ln for ln in text.splitlines() if "orders.parquet" in ln or "Scan parquet" in ln][0]
    above = text.split(scan_line)[0]
    sales_path = [ln for ln in above.splitlines() if not ln.strip().startswith(":")]
    assert not any("Exchange" in ln and "Broadcast" not in ln for ln in sales_path[:3])


def test_queries_that_read_no_discount_match_no_tier(spark):
    """The constant tiers of the mapping are no join: unread, they cost nothing; read, no comparison of pairs."""
    assert "NestedLoopJoin" not in plan_text(registry.QUERIES["basket_subtotal"](spark, SF))
    m = load_model(spark, SF)
    assert "Join" not in plan_text(m.transactions.select("id", "discount", "total"))
    quoted = discount_quote(m.transactions.select("id", "subtotal"), m.discount_rules, m.as_of)
    of_rules = quoted.select("id", "discount_type", "discount_value", "discount_amount")
    assert sorted(m.transactions.select(*of_rules.columns).collect()) == sorted(of_rules.collect())


def test_filters_pushed_to_scan(spark):
    m = load_model(spark, SF)
    df = reports.report_summary(m.transactions, "month", m.as_of)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in text or "DataFilters" in text
    read = df._jdf.queryExecution().sparkPlan().toString()
    assert "o_orderpriority" not in read and "o_orderstatus" not in read


@pytest.mark.parametrize("name", ["top_products_qty", "recent_sales", "low_stock", "ledger_page"])
def test_topk_uses_take_ordered(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().sparkPlan().toString()


def test_deep_pages_need_no_checkpoint_and_no_sort(spark, monkeypatch):
    """Pages at any depth equal the offset form; the plan stays a filter and a small top-k."""
    import tillspark.operators.selection as selection
    from tillspark.operators.topk import RECENT_KEYS, page, recent_order

    monkeypatch.setattr(selection, "STOP", 20)
    monkeypatch.setattr(selection, "BUCKETS", 16)
    tx = load_model(spark, SF).transactions.select("id", "date", "time")
    n = tx.count()
    everything = [r.id for r in tx.orderBy(*recent_order()).collect()]
    for number in (1, 2, 3, 40, 149, n // 10, n // 10 + 1, 1_000_000):
        cut = page(tx, number, RECENT_KEYS)
        text = cut._jdf.queryExecution().executedPlan().toString()
        assert "Scan ExistingRDD" not in text and "Window" not in text
        assert [r.id for r in cut.orderBy(*recent_order()).collect()] == everything[(number - 1) * 10 : number * 10], number
    deep = page(tx, 100, RECENT_KEYS)._jdf.queryExecution().sparkPlan().toString()
    assert "TakeOrderedAndProject(limit=" in deep
    assert int(deep.split("TakeOrderedAndProject(limit=")[1].split(",")[0]) <= 30


def test_invoice_dedup_limits_before_the_shuffle(spark):
    from pyspark.sql import functions as F

    from tillspark.plans.ingest import first_per_invoice

    # One invoice holds a third of all copies.
    headers = spark.range(3000).select(
        F.col("id").cast("string").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("INV-HOT")).otherwise(F.concat(F.lit("INV-"), F.col("id").cast("string"))).alias("invoice_no"),
        F.lit("2026-06-13").cast("date").alias("date"),
        F.lit("08:00:00").alias("time"),
        F.lit(1.0).alias("total"),
        F.lit(1.0).alias("paid"),
    )
    out = first_per_invoice(headers)
    rows = {r.invoice_no: r.copies for r in out.collect()}
    assert rows["INV-HOT"] == 1000 and len(rows) == 2001
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text
