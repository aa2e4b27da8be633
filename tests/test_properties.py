"""Properties and skew-safe operators against brute force."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillspark.functions.money import round_double, round_money
from tillspark.operators.ids import assign_ids, global_positions, store_once
from tillspark.operators.mutations import latest_per_key, upsert
from tillspark.operators.pricing import discount_quote
from tillspark.plans import ledger, reports
from tillspark.schemas import DISCOUNT_RULES
from tillspark.sources.mapping import load_model
from tillspark.sources.tables import literal_table

SF = "/root/testdata/sf0.001"


def test_daily_series_sums_to_summary(spark):
    m = load_model(spark, SF)
    for period in ("week", "month", "all"):
        daily = reports.report_daily(m.transactions, period, m.as_of).agg(F.sum("total")).collect()[0][0] or 0
        summary = reports.report_summary(m.transactions, period, m.as_of).collect()[0].revenue
        assert daily == summary


def test_pages_partition_the_ledger(spark, seed):
    args = (seed["transactions"], seed["users"], seed["customers"], seed["tx_details"])
    ids = []
    for n in (1, 2, 3):
        ids += [r.id for r in ledger.ledger_page(*args, n, size=7).collect()]
    assert sorted(ids) == list(range(1, 17))


@settings(max_examples=25, deadline=None)
@given(
    amounts=st.lists(st.integers(min_value=0, max_value=10**9), min_size=1, max_size=20),
    rules=st.lists(
        st.tuples(st.sampled_from(["flat", "percent"]), st.integers(0, 200), st.integers(0, 10**6),
                  st.one_of(st.none(), st.integers(0, 10**5))),
        min_size=0, max_size=5,
    ),
)
def test_discount_between_zero_and_subtotal(spark, amounts, rules):
    rows = [(i + 1, f"r{i}", t, v, mp, cap, True, None, None) for i, (t, v, mp, cap) in enumerate(rules)]
    rdf = literal_table(spark, rows, DISCOUNT_RULES)
    sales = spark.range(len(amounts)).select(
        F.col("id"), F.element_at(F.array(*[F.lit(a) for a in amounts]), (F.col("id") + 1).cast("int")).cast("long").alias("subtotal")
    )
    for r in discount_quote(sales, rdf, dt.date(2026, 1, 1)).collect():
        assert 0 <= r.discount_amount <= r.subtotal
        assert r.total_after_discount == r.subtotal - r.discount_amount


def test_restock_property(spark):
    from tillspark.operators.inventory import restock

    m = load_model(spark, SF)
    p = m.products.select("id", "stock", "min_stock")
    after = restock(p).withColumnRenamed("stock", "after").join(p, ["id", "min_stock"])
    bad = after.where((F.col("stock") >= 0) & (F.col("stock") < F.col("min_stock")) & (F.col("after") < 2 * F.col("min_stock")))
    assert bad.count() == 0


def test_upsert_idempotent(spark, seed):
    changes = seed["products"].where("id <= 3").withColumn("price", F.col("price") + 1).drop("status")
    once = upsert(seed["products"], changes, "id", ["price"], [F.col("name")])
    twice = upsert(once, changes, "id", ["price"], [F.col("name")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_latest_per_key_hot_key(spark):
    df = spark.range(5000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).alias("k"),
                                  F.col("id").alias("seq"), (F.col("id") * 2).alias("v"))
    got = {r.k: r.v for r in latest_per_key(df, "k", "seq").collect()}
    assert got[7] == 2 * 4998


def test_global_positions_dense(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k")).repartition(7)
    pos = global_positions(df, [F.col("k")], "pos").collect()
    assert sorted(r.pos for r in pos) == list(range(1, 1001))
    assert all(r.pos == r.k + 1 for r in pos)
    ids = assign_ids(df, [F.col("k")], 100).collect()
    assert sorted(r.id for r in ids) == list(range(101, 1101))


def test_report_and_dashboard_composites(seed):
    from tillspark.plans.catalog import dashboard
    from seed_rows import SEED_AS_OF

    rep = reports.sales_report(seed["transactions"], seed["tx_details"], seed["users"], seed["customers"], "month", SEED_AS_OF)
    assert rep["rows"].count() == 16 and rep["summary"].collect()[0].revenue == 625500
    assert rep["top_products"].count() == 5
    assert rep["chart"].agg(F.sum("total")).collect()[0][0] == 625500
    dash = dashboard(seed["transactions"], seed["products"], seed["customers"], seed["users"], SEED_AS_OF)
    assert dash["kpis"].collect()[0].today_revenue == 211000 and dash["recent_sales"].count() == 5


def test_ingest_decisions_partition_the_batch(spark):
    from tillspark.plans import ingest
    from tillspark.sources import changes

    m = load_model(spark, SF)
    headers, lines = changes.sale_rows(m, with_reposts=True)
    store = changes.store(m)
    dec = ingest.ingest_decisions(headers, lines, store, m.products)
    n_invoices = headers.select(F.lower("invoice_no")).distinct().count()
    assert dec.count() == n_invoices
    assert dec.agg(F.sum("copies")).collect()[0][0] == headers.count()
    accepted = dec.where(F.col("decision") == "accepted").count()
    assert ingest.ingest_headers(headers, lines, store, m.products).count() == accepted


def test_keyset_pages_equal_offset_pages(seed):
    from tillspark.operators.topk import RECENT_KEYS, page, page_after, recent_order

    tx = seed["transactions"].select("id", "date", "time")
    keys = [("date", True), ("time", True), ("id", True)]
    first = page(tx, 1, RECENT_KEYS, size=5).orderBy(*recent_order()).collect()
    last = first[-1].asDict()
    nxt = [r.id for r in page_after(tx, last, keys, size=5).collect()]
    assert nxt == [r.id for r in page(tx, 2, RECENT_KEYS, size=5).orderBy(*recent_order()).collect()]


def test_double_rounding_equals_round(spark):
    """``round_double`` moves exact halves away from zero like ``round``, whatever lies beside them."""
    import math

    halves = [k + 0.5 for k in range(-6, 6)] + [2.0**51 + 0.5, -(2.0**51) - 0.5, 2.0**52 + 1, 1e15 + 0.3]
    values = [v for h in halves for v in (math.nextafter(h, -math.inf), h, math.nextafter(h, math.inf))] + [0.0, -0.0, None, 21168.23, 0.49999999999999994]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", round_double("x").alias("a"), round_money("x").alias("b"))
    assert all(r.a == r.b for r in df.collect())
    assert "round(" not in df.select(round_double("x"))._jdf.queryExecution().executedPlan().toString()


def test_stored_frames_run_their_plan_once(spark):
    """A checkpoint ran the last step twice, once for the count and once for the write."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(i):
        calls.add(1)
        return i

    assert store_once(spark.range(100).select(seen("id").alias("i"))).where("i >= 0").count() == 100
    assert calls.value == 100
