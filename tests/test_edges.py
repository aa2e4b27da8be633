"""Edge rows (FIXTURES.md section 2) and the semantics of SURVEY 1.4."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillspark import schemas
from tillspark.functions import labels, money
from tillspark.operators import filters, mutations
from tillspark.operators.inventory import refresh_status, restock
from tillspark.operators.pricing import discount_quote, valid_rules
from tillspark.operators.topk import name_order
from tillspark.plans import catalog
from seed_rows import fixture

AS_OF = dt.date(2026, 6, 12)


def _stock_df(spark, rows):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("stock", T.LongType()),
                           T.StructField("min_stock", T.LongType())])
    return spark.createDataFrame(rows, schema)


def test_stock_status(spark):
    df = _stock_df(spark, [(1, 0, 5), (2, -2, 5), (3, 5, 5), (4, 6, 5), (5, None, 5)])
    got = {r.id: r.status for r in refresh_status(df).collect()}
    assert got == {1: "HABIS", 2: "STOK MENIPIS", 3: "STOK MENIPIS", 4: "TERSEDIA", 5: "TERSEDIA"}


def test_restock_edges(spark):
    df = _stock_df(spark, [(1, 3, 5), (2, 0, 5), (3, -2, 5), (4, 5, 5), (5, None, 5)])
    got = {r.id: r.stock for r in restock(df).collect()}
    assert got == {1: 13, 2: 10, 3: 8, 4: 5, 5: None}


def _rules(spark, rows):
    return spark.createDataFrame(rows, schemas.DISCOUNT_RULES)


def _quote(spark, rules, amounts, as_of=AS_OF):
    sales = spark.createDataFrame([(i, a) for i, a in enumerate(amounts)], "id long, subtotal long")
    rows = discount_quote(sales, rules, as_of).collect()
    return {r.subtotal: r for r in rows}


def test_discount_thresholds(spark):
    q = _quote(spark, fixture(spark, "discount_rules"), [49999, 50000, 99999, 100000, 199999, 200000])
    assert (q[49999].discount_type, q[49999].discount_value, q[49999].discount_amount) == ("flat", 0, 0)
    assert q[50000].discount_amount == 10000 and q[99999].discount_amount == 10000
    assert q[100000].discount_amount == 5000
    assert q[199999].discount_exact == pytest.approx(9999.95) and q[199999].discount_amount == 10000
    assert q[200000].discount_amount == 20000 and q[200000].discount_type == "percent"
    assert q[49999].total_after_discount == 49999


def test_discount_cap_and_clamp(spark):
    base = (True, None, None)
    rules = _rules(spark, [(1, "p", "percent", 10, 200000, 15000, *base)])
    assert _quote(spark, rules, [200000])[200000].discount_amount == 15000
    rules = _rules(spark, [(1, "p", "percent", 10, 200000, 0, *base)])
    assert _quote(spark, rules, [200000])[200000].discount_amount == 20000
    rules = _rules(spark, [(1, "f", "flat", 10000, 50000, 5000, *base)])
    assert _quote(spark, rules, [60000])[60000].discount_amount == 10000
    rules = _rules(spark, [(1, "f", "flat", 10000, 5000, None, *base)])
    r = _quote(spark, rules, [6000])[6000]
    assert r.discount_amount == 6000 and r.total_after_discount == 0


def test_rule_validity(spark):
    d = AS_OF
    rows = [
        (1, "inactive", "flat", 1, 0, None, False, None, None),
        (2, "future", "flat", 2, 0, None, True, d + dt.timedelta(days=1), None),
        (3, "past", "flat", 3, 0, None, True, None, d - dt.timedelta(days=1)),
        (4, "starts", "flat", 4, 0, None, True, d, None),
        (5, "ends", "flat", 5, 0, None, True, None, d),
    ]
    ids = sorted(r.id for r in valid_rules(_rules(spark, rows), AS_OF).collect())
    assert ids == [4, 5]


def test_rule_tie_lowest_id(spark):
    q = _quote(spark, fixture(spark, "discount_rules"), [150000])
    assert q[150000].rule_id == 1


def test_search(spark):
    tx = spark.createDataFrame([("INV-0001",), ("INV-12345",), ("X-1",)], "invoice_no string")
    assert filters.search(tx, "invoice_no", "inv").count() == 2
    assert filters.search(tx, "invoice_no", "").count() == 3
    assert filters.search(tx, "invoice_no", "0").count() == 3
    assert filters.search(tx, "invoice_no", None).count() == 3
    assert [r.invoice_no for r in filters.search(tx, "invoice_no", "INV-____").collect()] == ["INV-0001", "INV-12345"]


def test_date_range_optional(spark):
    tx = spark.createDataFrame([(dt.date(2026, 6, d),) for d in range(1, 11)], "date date")
    assert filters.date_range(tx).count() == 10
    assert filters.date_range(tx, "2026-06-03").count() == 8
    assert filters.date_range(tx, None, "2026-06-03").count() == 3
    assert filters.date_range(tx, "2026-06-03", "2026-06-03").count() == 1


def test_money_rounding(spark):
    df = spark.createDataFrame([(7500.5,), (2.5,), (-2.5,)], "x double")
    assert [r.v for r in df.select(money.round_money("x").alias("v")).collect()] == [7501, 3, -3]


def test_format_and_parse_rupiah(spark):
    df = spark.createDataFrame([(1234567.5,), (2.5,), (0.0,)], "x double")
    got = [r.t for r in df.select(money.format_rupiah("x").alias("t")).collect()]
    assert got == ["Rp 1.234.568", "Rp 3", "Rp 0"]
    s = spark.createDataFrame([("Rp 1.234.568",), ("",), (None,)], "s string")
    assert [r.v for r in s.select(money.parse_rupiah("s").alias("v")).collect()] == [1234568, 0, 0]


def test_lenient_parse(spark):
    s = spark.createDataFrame([("12abc",), ("abc",), (" 7",), ("3.5kg",), ("",)], "s string")
    rows = s.select(money.parse_int("s").alias("i"), money.parse_float("s").alias("f")).collect()
    assert [r.i for r in rows] == [12, None, 7, 3, None]
    assert [r.f for r in rows] == [12.0, None, 7.0, 3.5, None]


def test_labels(spark):
    df = spark.createDataFrame([(None, ""), (5, "x")], "customer_id long, unit string")
    rows = df.select(labels.member_label().alias("m"), labels.blank_or("unit", "pcs").alias("u")).collect()
    assert [(r.m, r.u) for r in rows] == [("Umum", "pcs"), ("Member", "x")]
    p = spark.createDataFrame([(7, None), (8, "")], "product_id long, name string")
    assert [r.n for r in p.select(labels.product_label("name", "product_id").alias("n")).collect()] == [
        "Produk #7", "Produk #8"]


def test_case_insensitive_order(spark):
    df = spark.createDataFrame([(1, "kaos"), (2, "Teh"), (3, "Jubah"), (4, "Chitato")], "id long, name string")
    assert [r.name for r in df.orderBy(*name_order()).collect()] == ["Chitato", "Jubah", "kaos", "Teh"]


def test_guarded_delete(seed):
    cat = {r.id: r.decision for r in mutations.guarded_delete(seed["categories"], "id", seed["products"], "category_id").collect()}
    assert cat[1] == mutations.DECISION_REFERENCED
    users = {r.id: r.decision for r in
             mutations.guarded_delete(seed["users"], "id", seed["transactions"], "cashier_id", protected=(1,)).collect()}
    assert users == {1: mutations.DECISION_PROTECTED, 2: mutations.DECISION_REFERENCED,
                     3: mutations.DECISION_DELETED, 4: mutations.DECISION_REFERENCED}


def test_low_stock_strict(seed):
    assert filters.low_stock(seed["products"], strict=True).count() == 0
    assert [r.id for r in filters.low_stock(seed["products"]).collect()] == [786526]


def test_user_list_has_no_secret(seed):
    assert "password_digest" not in catalog.user_list(seed["users"]).columns
    assert {r.name for r in catalog.active_user_list(seed["users"]).collect()} == {"Cashier 1", "Cashier 2", "Cashier 4"}


def test_instant_and_clock_independent_of_session_zone(spark):
    from tillspark.functions.dates import clock_time, invoice_id, invoice_millis, sale_instant_millis

    df = spark.createDataFrame([(dt.date(2026, 6, 11), "17:42:05")], "date date, time string")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        out = []
        for tz in ("UTC", "Asia/Jakarta"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            r = df.select(sale_instant_millis("date", "time").alias("ms")).select(
                "ms", invoice_id("ms").alias("inv"), clock_time("ms").alias("clock"),
                clock_time("ms", 7 * 60).alias("local")).collect()[0]
            out.append(tuple(r))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert out[0] == out[1]
    ms, inv, clock, local = out[0]
    assert ms == int(dt.datetime(2026, 6, 11, 17, 42, 5, tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert (clock, local) == ("17:42", "00:42")
    back = spark.createDataFrame([(inv,)], "i string").select(invoice_millis("i").alias("m")).collect()[0].m
    assert back == ms


def test_null_keys_salted_when_not_broadcast(spark):
    from tillspark.operators.joins import left_lookup

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = spark.range(2000).select(
            F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 50).alias("fk"))
        dim = spark.range(40).select(F.col("id"), (F.col("id") * 10).alias("v"))
        salted = left_lookup(fact, dim, "fk", salt_col="id")
        plain = fact.join(dim.withColumnRenamed("id", "_d"), F.col("fk") == F.col("_d"), "left").drop("_d")
        assert "SortMergeJoin" in salted._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.select(*salted.columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_general_ci_key(spark):
    from tillspark.operators.aggregates import product_sales

    lines = spark.createDataFrame([("Teh ", 1, 10), ("teh", 2, 20), ("Kopi", 1, 5)], "product_name string, qty int, subtotal long")
    got = {r.product_name.lower().strip(): (r.qty_sold, r.revenue) for r in product_sales(lines, by_name_only=True).collect()}
    assert got == {"teh": (3, 30), "kopi": (1, 5)}


def test_split_referenced_and_lines_of(seed):
    from tillspark.operators.joins import split_referenced

    used, unused = split_referenced(seed["categories"], seed["products"], "id", "category_id")
    assert sorted(r.id for r in used.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert unused.count() == 0
    assert sorted(r.product_id for r in filters.lines_of(seed["tx_details"], 3).collect()) == [6, 10, 11]


def test_referential_actions(seed):
    gone_customers = seed["customers"].where("id = 1").select("id")
    tx = mutations.on_delete_set_null(seed["transactions"], gone_customers, "customer_id", salt_col="id")
    got = {r.id: r.customer_id for r in tx.collect()}
    assert got[1] is None and got[3] == 2 and got[2] is None
    gone_sales = seed["transactions"].where("id IN (1, 3)").select("id")
    left = mutations.on_delete_cascade(seed["tx_details"], gone_sales, "tx_id")
    assert left.count() == 20 - 2 - 3 and left.where("tx_id IN (1, 3)").count() == 0


def test_upsert_users_rules(spark, seed):
    from tillspark.plans.master_data import upsert_users

    changes = spark.createDataFrame(
        [(2, "Cashier Two", "cashier2", "kasir", "active", ""),      # update, keep digest
         (None, "New One", "newbie", "kasir", "active", "secret"),   # insert
         (None, "No Pass", "nopass", "kasir", "active", ""),         # insert without password
         (None, "Dup", "CASHIER1", "kasir", "active", "x")],         # username taken (case-insensitive)
        "id long, name string, username string, role string, status string, password string")
    users = seed["users"].withColumn("password_digest", F.md5(F.col("username")))
    snap, rejected = upsert_users(users, changes, AS_OF)
    rows = {r.username: r for r in snap.collect()}
    assert rows["cashier2"].name == "Cashier Two" and rows["cashier2"].password_digest == users.where("id = 2").collect()[0].password_digest
    assert rows["newbie"].id == 5 and rows["newbie"].created_at == AS_OF
    assert "nopass" not in rows and "CASHIER1" not in rows
    assert sorted(r.username for r in rejected.collect()) == ["CASHIER1", "nopass"]


def test_validators_and_cart(spark):
    from tillspark.operators.quality import cart_lines, validate_products

    form = spark.createDataFrame(
        [(1, "Teh", "1", "2000", "2500", "10"),     # fine
         (2, " ", "0", "abc", "2500", "x"),         # blank name, no category, not numbers
         (3, "Kopi", "2", "3000", "2500", "5")],    # price below cost
        "id long, name string, category_id string, cost string, price string, stock string")
    got = {r.id: (r.accepted, r.errors) for r in validate_products(form).collect()}
    assert got[1] == (True, "")
    assert got[2][0] is False and got[2][1] == "name required; category required; cost, price and stock must be numbers"
    assert got[3] == (False, "price below cost")
    events = spark.createDataFrame([("A", 1, 2), ("A", 1, 1), ("A", 2, 1), ("A", 2, -1), ("B", 1, -3)],
                                   "invoice_no string, product_id long, qty long")
    assert sorted(tuple(r) for r in cart_lines(events).collect()) == [("A", 1, 3)]


def test_change_floor_and_latest_changes(spark, seed):
    df = spark.createDataFrame([(5000, 3500), (3000, 3500)], "paid long, total long")
    rows = df.select(money.change_due().alias("c"), money.change_due(floor_at_zero=True).alias("shown")).collect()
    assert [(r.c, r.shown) for r in rows] == [(1500, 1500), (-500, 0)]
    changes = spark.createDataFrame([(1, 9000, 1), (1, 9100, 2), (2, 4700, 1)], "id long, price long, seq long")
    latest = mutations.latest_per_key(changes, "id", "seq").drop("seq")
    snap = mutations.upsert(seed["products"], latest, "id", ["price"], [F.col("name")])
    prices = {r.id: r.price for r in snap.collect()}
    assert prices[1] == 9100 and prices[2] == 4700 and prices[3] == 3500
    kept = mutations.kept_after_delete(mutations.guarded_delete(seed["customers"], "id", seed["transactions"], "customer_id"))
    assert kept.count() == 4


def test_duplicate_changes_of_one_key_keep_one_row(spark, seed):
    from pyspark.sql import functions as F

    from tillspark.operators import mutations

    before = seed["products"].count()
    key = seed["products"].agg(F.min("id")).first()[0]
    changes = spark.createDataFrame([(key, 1000), (key, 3000), (key, 2000)], "id long, price long")
    changes = changes.withColumn("price", F.col("price").cast(seed["products"].schema["price"].dataType))
    snap = mutations.apply_updates(seed["products"], changes, "id", ["price"])
    assert snap.count() == before
    assert [int(r.price) for r in snap.where(F.col("id") == key).collect()] == [3000]


def test_guarded_delete_of_requested_keys(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id long, name string")
    facts = spark.createDataFrame([(2,), (None,)], "fk long")
    asked = spark.createDataFrame([(4,), (4,), (2,), (9,), (None,)], "k long")
    decided = mutations.guarded_delete(dim, "id", facts, "fk", requested=asked)
    assert {r.id: r.decision for r in decided.collect()} == {
        1: mutations.DECISION_KEPT, 2: mutations.DECISION_REFERENCED, 3: mutations.DECISION_KEPT, 4: mutations.DECISION_DELETED}
    assert sorted(r.id for r in mutations.kept_after_delete(decided).collect()) == [1, 2, 3]
