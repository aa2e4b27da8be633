"""Operators at sizes, orders and inputs that the base queries do not reach."""

import json

import pytest
from pyspark.sql import functions as F

from tillspark.operators.pricing import match_rule, match_rule_asof, quote_columns, rule_tiers
from tillspark.sources.documents import parse_posted
from tillspark.sources.mapping import load_model

SF = "/root/testdata/sf0.001"


def test_posted_bodies_are_sorted_out(spark):
    good = {"invoice_no": "INV-1", "date": "2026-06-13", "total": 3500, "items": [{"product_id": 1, "qty": 2}], "unknown": 1}
    bodies = {
        "good": json.dumps(good),
        "few": json.dumps({"invoice_no": "INV-2"}),
        "null": None,
        "blank": " \t",
        "object": "{}",
        "other": '{"unknown": 1}',
        "cut": json.dumps(good)[:-3],
        "text": "hello",
        "number": "17",
        "typed": json.dumps(good | {"total": "much"}),
        "item": json.dumps(good | {"items": [{"product_id": "x"}]}),
    }
    df = spark.createDataFrame([(k, b, "clash", "kept") for k, b in bodies.items()], "name string, body string, total string, extra string")
    parsed = parse_posted(df)
    assert parsed.columns[:2] == ["name", "extra"] and parsed.columns[-1] == "problem"
    got = {r.name: r for r in parsed.collect()}
    assert {k: r.problem for k, r in got.items()} == {
        "good": None, "few": None, "null": "empty", "blank": "empty", "object": "empty", "other": "empty",
        "cut": "malformed", "text": "malformed", "number": "malformed", "typed": "malformed", "item": "malformed",
    }
    assert got["good"].total == 3500.0 and got["good"]["items"][0].qty == 2 and got["few"].total is None
    assert all(r.invoice_no is None for r in got.values() if r.problem)
    # the verdict does not depend on the columns read
    assert parse_posted(df).where("problem IS NULL").select("invoice_no").count() == 2
    assert parse_posted(df.limit(0)).count() == 0


RULES = "id long, name string, type string, value long, min_purchase long, max_discount long, is_active boolean, start_date date, end_date date"


def test_any_number_of_rules(spark):
    """Both joins agree with a plain lookup; 5,000 thresholds, ties, amounts on, between and below them."""
    m = load_model(spark, SF)
    rules = spark.range(1, 6001).select(
        "id", F.lit("r").alias("name"), F.lit("percent").alias("type"), (F.col("id") % 40).alias("value"),
        (F.col("id") % 5000 * 10 + 100).alias("min_purchase"), F.lit(None).cast("long").alias("max_discount"),
        F.lit(True).alias("is_active"), F.lit(None).cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date"),
    )
    tiers = rule_tiers(rules, m.as_of)
    assert tiers.count() == 5000 and tiers.where("hi IS NULL").count() == 1
    assert tiers.where("hi IS NOT NULL AND hi <> lo + 10").count() == 0
    amounts = [None, 0, 99, 100, 101, 50_090, 50_095, 10**9] + [105] * 500 + list(range(100, 50_100, 97))
    sales = spark.createDataFrame(list(enumerate(amounts)), "id long, subtotal long")
    got = {r.id: r.rule_id for r in match_rule(sales, tiers).collect()}
    lowest = {}
    for i in range(6000, 0, -1):
        lowest[i % 5000 * 10 + 100] = i
    want = {i: None if a is None or a < 100 else lowest[min(a // 10 * 10, 50_090)] for i, a in enumerate(amounts)}
    assert got == want
    few = rule_tiers(rules.where("id <= 40"), m.as_of)
    narrow = match_rule(sales, few).select("id", "rule_id", "lo", "hi")
    assert narrow.exceptAll(match_rule_asof(sales, few).select("id", "rule_id", "lo", "hi")).count() == 0


@pytest.mark.parametrize("subtotal,value,cap,amount,total", [(150, 5, None, 8, 143), (199999, 5, 0, 10000, 189999), (200, 10, 15, 15, 185), (1000, 0, None, 0, 1000)])
def test_discount_and_total_round_by_themselves(spark, subtotal, value, cap, amount, total):
    df = spark.createDataFrame([(subtotal, "percent", value, cap)], "subtotal long, rule_type string, rule_value long, max_discount long")
    r = df.select(*quote_columns()).collect()[0]
    assert (r.discount_amount, r.total_after_discount) == (amount, total)


def test_ordered_csv_parts_are_one_sorted_file(spark, scratch):
    """Concatenated by name, the parts are the sorted ledger with one header line."""
    import csv
    import io
    import os

    from tillspark.plans import ledger
    from tillspark.sources.export import write_csv_ordered

    m = load_model(spark, SF)
    rows = ledger.export_ledger_rows(m.transactions, m.users, m.customers, m.tx_lines)
    out = rows.select(*ledger.EXPORT_LEDGER_COLUMNS, *[F.col(c).alias(f"_{c}") for c in ("date", "time", "id")])
    path = os.path.join(scratch, "ordered")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_csv_ordered(out, path, [("_date", True), ("_time", True), ("_id", True)], ledger.LEDGER_CSV_HEADER)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted(f for f in os.listdir(path) if f.endswith(".csv"))
    assert len(parts) > 2
    lines = list(csv.reader(io.StringIO("".join(open(os.path.join(path, p)).read() for p in parts))))
    want = [[str(v) for v in r] for r in rows.orderBy(F.desc("date"), F.desc("time"), F.desc("id")).select(*ledger.EXPORT_LEDGER_COLUMNS).collect()]
    assert lines == [ledger.LEDGER_CSV_HEADER, *want]


def test_ordered_csv_quotes_and_empty_table(spark, scratch):
    import os

    from tillspark.sources.export import write_csv_ordered

    df = spark.createDataFrame([(2, 'say "hi"', None), (1, "a,b", "")], "n int, text string, other string")
    write_csv_ordered(df, os.path.join(scratch, "q"), [("n", False)])
    write_csv_ordered(df.limit(0), os.path.join(scratch, "none"), [("n", False)], ["N", "T", "O"])
    read = lambda d: "".join(open(os.path.join(scratch, d, p)).read() for p in sorted(os.listdir(os.path.join(scratch, d))) if p.endswith(".csv"))
    assert read("q") == 'n,text,other\n1,"a,b",\n2,"say ""hi""",\n'
    assert read("none") == "N,T,O\n"


def test_twenty_epochs_read_one_snapshot_each(spark, seed, scratch):
    """Stock and ids run on over 20 epochs and a restart; each epoch reads the
    newest snapshot only, and a replayed epoch takes its stock once."""
    import os
    import time

    from tillspark.streaming.ingest_stream import SalesIngestSink, start_sales_ingest

    src = os.path.join(scratch, "in")
    os.makedirs(src)

    def post(n):
        item = {"product_id": 1, "name": "Product 1", "qty": 2, "price": 3500, "subtotal": 7000}
        base = {"date": "2026-06-13", "time": f"08:{n:02d}:00", "cashier_id": 1, "subtotal": 7000, "discount": 0, "total": 7000, "paid": 7000}
        rows = [base | {"invoice_no": f"INV-S{n}", "items": [item]}]
        if n:
            rows.append(base | {"invoice_no": f"inv-s{n - 1} ", "items": [item]})  # a number seen before
        with open(os.path.join(src, f"part-{n:02d}.json"), "w") as fh:
            fh.write("\n".join(json.dumps(r) for r in rows))
        stamp = time.time() - 1000 + n
        os.utime(os.path.join(src, f"part-{n:02d}.json"), (stamp, stamp))

    products = seed["products"].withColumn("stock", F.when(F.col("id") == 1, F.lit(31).cast("long")).otherwise(F.col("stock")))
    sink = SalesIngestSink(seed["transactions"], products, os.path.join(scratch, "heads"), os.path.join(scratch, "lines"))
    for begin, end in ((0, 12), (12, 20)):
        for n in range(begin, end):
            post(n)
        query = start_sales_ingest(spark, src, sink, os.path.join(scratch, "ckpt"), max_files_per_trigger=1)
        query.awaitTermination(300)
        assert query.exception() is None
    heads = spark.read.parquet(sink.headers_path).orderBy("id").collect()
    assert [r.invoice_no for r in heads] == [f"INV-S{n}" for n in range(15)]  # 31 in stock, two a sale
    assert [r.id for r in heads] == list(range(17, 32))
    lines = spark.read.parquet(sink.lines_path)
    assert sorted(r.tx_id for r in lines.collect()) == [r.id for r in heads]
    kept = sorted(os.listdir(sink.state_path))
    assert kept == ["epoch=18", "epoch=19"]
    stock, last_id = sink.state(spark, 20)
    files = stock.inputFiles()
    assert files and all("epoch=19" in f for f in files) and stock.count() == products.count()
    assert last_id == 31 and stock.where("id = 1").first().stock == 1
    # replay of the last epoch: the same outputs, the same stock
    from tillspark.schemas import SALE_DOCUMENT

    sink(spark.read.schema(SALE_DOCUMENT).json(os.path.join(src, "part-19.json")).where("invoice_no = 'INV-S19'"), 19)
    stock, last_id = sink.state(spark, 20)
    assert last_id == 31 and stock.where("id = 1").first().stock == 1
    assert spark.read.parquet(sink.headers_path).count() == 15


def test_text_compares_without_case_accents_and_trailing_blanks(spark):
    from tillspark.functions.text import ci_key, fold, search_match

    names = ["Café Été", "CAFE ETE  ", "cafe\u0301 ete", "Ñandú", "nandu", "straße", "Łódź", "teh 100%", None, "日本"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    rows = df.select("name", ci_key("name").alias("k"), fold("name").alias("f"), search_match("name", "FÉ_ET").alias("hit")).collect()
    keys = {r.name: r.k for r in rows}
    assert keys["Café Été"] == keys["CAFE ETE  "] == "cafe ete" and keys["Ñandú"] == keys["nandu"]
    assert keys[None] is None and keys["日本"] == "日本" and keys["straße"] == "straße"
    assert {r.name for r in rows if r.hit} == {"Café Été", "CAFE ETE  "}
    # the ICU collation finds the same names equal
    pairs = df.where("name IN ('Café Été', 'Ñandú')").crossJoin(df.select(F.col("name").alias("other")))
    equal = pairs.where(F.collate("name", "UNICODE_CI_AI_RTRIM") == F.collate("other", "UNICODE_CI_AI_RTRIM"))
    by_key = pairs.where(ci_key("name") == ci_key("other"))
    assert by_key.exceptAll(equal).count() == 0 and equal.count() >= by_key.count() == 4


def test_filters_prune_months_and_lines(spark, scratch):
    import datetime as dt
    import os

    from tillspark.operators.filters import date_range, on_date
    from tillspark.plans import ledger
    from tillspark.sources.export import with_month, write_snapshot

    m = load_model(spark, SF)
    write_snapshot(with_month(m.transactions), os.path.join(scratch, "tx"), "1", ["month"])
    tx = spark.read.parquet(os.path.join(scratch, "tx", "version=1"))
    plain = m.transactions
    for got, want in (
        (on_date(tx, dt.date(2001, 7, 19)), on_date(plain, dt.date(2001, 7, 19))),
        (date_range(tx, "2001-07-02", None), date_range(plain, "2001-07-02", None)),
        (date_range(tx, "2001-03-15", "2001-05-01"), date_range(plain, "2001-03-15", "2001-05-01")),
    ):
        filters = got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
        assert "month" in filters
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())
    rows = ledger.ledger(plain, m.users, m.customers, m.tx_lines, None, "2001-07-01", None)
    text = rows._jdf.queryExecution().sparkPlan().toString()
    assert any("LeftSemi" in ln and "Broadcast" in ln for ln in text.splitlines()), [ln for ln in text.splitlines() if "Join" in ln]
    everything = {r.id: r["items"] for r in ledger.ledger(plain, m.users, m.customers, m.tx_lines).collect()}
    assert {r.id: r["items"] for r in rows.collect()}.items() <= everything.items()


def test_refusals_spread_through_the_key_graph(spark):
    """c points at b (restrict), b at a (cascade), d at a (cascade, no key): a
    refused cascade keeps its whole request, and what survives refuses others."""
    from tillspark.operators.key_graph import CASCADE, RESTRICT, SET_NULL, ForeignKey, delete_requested

    a = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    b = spark.createDataFrame([(10, 1), (11, 1), (20, 2), (30, None)], "id long, a long")
    c = spark.createDataFrame([(100, 10), (101, None)], "id long, b long")
    d = spark.createDataFrame([(1, 7), (2, 8), (2, 9), (None, 9)], "a long, e long")
    e = spark.createDataFrame([(7, 3), (8, 3), (9, 1), (6, None)], "id long, a long")
    keys = (
        ForeignKey("b", "a", "a", CASCADE), ForeignKey("c", "b", "b", RESTRICT), ForeignKey("d", "a", "a", CASCADE),
        ForeignKey("d", "e", "e", RESTRICT), ForeignKey("e", "a", "a", SET_NULL),
    )
    tables = {"a": a, "b": b, "c": c, "d": d, "e": e}
    ask = lambda *ids: spark.createDataFrame([(i,) for i in ids], "key long")
    out = delete_requested(tables, {"a": ask(1, 2, 2, None, 99), "e": ask(6, 7, 8, 9)}, keys, {"e": (6,)})
    got = {(r["table"], r["key"]): r.decision for r in out.decisions.collect()}
    # 10 cannot go (c points at it), so 1 stays, so its d row stays, so e 7 stays; d (null, 9) survives, so e 9 stays
    assert got == {
        ("a", 1): "rejected: referenced", ("a", 2): "deleted", ("a", 99): "no such row",
        ("e", 6): "rejected: protected", ("e", 7): "rejected: referenced", ("e", 8): "deleted", ("e", 9): "rejected: referenced",
    }
    rows = {t: sorted(map(tuple, df.collect()), key=str) for t, df in out.tables.items()}
    assert rows["a"] == [(1,), (3,)] and rows["b"] == [(10, 1), (11, 1), (30, None)] and len(rows["c"]) == 2
    assert rows["d"] == [(1, 7), (None, 9)] and rows["e"] == [(6, None), (7, 3), (9, 1)]
    gone = delete_requested(tables, {"c": ask(100), "a": ask(1, 3)}, keys)
    rows = {t: sorted(map(tuple, df.collect()), key=str) for t, df in gone.tables.items()}
    assert rows["a"] == [(2,)] and rows["b"] == [(20, 2), (30, None)] and rows["c"] == [(101, None)]
    assert rows["e"] == [(6, None), (7, None), (8, None), (9, None)]
    with pytest.raises(ValueError):
        delete_requested(tables, {"a": ask(1)}, (*keys, ForeignKey("a", "id", "c", RESTRICT)))


def test_summaries_equal_a_recount_after_every_epoch(spark, scratch):
    """Epochs, a replay, a compaction, deleted sales and the open day against a full recount."""
    from tillspark.operators import summaries
    from tillspark.operators.summaries import CUSTOMERS, DAILY, PRODUCTS, SummaryStore, partial

    m = load_model(spark, SF)
    tx, lines = m.transactions.cache(), m.tx_lines.cache()
    of = lambda cond: (tx.where(cond), lines.join(tx.where(cond).select("id"), F.col("tx_id") == F.col("id"), "left_semi"))
    store = SummaryStore(spark, scratch)
    assert store.read(DAILY).count() == 0

    def same(seen, open_cond=None):
        heads, rows = of(seen)
        for kind in (DAILY, CUSTOMERS, PRODUCTS):
            open_rows = None if open_cond is None else of(open_cond)[1 if kind.of_lines else 0]
            got = store.read(kind, open_rows)
            want = partial(kind, rows if kind.of_lines else heads)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))

    store.add_epoch(0, *of("id < 300"))
    store.add_epoch(1, *of("id >= 300 AND id < 700"))
    store.add_epoch(1, *of("id >= 300 AND id < 800"))  # replayed
    same("id < 800")
    store.compact()
    same("id < 800")
    with pytest.raises(ValueError):
        store.add_epoch(1, *of("id < 5"))
    store.add_epoch(2, *of("id >= 800 AND id < 1000"))
    store.add_epoch(3, *of("id < 50"), sign=-1)
    same("id >= 50 AND id < 1000")
    same("id >= 50 AND id < 1100", "id >= 1000 AND id < 1100")
    store.compact()
    store.compact()
    same("id >= 50 AND id < 1000")
    assert len(store.parts(DAILY)) == 1
    totals = summaries.customer_totals(m.customers.select("id", "name"), store.read(CUSTOMERS))
    assert totals.count() == m.customers.count() and totals.agg(F.min("total_transactions")).first()[0] == 0
    tx.unpersist(), lines.unpersist()


def test_a_cashier_of_half_of_all_sales_is_dealt_out(spark, monkeypatch):
    """No broadcast of staff: the hot cashier's sales lie in many partitions, none holds far more than its share."""
    from tillspark.operators import joins
    from tillspark.plans.reports import with_parties

    key = F.when(F.col("id") % 2 == 0, F.lit(7)).when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 400)
    tx = spark.range(20_000).select("id", key.alias("cashier_id"), (F.col("id") % 90).alias("customer_id"))
    users = spark.range(300).select("id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("name"))
    plain = {r.id: (r.cashier_name, r.customer_name) for r in with_parties(tx, users, users).collect()}
    monkeypatch.setattr(joins, "DIM_BROADCAST_ROWS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = with_parties(tx, users, users)
        text = joined._jdf.queryExecution().sparkPlan().toString()
        assert text.count("SortMergeJoin") == 2
        dealt = joins.spread_left_join(tx, users, "cashier_id", "id")
        parts = dealt.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("cashier_id") == 7).cast("int")).alias("hot")).collect()
        assert len(parts) == 8 and all(r.hot > 0 for r in parts) and max(r.n for r in parts) < 1.5 * 20_000 / 8
        assert {r.id: (r.cashier_name, r.customer_name) for r in joined.collect()} == plain
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_broadcast_needs_few_bytes_too(spark, monkeypatch):
    from tillspark.operators import joins

    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 10_000).alias("name"))
    assert joins.may_broadcast(wide)
    monkeypatch.setattr(joins, "SMALL_ESTIMATE", 0)
    assert joins.byte_bound_holds(wide, 2_000_000) and not joins.byte_bound_holds(wide, 900_000)


def test_the_last_change_of_a_key_wins_by_sequence(spark):
    from tillspark.operators.mutations import apply_updates, upsert

    now = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, name string, stock long")
    changes = spark.createDataFrame(
        [(1, "zzz", 9, 1), (1, "new", 1, 3), (1, "mid", 7, 2), (2, "x", 3, None), (2, "w", 4, 0), (9, "gone", 0, 1), (None, "fresh", 2, 1)],
        "id long, name string, stock long, seq long",
    )
    got = {r.id: (r.name, r.stock) for r in apply_updates(now, changes, "id", ["name", "stock"], seq_col="seq").collect()}
    assert got == {1: ("new", 1), 2: ("w", 4)}
    without = {r.id: r.name for r in apply_updates(now, changes, "id", ["name", "stock"]).collect()}
    assert without == {1: "zzz", 2: "x"}
    all_ = {r.id: r.name for r in upsert(now, changes, "id", ["name", "stock"], [F.col("name")], seq_col="seq").collect()}
    assert all_ == {1: "new", 2: "w", 3: "fresh"}
