"""Order-dependent operators against plain windows and one-by-one loops."""

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillspark.operators.admission import admit_sales
from tillspark.operators.ordered import carry_last, next_value, ranged, running_sums, with_position


def hot_rows(spark, n=3000):
    """One product holds a third of all rows, all on one day."""
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        F.when(hot, F.lit(1)).otherwise(F.col("id") % 50).alias("product_id"),
        F.when(hot, F.lit(dt.date(2026, 1, 1))).otherwise(F.date_add(F.lit(dt.date(2026, 1, 1)), (F.col("id") % 17).cast("int"))).alias("date"),
        F.format_string("%05d", F.col("id")).alias("invoice_key"),
        (F.col("id") % 5 + 1).alias("qty"),
    )


def test_running_sums_match_a_window(spark):
    base = hot_rows(spark)
    order = [F.col("date"), F.col("invoice_key")]
    parts = ranged(base, [F.col("product_id"), *order], 9)
    got = running_sums(parts, "product_id", order, {"taken": F.col("qty"), "rows": F.lit(1)}).drop("_part")
    w = Window.partitionBy("product_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    want = base.withColumn("taken", F.coalesce(F.sum("qty").over(w), zero)).withColumn("rows", F.coalesce(F.sum(F.lit(1)).over(w), zero))
    assert got.count() == 3000 and got.exceptAll(want.select(*got.columns)).count() == 0
    # the hot product lies in several partitions
    assert parts.where("product_id = 1").select("_part").distinct().count() > 1


def test_carried_and_next_values_cross_partitions(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 701 == 5, F.col("id")).alias("v")).repartition(5)
    parts = ranged(df, [F.col("id")], 6)
    assert parts.select("_part").distinct().count() > 3
    got = {r.id: r.v for r in carry_last(parts, ["id"], ["v"], F.col("v").isNotNull()).collect()}
    assert got == {i: (i - 5) // 701 * 701 + 5 if i >= 5 else None for i in range(2000)}
    after = {r.id: r.n for r in next_value(parts, ["id"], "id", "n").collect()}
    assert after == {i: i + 1 if i < 1999 else None for i in range(2000)}
    empty = ranged(df.limit(0), [F.col("id")])
    assert carry_last(empty, ["id"], ["v"], F.col("v").isNotNull()).count() == 0


def test_positions_join_back_by_key(spark):
    df = hot_rows(spark, 500).withColumn("wide", F.repeat(F.lit("x"), 100))
    got = with_position(df, [F.col("date").desc(), F.col("invoice_key")], ["date", "invoice_key"], ["invoice_key"])
    rows = sorted(got.collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(1, 501))
    assert [(r.date, r.invoice_key) for r in rows] == sorted(((r.date, r.invoice_key) for r in rows), key=lambda x: (-x[0].toordinal(), x[1]))
    assert got.columns == [*df.columns, "position"]


def one_by_one(rows):
    """Sales (order, sale, product, qty, stock) in order, each admitted whole or not."""
    carts = collections.defaultdict(list)
    for at, sale, product, qty, stock in rows:
        carts[(at, sale)].append((product, qty, stock))
    taken, out = collections.Counter(), {}
    for at, sale in sorted(carts):
        lines = carts[(at, sale)]
        out[sale] = all(stock is not None and taken[p] + q <= stock for p, q, stock in lines)
        if out[sale]:
            taken.update({p: q for p, q, _ in lines})
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_admission_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    stock = {p: rng.choice([None, 0, 5, 20, 60, 1000]) for p in range(30)}
    rows = []
    for sale in range(600):
        products = {0 if rng.random() < 0.4 else rng.randrange(30) for _ in range(rng.randint(1, 5))}  # product 0 is hot
        rows += [(sale // 3, f"s{sale:04d}", p, rng.randint(1, 9), stock[p]) for p in products]
    df = spark.createDataFrame(rows, "at long, sale string, product long, qty long, stock long")
    got = {r.sale: r.admitted for r in admit_sales(df, "sale", "product", ["at", "sale"], "qty", "stock").collect()}
    want = one_by_one(rows)
    assert got == want and 0 < sum(want.values()) < len(want)


def test_refused_sales_take_nothing(spark):
    # b is refused for product 2, so c still gets product 1
    rows = [(1, "a", 1, 3, 5), (2, "b", 1, 2, 5), (2, "b", 2, 9, 5), (3, "c", 1, 2, 5)]
    df = spark.createDataFrame(rows, "at long, sale string, product long, qty long, stock long")
    got = {r.sale: r.admitted for r in admit_sales(df, "sale", "product", ["at", "sale"], "qty", "stock").collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_admission_of_nothing(spark):
    empty = spark.createDataFrame([], "at long, sale string, product long, qty long, stock long")
    assert admit_sales(empty, "sale", "product", ["at", "sale"], "qty", "stock").collect() == []


def test_ranks_over_nulls_ties_texts_and_numbers(spark, monkeypatch):
    import tillspark.operators.selection as selection
    from tillspark.operators.topk import page

    monkeypatch.setattr(selection, "STOP", 3)
    monkeypatch.setattr(selection, "BUCKETS", 4)
    rng = random.Random(4)
    names = [None, "", "a", "a\0", "ab", "Zebra kecil sekali", "Zebra kecil sekalian", "äpfel", "\U0001f600", "x" * 40, "x" * 41]
    rows = [(rng.choice(names), rng.choice([None, -(2**63), -5, 0, 7, 2**63 - 1]), rng.random() < 0.5, i) for i in range(400)]
    df = spark.createDataFrame(rows, "name string, n long, flag boolean, id int")
    for keys in (
        [("name", False), ("n", False), ("flag", False), ("id", False)],
        [("name", True), ("n", True), ("flag", True), ("id", True)],
        [("n", True), ("name", False), ("id", True)],
    ):
        order = [F.col(k).desc() if d else F.col(k).asc() for k, d in keys]
        everything = [r.id for r in df.orderBy(*order).collect()]
        for number in (1, 2, 9, 17, 33, 57, 58):
            assert [r.id for r in page(df, number, keys, 7).collect()] == everything[(number - 1) * 7 : number * 7]
    with pytest.raises(TypeError):
        page(spark.createDataFrame([(1.5,)] * 9, "x double"), 9, [("x", False)], 1)
