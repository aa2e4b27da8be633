"""Q4 over a batch: which sales the stock admits, as if rung up one by one.

A sale is admitted whole if, for each of its products, what earlier admitted
sales took plus its own quantity stays within the stock.  One by one this is a
loop; here it is a fixed point between two bounds on what earlier sales take:

* at most everything that earlier sales not yet refused want: a sale that fits
  under it is admitted;
* at least what earlier admitted sales took: a sale that exceeds it is refused.

Both are prefix sums over (product, sale order), so a round judges all open
sales at once, and the earliest open sale of any product is judged in every
round.  Between rounds only products with open sales stay.  State is written to
the shared checkpoint folder; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.operators.ids import store_once
from tillspark.operators.ordered import ranged, running_sums


def admit_sales(lines: DataFrame, sale: str, product: str, order: list[str], qty: str, stock: str) -> DataFrame:
    """(sale, product, *order, qty, stock) with one row per sale and product ->
    (sale, ``admitted``).  ``order`` is a total order of the sales, constant
    within one; quantities are positive; a null stock refuses.
    """
    by: list[Column] = [F.col(c) for c in order]
    # stored first: the range bounds are sampled from these rows in a pass of their own
    narrow = store_once(lines.select(*dict.fromkeys([sale, product, *order]), F.col(qty).alias("_q"), F.col(stock).alias("_s")))
    open_lines = ranged(narrow.withColumn("_in", F.lit(False)), [F.col(product), *by])
    decided: DataFrame | None = None
    while True:
        judged = running_sums(
            open_lines,
            product,
            by,
            {"_least": F.when(F.col("_in"), F.col("_q")).otherwise(0), "_most": F.col("_q")},
        )
        fits = lambda taken: F.coalesce(F.col(taken) + F.col("_q") <= F.col("_s"), F.lit(False))
        verdict = (
            judged.where(~F.col("_in"))
            .groupBy(sale)
            .agg(F.bool_and(fits("_most")).alias("_sure"), F.bool_and(fits("_least")).alias("_may"))
            .where(F.col("_sure") | ~F.col("_may"))
            .select(F.col(sale).alias("_sale"), F.col("_sure").alias("admitted"))
        )
        verdict = store_once(verdict)
        found = verdict.select(F.col("_sale").alias(sale), "admitted")
        decided = found if decided is None else decided.unionByName(found)
        after = open_lines.join(verdict, F.col(sale) == F.col("_sale"), "left").where(F.coalesce("admitted", F.lit(True)))
        after = after.withColumn("_in", F.col("_in") | F.col("admitted").isNotNull()).select(*open_lines.columns)
        waiting = after.where(~F.col("_in")).select(F.col(product).alias("_p")).distinct()
        open_lines = store_once(after.join(waiting, F.col(product) == F.col("_p"), "left_semi"))
        if open_lines.isEmpty():
            return decided
