"""Rule-based discounts over whole batches of sales.

For one subtotal the reference picks, among active rules valid on the day,
the one with the highest ``min_purchase <= subtotal`` (ties: lowest id).
Batch form: collapse the rules to non-overlapping tiers ``[lo, hi)`` once,
then attach a tier to every sale.

* A rule table of at most ``BROADCAST_TIERS`` tiers (counted) is broadcast: a
  map-side range join, the sales are never shuffled.
* A longer one is an as-of join: thresholds and the distinct amounts are united,
  range-partitioned and sorted by amount, and the last threshold is carried
  on, across partitions too; sales then join their amount's tier.  No number of
  rules is too large.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillspark.functions.money import discount_amount, discount_raw, discounted_total
from tillspark.operators.joins import row_bound_holds
from tillspark.operators.ordered import PART, carry_last, next_value, ranged

# The nested-loop range join of a broadcast tier table costs one comparison
# per sale and tier; rows are six narrow columns, so the broadcast stays small.
BROADCAST_TIERS = 1_000

TIER_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType() if n == "rule_type" else T.LongType()) for n in ("rule_id", "rule_type", "rule_value", "max_discount", "lo", "hi")]
)
TIER_COLUMNS = TIER_SCHEMA.fieldNames()


def valid_rules(rules: DataFrame, as_of: dt.date) -> DataFrame:
    """Active rules whose optional [start, end] window contains ``as_of``."""
    d = F.lit(as_of)
    return rules.where(
        F.col("is_active")
        & (F.col("start_date").isNull() | (F.col("start_date") <= d))
        & (F.col("end_date").isNull() | (F.col("end_date") >= d))
    )


def _one_per_threshold(rules: DataFrame, as_of: dt.date) -> DataFrame:
    """The valid rule of lowest id for each threshold.  ``min_by`` aggregates
    partially, so a threshold of many rules does not pile up."""
    v = valid_rules(rules, as_of)
    first = v.groupBy(F.col("min_purchase").alias("lo")).agg(
        F.min_by(F.struct("id", "type", "value", "max_discount"), F.col("id")).alias("_r")
    )
    return first.select(
        F.col("_r.id").alias("rule_id"),
        F.col("_r.type").alias("rule_type"),
        F.col("_r.value").alias("rule_value"),
        F.col("_r.max_discount").alias("max_discount"),
        "lo",
    )


def _tiers(rules: DataFrame, as_of: dt.date) -> tuple[DataFrame, bool]:
    """(tiers, whether they may be broadcast)."""
    first = _one_per_threshold(rules, as_of)
    if row_bound_holds(first, BROADCAST_TIERS):
        return first.withColumn("hi", F.lead("lo").over(Window.orderBy("lo"))), True
    return next_value(ranged(first, [F.col("lo")]), ["lo"], "lo", "hi").drop(PART), False


def rule_tiers(rules: DataFrame, as_of: dt.date) -> DataFrame:
    """One rule per threshold (lowest id) and the next threshold as ``hi``."""
    return _tiers(rules, as_of)[0].select(*TIER_COLUMNS)


def _evaluated(rules: DataFrame, as_of: dt.date) -> tuple[DataFrame, bool]:
    from tillspark.sources.tables import literal_table

    tiers, small = _tiers(rules, as_of)
    tiers = tiers.select(*TIER_COLUMNS)
    if small:
        tiers = literal_table(rules.sparkSession, [tuple(r) for r in tiers.collect()], tiers.schema)
    return tiers, small


def frozen_tiers(rules: DataFrame, as_of: dt.date) -> DataFrame:
    """W4 evaluated once.  A broadcastable tier table is embedded as a literal
    one, so later plans carry it as constants instead of re-running the rule
    aggregation (it moves no more data to the driver than the broadcast would);
    a longer one stays a distributed table."""
    return _evaluated(rules, as_of)[0]


def match_rule(sales: DataFrame, tiers: DataFrame, amount_col: str = "subtotal", checked: bool = False) -> DataFrame:
    """Left range join of every sale to the tier containing its amount.

    ``checked`` says that the tiers are known to be few enough to broadcast.
    """
    if not checked and not row_bound_holds(tiers, BROADCAST_TIERS):
        return match_rule_asof(sales, tiers, amount_col)
    t = F.broadcast(tiers)
    amount = F.col(amount_col)
    cond = (amount >= t["lo"]) & (t["hi"].isNull() | (amount < t["hi"]))
    return sales.join(t, cond, "left")


def match_rule_asof(sales: DataFrame, tiers: DataFrame, amount_col: str = "subtotal") -> DataFrame:
    """J10/T8 for any number of tiers: as-of join of the distinct amounts, then
    an equality join (adaptive execution splits an amount that many sales share)."""
    kinds = {f.name: f.dataType for f in tiers.schema.fields}
    points = tiers.select(F.col("lo").cast("long").alias("_at"), F.lit(0).alias("_kind"), *TIER_COLUMNS)
    amounts = sales.select(F.col(amount_col).cast("long").alias("_at")).where("_at IS NOT NULL").distinct()
    blank = [F.lit(None).cast(kinds[c]).alias(c) for c in TIER_COLUMNS]
    order = ["_at", "_kind"]
    parts = ranged(points.unionByName(amounts.select("_at", F.lit(1).alias("_kind"), *blank)), [F.col(c) for c in order])
    found = carry_last(parts, order, TIER_COLUMNS, F.col("_kind") == 0).where("_kind = 1").select("_at", *TIER_COLUMNS)
    return sales.join(found, F.col(amount_col) == F.col("_at"), "left").drop("_at")


def quote_columns(amount_col: str = "subtotal") -> list:
    """Discount quote columns for a frame that carries the matched tier."""
    s = F.col(amount_col)
    typ, val, cap = F.col("rule_type"), F.col("rule_value"), F.col("max_discount")
    amount = discount_amount(s, typ, val, cap)
    return [
        F.coalesce(typ, F.lit("flat")).alias("discount_type"),
        F.coalesce(val, F.lit(0).cast("long")).alias("discount_value"),
        F.coalesce(discount_raw(s, typ, val, cap), F.lit(0.0)).alias("discount_exact"),
        amount.alias("discount_amount"),
        discounted_total(s, typ, val, cap).alias("total_after_discount"),
    ]


def discount_quote(
    sales: DataFrame, rules: DataFrame, as_of: dt.date, amount_col: str = "subtotal", keep: list[str] | None = None
) -> DataFrame:
    """Quote (type, value, exact and stored discount, total) for every sale.

    A sale below every threshold gets ``flat``, 0, 0.
    """
    keep = keep if keep is not None else sales.columns
    tiers, small = _evaluated(rules, as_of)
    matched = match_rule(sales, tiers, amount_col, checked=True) if small else match_rule_asof(sales, tiers, amount_col)
    return matched.select(*[F.col(c) for c in keep], F.col("rule_id"), *quote_columns(amount_col))


def tier_usage(sales: DataFrame, rules: DataFrame, as_of: dt.date, amount_col: str = "subtotal") -> DataFrame:
    """W4 + J10: the tiers with the number of sales each one applies to.

    Sales are reduced to one count per tier (partial aggregate), left-joined to
    the tier list so that unused tiers show 0.
    """
    tiers, small = _evaluated(rules, as_of)
    amounts = sales.select(amount_col)
    matched = match_rule(amounts, tiers, amount_col, checked=True) if small else match_rule_asof(amounts, tiers, amount_col)
    counts = matched.where(F.col("rule_id").isNotNull()).groupBy(F.col("rule_id").alias("_rid")).agg(F.count(F.lit(1)).alias("sales"))
    j = tiers.join(F.broadcast(counts) if small else counts, F.col("rule_id") == F.col("_rid"), "left")
    return j.select("rule_id", "rule_type", "rule_value", "lo", "hi", F.coalesce("sales", F.lit(0).cast("long")).alias("sales"))
