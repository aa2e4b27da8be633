"""Money expressions (F5-F8, F12-F14).  Money is whole rupiah in ``bigint``.

Every fractional amount is rounded half away from zero *before* it becomes
an integer (a plain cast truncates: 7500.5 -> 7500, the store keeps 7501).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(a: Column, b: Column | int) -> Column:
    """Exact integer division (SQL ``div``), floor for non-negative operands."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def round_money(x: Column | str) -> Column:
    """Half-away-from-zero rounding to whole rupiah as ``bigint``."""
    return F.round(_c(x), 0).cast("long")


def round_double(x: Column | str) -> Column:
    """``round_money`` of a double, without the decimal that ``round`` makes of every value.

    ``rint`` takes exact halves to the even neighbour; those are moved away from zero.
    """
    c = _c(x)
    near = F.rint(c)
    left = c - near  # exact
    away = F.when((c > 0) & (left == 0.5), 1).when((c < 0) & (left == -0.5), -1).otherwise(0)
    return near.cast("long") + away


def line_subtotal(qty: Column | str = "qty", price: Column | str = "price") -> Column:
    """``qty * price``."""
    return _c(qty).cast("long") * _c(price)


def change_due(paid: Column | str = "paid", total: Column | str = "total", floor_at_zero: bool = False) -> Column:
    """change returned; the cashier screen shows it floored at 0."""
    d = _c(paid) - _c(total)
    return F.greatest(F.lit(0).cast("long"), d) if floor_at_zero else d


def discount_raw(subtotal: Column, dtype: Column, value: Column, max_discount: Column) -> Column:
    """F7 before rounding (double): percent of subtotal, capped (a cap of 0
    or NULL means uncapped, percent rules only), clamped to the subtotal."""
    pct = subtotal * value / 100.0
    capped = F.when((max_discount > 0) & (pct > max_discount), max_discount.cast("double")).otherwise(pct)
    d = F.when(dtype == "percent", capped).otherwise(value.cast("double"))
    # least() skips NULLs: without a rule the discount is NULL, not the subtotal.
    return F.when(dtype.isNotNull(), F.least(d, subtotal.cast("double")))


def discount_amount(subtotal: Column, dtype: Column, value: Column, max_discount: Column) -> Column:
    """F7 as stored (bigint): the same rule in exact integer arithmetic.

    ``round(s*v/100)`` is ``(s*v + 50) div 100`` for non-negative amounts;
    ``s*v/100 > cap`` is ``s*v > cap*100``.  NULL ``dtype`` (no rule) -> 0.
    """
    sv = subtotal * value
    pct = F.when((max_discount > 0) & (sv > max_discount * 100), max_discount).otherwise(int_div(sv + 50, 100))
    d = F.when(dtype == "percent", pct).otherwise(value)
    # least() skips NULLs, so guard the no-rule case explicitly.
    return F.when(dtype.isNotNull(), F.least(d, subtotal)).otherwise(F.lit(0).cast("long"))


def discounted_total(subtotal: Column, dtype: Column, value: Column, max_discount: Column) -> Column:
    """F7 total as stored (bigint): subtotal minus the exact discount, rounded by
    itself, so at exact halves discount and total add up to one more than the
    subtotal.  Without a rule the subtotal."""
    sv = subtotal * value
    capped = (max_discount > 0) & (sv > max_discount * 100)
    # round half up of (100 s - s v) / 100 for non-negative amounts
    pct = F.when(capped, subtotal - max_discount).otherwise(int_div(subtotal * 100 - sv + 50, 100))
    left = F.when(dtype == "percent", pct).otherwise(subtotal - value)
    return F.when(dtype.isNotNull(), F.greatest(left, F.lit(0).cast("long"))).otherwise(subtotal)


def page_count(total_rows: Column | str, page_size: int = 10) -> Column:
    """``ceil(total / page_size)`` as bigint."""
    return int_div(_c(total_rows) + (page_size - 1), page_size)


def format_rupiah(x: Column | str) -> Column:
    """``Rp 1.234.568`` -- round half up first (``format_number`` alone is half-even)."""
    whole = F.round(_c(x), 0).cast("long")
    return F.concat(F.lit("Rp "), F.translate(F.format_number(whole, 0), ",", "."))


def parse_rupiah(s: Column | str) -> Column:
    """keep the digits of a formatted amount; nothing parsable -> 0."""
    digits = F.regexp_replace(_c(s), r"[^0-9]", "")
    return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))


_INT_PREFIX = r"^\s*([+-]?[0-9]+)"
_FLOAT_PREFIX = r"^\s*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)"


def parse_int(s: Column | str) -> Column:
    """lenient leading-integer parse (``parseInt``); no digits -> NULL (NaN)."""
    return F.regexp_extract(_c(s), _INT_PREFIX, 1).try_cast("long")


def parse_float(s: Column | str) -> Column:
    """lenient leading-number parse (``parseFloat``); no number -> NULL (NaN)."""
    return F.regexp_extract(_c(s), _FLOAT_PREFIX, 1).try_cast("double")
