"""Date/time expressions and period resolution.

``as_of`` is always an explicit parameter, never ``current_date()``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_START = dt.date(1970, 1, 1)
INVOICE_PREFIX = "INV-"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period_bounds(period: str | None, as_of: dt.date) -> tuple[dt.date, dt.date]:
    """Today / week (8 days inclusive) / month-to-date / anything else = all.

    A missing period means ``month``; the end is always ``as_of`` so later
    (future-dated) rows never count.
    """
    period = "month" if period is None else period
    if period == "today":
        return as_of, as_of
    if period == "week":
        return as_of - dt.timedelta(days=7), as_of
    if period == "month":
        return as_of.replace(day=1), as_of
    return EPOCH_START, as_of


def display_date(date: Column | str, time: Column | str | None = None) -> Column:
    """``dd/MM/yyyy`` optionally followed by a blank and the time."""
    d = F.date_format(_c(date), "dd/MM/yyyy")
    return d if time is None else F.concat_ws(" ", d, _c(time))


def axis_label(date: Column | str) -> Column:
    """``MM-dd`` chart label."""
    return F.date_format(_c(date), "MM-dd")


MS_PER_DAY = 86_400_000


def sale_instant_millis(date: Column | str, time: Column | str) -> Column:
    """Epoch millis of a sale's date + ``HH:mm:ss`` time read as UTC.

    Pure arithmetic (days since epoch and seconds of day), so the result does
    not depend on ``spark.sql.session.timeZone``.
    """
    t = _c(time)
    secs = (
        F.substring(t, 1, 2).cast("long") * 3600
        + F.substring(t, 4, 2).cast("long") * 60
        + F.coalesce(F.substring(t, 7, 2).try_cast("long"), F.lit(0).cast("long"))
    )
    return F.unix_date(_c(date)).cast("long") * MS_PER_DAY + secs * 1000


def invoice_id(millis: Column | str) -> Column:
    """``INV-<epoch millis>``."""
    return F.concat(F.lit(INVOICE_PREFIX), _c(millis).cast("string"))


def invoice_millis(invoice_no: Column | str) -> Column:
    """F17 inverse: the millis encoded in an invoice number (NULL if not numeric)."""
    return F.substring(_c(invoice_no), len(INVOICE_PREFIX) + 1, 1 << 20).try_cast("long")


def clock_time(millis: Column | str, offset_minutes: int = 0) -> Column:
    """zero-padded ``HH:mm`` wall clock of an epoch-millis instant at a
    fixed UTC offset (0 = UTC); arithmetic, independent of the session zone."""
    from tillspark.functions.text import zero_pad

    ms_of_day = F.pmod(_c(millis) + F.lit(offset_minutes * 60_000), F.lit(MS_PER_DAY))
    minutes = F.floor(ms_of_day / 60_000).cast("long")
    return F.concat(zero_pad(F.floor(minutes / 60).cast("long"), 2), F.lit(":"), zero_pad(minutes % 60, 2))
