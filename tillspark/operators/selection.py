"""Order statistics by histogram passes: where in a total order a rank lies.

Each key column is read as a row of whole-number digits whose order is the
column's (a null flag, days, the number itself, six bytes of text at a time).
One pass counts the rows of the interval in hand in at most ``BUCKETS`` equal
parts and keeps the part that holds the rank; it ends when at most ``STOP`` rows
precede the rank in that part.  A pass reads the key columns only, shuffles one
count per bucket and task, and brings ``BUCKETS`` numbers to the driver, however
deep the rank: nothing is sorted, written or numbered.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillspark.functions.money import int_div

BUCKETS = 4096
STOP = 4096
TEXT_BYTES = 6  # of one digit


class Digit(NamedTuple):
    expr: Column  # long
    raw: Column  # what filters compare, pushed to the scan where possible
    literal: Callable[[int], Column]
    null_flag: bool = False


def _digits(col: str, kind: T.DataType, longest: Callable[[], int]) -> Iterator[Digit]:
    c = F.col(col)
    flag = c.isNotNull().cast("long")
    yield Digit(flag, flag, F.lit, True)  # a null sorts lowest
    if isinstance(kind, T.DateType):
        epoch = dt.date(1970, 1, 1)
        yield Digit(F.datediff(c, F.lit(epoch)).cast("long"), c, lambda v: F.lit(epoch + dt.timedelta(days=v)))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        n = c.cast("long")
        yield Digit(n, n if isinstance(kind, T.BooleanType) else c, F.lit)
    elif isinstance(kind, T.StringType):
        text = F.encode(c, "UTF-8")
        for at in range(0, longest(), TEXT_BYTES):
            part = F.rpad(F.hex(F.substring(text, at + 1, TEXT_BYTES)), 2 * TEXT_BYTES, "0")
            n = F.conv(part, 16, 10).cast("long")
            yield Digit(n, n, F.lit)
        n = F.length(text).cast("long")  # of texts equal but for final zero bytes
        yield Digit(n, n, F.lit)
    else:
        raise TypeError(f"no digits for a key of type {kind.simpleString()}")


def from_rank(df: DataFrame, keys: list[tuple[str, bool]], rank: int) -> tuple[DataFrame, int]:
    """(the rows of ``df`` from some key on, how many of them precede the row of
    0-based ``rank``): at most ``STOP``, unless that many rows have equal keys."""
    if rank <= STOP:
        return df, rank
    here = df.select(*[k for k, _ in keys])
    after: list[Column] = []  # rows beyond the interval in hand, one alternative a digit
    equal: list[Column] = []  # digits that are settled
    bound: Column | None = None  # the digit in hand: at or beyond the interval's begin
    for name, desc in keys:

        def longest(name: str = name) -> int:
            return here.agg(F.max(F.octet_length(name))).first()[0] or 0

        for digit in _digits(name, df.schema[name].dataType, longest):
            while True:
                low, high, n = here.agg(F.min(digit.expr), F.max(digit.expr), F.count(F.lit(1))).first()
                if rank >= n:
                    return df.limit(0), 0  # past the end
                if low == high:
                    break
                width = (high - low) // BUCKETS + 1
                span = digit.expr - F.lit(low) if high - low < 2**63 else digit.expr.cast("decimal(38,0)") - F.lit(low)
                counts = here.groupBy(int_div(span, F.lit(width)).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n"))
                for b, n in sorted(counts.collect(), reverse=desc):
                    if rank < n:
                        break
                    rank -= n
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                at, to = digit.literal(low), digit.literal(high)
                here = here.where((digit.raw >= at) & (digit.raw <= to))
                bound = digit.raw <= to if desc else digit.raw >= at
                if rank <= STOP:
                    return df.where(_any([*after, _all([*equal, bound])])), rank
                if low == high:
                    break
            settled = digit.literal(low)
            after.append(_all([*equal, digit.raw < settled if desc else digit.raw > settled]))
            equal.append(digit.raw == settled)
            if digit.null_flag and low == 0:
                break  # nulls have no further digits
    return df.where(_any([*after, _all(equal)])), rank


def _all(conds: list[Column]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out
