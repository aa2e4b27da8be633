"""Label expressions (F1-F4, F19, F21): all built-in ``when``/``coalesce``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and status words that must equal the reference's output.
WALK_IN_LEDGER = "Umum"
WALK_IN_VIEW = "UMUM"
CASHIER_LEDGER = "Kasir"
CASHIER_EXPORT = "-"
BLANK = "-"
DEFAULT_UNIT = "pcs"
STATUS_OUT = "HABIS"
STATUS_LOW = "STOK MENIPIS"
STATUS_OK = "TERSEDIA"
MEMBER, NON_MEMBER = "Member", "Umum"
IN_STOCK, OUT_OF_STOCK = "Tersedia", "Habis"
ROLE_ADMIN, ROLE_CASHIER = "Administrator", "Kasir"
ACTIVE, INACTIVE = "Aktif", "Non-aktif"
PRODUCT_PREFIX = "Produk #"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label_or(c: Column | str, default: str) -> Column:
    """``COALESCE(c, default)``."""
    return F.coalesce(_c(c), F.lit(default))


def blank_or(c: Column | str, default: str = BLANK) -> Column:
    """empty string or NULL -> ``default`` (the client's ``x || '-'``)."""
    return F.coalesce(F.nullif(_c(c), F.lit("")), F.lit(default))


def stock_status(stock: Column | str = "stock", min_stock: Column | str = "min_stock") -> Column:
    """exactly 0 -> HABIS; <= minimum -> STOK MENIPIS; else (incl. NULL) TERSEDIA."""
    s, m = _c(stock), _c(min_stock)
    return F.when(s == 0, STATUS_OUT).when(s <= m, STATUS_LOW).otherwise(STATUS_OK)


def flag_label(cond: Column, yes: str, no: str) -> Column:
    """two-way label; a NULL condition takes the ``no`` branch."""
    return F.when(cond, F.lit(yes)).otherwise(F.lit(no))


def member_label(customer_id: Column | str = "customer_id") -> Column:
    c = _c(customer_id)
    return flag_label(c.isNotNull() & (c != 0), MEMBER, NON_MEMBER)


def availability_label(stock: Column | str = "stock") -> Column:
    return flag_label(_c(stock) > 0, IN_STOCK, OUT_OF_STOCK)


def role_label(role: Column | str = "role") -> Column:
    return flag_label(_c(role) == "admin", ROLE_ADMIN, ROLE_CASHIER)


def status_label(status: Column | str = "status") -> Column:
    return flag_label(_c(status) == "active", ACTIVE, INACTIVE)


def initial(c: Column | str) -> Column:
    """first character upper-cased (avatar letter)."""
    return F.upper(F.substring(_c(c), 1, 1))


def upper(c: Column | str) -> Column:
    """upper case (status badges)."""
    return F.upper(_c(c))


def title(c: Column | str) -> Column:
    """each blank-separated word capitalised, the rest in lower case."""
    return F.initcap(_c(c))


def product_label(name: Column | str, product_id: Column | str) -> Column:
    """name, or ``'Produk #<id>'`` when the name is missing or empty."""
    return F.coalesce(
        F.nullif(_c(name), F.lit("")),
        F.concat(F.lit(PRODUCT_PREFIX), _c(product_id).cast("string")),
    )
