"""Text expressions (F15, F16, search patterns for P10/P11)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed by the reference's trim (space, tab, LF, CR, VT).
TRIM_CHARS = " \t\n\r\x0b"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """trim surrounding whitespace."""
    return F.btrim(_c(c), F.lit(TRIM_CHARS))


def digest(c: Column | str) -> Column:
    """F16: hex md5 of a string column (a generic digest, not a password scheme)."""
    return F.md5(_c(c))


def is_blank_param(text: str | None) -> bool:
    """PHP ``empty()``: NULL, empty string and ``"0"`` disable a filter."""
    return text is None or text == "" or text == "0"


def contains_pattern(text: str) -> str:
    """``%text%``; ``%``/``_`` inside ``text`` stay live wildcards, as in the reference."""
    return f"%{text}%"


def _accent_table() -> tuple[str, str]:
    """Lower-case letters that are an ASCII letter plus marks, and those letters,
    from the Unicode decompositions of the Latin blocks."""
    marked, plain = [], []
    for point in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(point))
        if marks and base.isascii() and base.islower() and all(unicodedata.combining(m) for m in marks):
            marked.append(chr(point))
            plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _accent_table()


def fold(c: Column | str) -> Column:
    """Text without case and accents, as the reference's ``general_ci`` compares.

    An ICU collation (``UNICODE_CI_AI``) decides equality the same way, but it has
    no ``LIKE`` with wildcards, cannot key streaming state, and would leak a
    collated type; a folded binary string serves joins, groups, state and ``LIKE``
    alike.  Only texts with other than ASCII characters pay for the folding.
    """
    low = F.lower(_c(c))
    return F.when(F.length(low) == F.octet_length(low), low).otherwise(F.translate(low, _MARKED, _PLAIN))


def search_match(c: Column | str, text: str) -> Column:
    """P10: substring match regardless of case and accents; wildcards stay live."""
    return fold(c).like(contains_pattern(text).lower().translate(str.maketrans(_MARKED, _PLAIN)))


def zero_pad(n: Column | str, width: int) -> Column:
    """Decimal text of a non-negative integer, left-padded with zeros to
    ``width`` (like ``%0<width>d``: longer numbers are kept whole)."""
    s = _c(n).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def ci_key(c: Column | str) -> Column:
    """Comparison key of the reference's ``general_ci`` equality: case, accents and
    trailing blanks do not matter (used for GROUP BY name and UNIQUE keys)."""
    return fold(F.rtrim(_c(c)))
