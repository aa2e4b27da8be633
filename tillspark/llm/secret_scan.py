"""Operator 5 -- secret scans by sliding-window entropy, in SQL functions only.

Base kinds are found by pattern (leftmost, non-overlapping).  The method adds
spans: candidate strings of a character class (hex, base64) are read with a
sliding window; the window's Shannon entropy is kept by incremental counts
(the entering and the leaving character each change one count), and each
stretch covered by windows at or above the class's threshold is a span.  Base
spans are cut out of the candidates first, and windows that hold a character of
an allow-list match do not count.

Long candidates are read in pieces of ``PIECE`` characters that overlap by one
window less one character, so that no window is missed and cost stays linear;
stretches that meet at a piece's border are joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.common import text_or_empty, without

WINDOW = 20
PIECE = 2048
#: (kind, pattern, least length of group 2 or None)
BASE_KINDS = [
    (
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
    ),
    ("access", r"AKIA[A-Z0-9]{14,}", None),  # 18 characters in all
    ("hex", r"[0-9a-f]{16,}", None),
]
#: (kind, candidate pattern, what a candidate must hold, what it must not be, bits of entropy)
ENTROPY_CLASSES = [
    ("entropy_hex", r"[0-9a-fA-F]{20,}", r"(?=.*[0-9])(?=.*[A-Fa-f])", None, 3.0),
    ("entropy_base64", r"[A-Za-z0-9+/_=-]{20,}", r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", r"^[0-9a-fA-F]+$", 3.8),
]
#: harmless high-entropy strings: placeholders, alphabets, one-digit fillers, dates and versions
ALLOWED = r"(?i)example|sample|placeholder|dummy|changeme|0123456789|abcdefghij|(.)\1{7}|^[0-9_/=+-]+$"
#: the same for a part of a string and for a whole window
ALLOWED_PART = ALLOWED.replace("{7}", "{7,}").removesuffix(r"|^[0-9_/=+-]+$")
ALLOWED_WINDOW = r"^[0-9_/=+-]+$"
#: stands for a character that no window may hold
MASK = "\u0001"
SPAN = "struct<start:int,end:int,rank:int,kind:string>"


def _matches(text: Column, pattern: str, group: int | None) -> Column:
    """array<struct(start, end, hit, size)>: all matches with their code-point offsets.

    The pieces between matches and the matches themselves alternate, so their
    lengths give the offsets.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = hits if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.arrays_zip(hits.alias("hit"), sized.alias("sized"), gaps.alias("gap"))
    empty = F.array().cast("array<struct<start:int,end:int,hit:string,size:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), F.length(x["sized"]).alias("size"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    # the last piece has no match after it
    real = F.slice(found, F.lit(1), F.size(hits))
    scan = F.aggregate(real, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), scan).otherwise(empty)


def _count(s: Column, ch: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, ch, F.lit("")))


def _masked(c: Column, spans: Column) -> Column:
    """``c`` with MASK in place of every character of ``spans`` (sorted by start)."""

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(c, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        fill = F.repeat(F.lit(MASK), F.greatest(x["end"] - F.greatest(acc["at"], x["start"]), F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap, fill).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(c, acc["at"] + 1, F.length(c))))


def _dense_stretches(c: Column, window: int, bits: float) -> Column:
    """array<struct(first, last)>: the stretches of ``c`` covered by windows
    whose entropy reaches ``bits`` (last exclusive)."""
    f = F.array(*[F.lit(0.0 if n < 2 else n * math.log2(n)) for n in range(window + 2)])
    at = lambda n: F.element_at(f, n + 1)
    least = F.lit(window * (math.log2(window) - bits) + 1e-9)  # H >= bits  <=>  sum n log2 n <= least
    one = lambda acc: F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    def step(acc: Column, i: Column) -> Column:
        full = i >= window  # the window before this step was full: its first character leaves
        before = F.substring(c, F.greatest(i - window, F.lit(0)) + 1, F.least(i, F.lit(window)))
        leaving, entering = F.substring(before, F.lit(1), F.lit(1)), F.substring(c, i + 1, F.lit(1))
        rest = F.when(full, F.substring(before, F.lit(2), F.lit(window - 1))).otherwise(before)
        n_out, n_in = _count(before, leaving), _count(rest, entering)
        total = acc["total"] - F.when(full, at(n_out) - at(n_out - 1)).otherwise(0.0) + at(n_in + 1) - at(n_in)
        free = F.when(entering == MASK, 0).otherwise(acc["free"] + 1)  # characters since the last masked one
        dense = (free >= window) & (total <= least) & ~F.concat(rest, entering).rlike(ALLOWED_WINDOW)
        apart = dense & (i - window + 1 > acc["last"])
        return F.struct(
            total.alias("total"),
            free.alias("free"),
            F.when(dense & (acc["last"].isNull() | apart), i - window + 1).otherwise(acc["first"]).alias("first"),
            F.when(dense, i + 1).otherwise(acc["last"]).alias("last"),
            F.when(apart, F.concat(acc["out"], one(acc))).otherwise(acc["out"]).alias("out"),
        )

    none = F.lit(None).cast("int")
    empty = F.array().cast("array<struct<first:int,last:int>>")
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("free"), none.alias("first"), none.alias("last"), empty.alias("out"))
    end = lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one(acc)))
    return F.aggregate(F.sequence(F.lit(0), F.length(c) - 1), start, step, end)


def _joined(spans: Column) -> Column:
    """``spans`` in order, those that overlap or touch as one."""
    kept = lambda acc: F.slice(acc, F.lit(1), F.size(acc) - 1)

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, F.greatest(F.size(acc), F.lit(1)))
        both = F.struct(last["start"].alias("start"), x["end"].alias("end"), x["rank"].alias("rank"), x["kind"].alias("kind")).cast(SPAN)
        meets = (F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.size(acc))["end"])
        return F.when(F.size(acc) == 0, F.array(x)).when(meets, F.concat(kept(acc), F.array(both))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(spans, F.array().cast(f"array<{SPAN}>"), step)


def _entropy_spans(hits: Column, kind: str, rank: int, pattern: str, must: str, must_not: str | None, bits: float) -> Column:
    wanted = lambda x: x["hit"].rlike(must) & (F.lit(True) if must_not is None else ~x["hit"].rlike(must_not))
    part = lambda start, hit: F.struct(start.cast("int").alias("start"), hit.alias("hit"))

    def rests(x: Column) -> Column:
        """What base spans leave of a candidate: candidates in their own right."""
        over = F.filter("base_spans", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        own = F.transform(
            over,
            lambda b: F.struct(
                F.greatest(b["start"] - x["start"], F.lit(0)).alias("start"), (F.least(b["end"], x["end"]) - x["start"]).alias("end")
            ),
        )
        left = _matches(_masked(x["hit"], F.array_sort(own)), pattern, None)
        return F.when(F.size(over) == 0, F.array(part(x["start"], x["hit"]))).otherwise(
            F.transform(left, lambda m: part(x["start"] + m["start"], m["hit"]))
        )

    def stretches(x: Column) -> Column:
        allowed = F.transform(_matches(x["hit"], ALLOWED_PART, None), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
        text = F.when(x["hit"].rlike(ALLOWED_PART), _masked(x["hit"], allowed)).otherwise(x["hit"])
        cut = F.regexp_extract_all(text, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
        whole = F.transform(
            cut,
            lambda p, i: F.struct(
                (x["start"] + i * PIECE - F.when(i > 0, WINDOW - 1).otherwise(0)).alias("start"),
                F.concat(F.when(i > 0, F.right(F.element_at(cut, F.greatest(i, F.lit(1))), F.lit(WINDOW - 1))).otherwise(""), p).alias("hit"),
            ),
        )
        spans = F.transform(
            whole,
            lambda p: F.transform(
                _dense_stretches(p["hit"], WINDOW, bits),
                lambda d: F.struct(
                    (p["start"] + d["first"]).alias("start"), (p["start"] + d["last"]).alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")
                ).cast(SPAN),
            ),
        )
        return _joined(F.flatten(spans))

    likely = F.filter(hits, lambda x: x["hit"].rlike(must))
    return F.flatten(F.transform(F.filter(F.flatten(F.transform(likely, rests)), wanted), stretches))


def _base_spans(hits: Column, kind: str, rank: int, least: int) -> Column:
    span = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))
    return F.transform(F.filter(hits, lambda x: x["size"] >= least), lambda x: span(x).cast(SPAN))


def _listed(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(F.array_sort(spans), one))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with ``base_spans`` and ``added_spans`` (arrays of
    start, end, rank, kind; code points, end exclusive), ``base_list`` and
    ``span_list`` (``kind:start:end`` by start, then kind, comma-joined).

    Null text is empty and has no span; repeated rows are scanned alike; whole
    texts of any length are read.  Spans of one start are listed in the order
    of the kinds.  An empty table gives an empty result; input columns named
    like the outputs are replaced.
    """
    rows = without(docs, "base_spans", "added_spans", "base_list", "span_list")
    text = text_or_empty("text")
    step = rows
    base = []
    for rank, (kind, pattern, least) in enumerate(BASE_KINDS):
        name = f"__hits_{kind}"
        step = step.withColumn(name, _matches(text, pattern, None if least is None else 2))
        base.append(_base_spans(F.col(name), kind, rank, least or 0))
    for kind, pattern, *_ in ENTROPY_CLASSES:
        step = step.withColumn(f"__hits_{kind}", _matches(text, pattern, None))
    step = step.withColumn("base_spans", F.concat(*base))
    added = [
        _entropy_spans(F.col(f"__hits_{kind}"), kind, len(BASE_KINDS) + i, pattern, must, must_not, bits)
        for i, (kind, pattern, must, must_not, bits) in enumerate(ENTROPY_CLASSES)
    ]
    step = step.withColumn("added_spans", F.concat(*added))
    step = step.withColumns({"base_list": _listed(F.col("base_spans")), "span_list": _listed(F.concat("base_spans", "added_spans"))})
    return step.select(*[F.col(f"`{c}`") for c in rows.columns], "base_spans", "added_spans", "base_list", "span_list")
