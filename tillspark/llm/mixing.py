"""Operator 9 -- mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words.  A document's expected copies are its
odds weight times a level, at most ``max_copies``; the level is the one at which
the expected words of the source equal its target.  Whole copies are allocated for
certain; the fraction lambda that is left is the document's inclusion probability.
Documents of a source, whatever their lambda, are ranked by

    Q = [U / (1 - U)] / [lambda / (1 - lambda)]        (Pareto order sampling)

with U a hash of the row, and taken in rank order while their words fit what the
target lacks.  Documents longer than what is then left are passed over and the
others taken on in rank order; where these overshoot too, the next ``LOOKAHEAD``
in rank fill the rest one by one.  A fixed size in words, not in expectation.

By default a document's weight falls slowly with its length (``size_odds``), so
that a few long documents do not make up a source's sample.

The cut is found without gathering a source: ranks are bucketed, words are
summed per (source, bucket) with map-side partial sums, and only the one
bucket that holds a cut is resolved by single ranks.  The result per source is
two thresholds on Q and the few ranks taken beyond them, so every row is decided
where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillspark.llm.common import scratch_table, without
from tillspark.operators.joins import broadcast_bounded

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
MAX_WEIGHT = 1000
#: ranks beyond the first overshooting one that may fill the rest of a target
LOOKAHEAD = 64
#: buckets are sized so that one holds about this many documents of the whole table
BUCKET_ROWS = 4_000
SOURCE_BROADCAST_ROWS = 100_000


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\t \\n \\v \\f \\r; null counts 0.

    A run starts at a non-space whose left neighbour is a space or the start.
    """
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, n_docs) -> plus ``target``: one row per source.

    Sources in code-point order, null last, weigh ``weights`` repeating; they
    share the sum of all sizes; a target stops at ``max_copies`` times its
    source's size and the excess is reshared by weight.  Closed form: in order
    of cap / weight, the first k sources are capped, where k is the first index
    at which the common level no longer exceeds cap / weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    total = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * max_copies)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = (
        t.withColumn("all_words", F.sum("source_size").over(total))
        .withColumn("left_words", F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_w", F.sum("w").over(total) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("open", F.col("left_words") * F.col("w") <= F.col("cap") * F.col("left_w"))
        .withColumn("pos", F.row_number().over(order))
    )
    t = t.withColumn("first_open", F.min(F.when(F.col("open"), F.col("pos"))).over(total))
    t = t.withColumn("level_words", F.max(F.when(F.col("pos") == F.col("first_open"), F.col("left_words"))).over(total))
    t = t.withColumn("level_w", F.max(F.when(F.col("pos") == F.col("first_open"), F.col("left_w"))).over(total))
    capped = F.col("first_open").isNull() | (F.col("pos") < F.col("first_open"))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(
        (F.col("w") * F.col("level_words")).cast("double") / F.col("level_w").cast("double")
    )
    return t.select("source", "source_size", "n_docs", target.alias("target"))


def size_odds(size: Column) -> Column:
    """Odds weight 19 for a word or none down to 4 for 32,768 words and more: one less for each doubling."""
    return F.lit(20) - F.least(F.lit(16), F.length(F.bin(size)))


def expected_copies(classes: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, weight, words) and targets -> plus ``copies``: min(max_copies,
    level * weight), with the level at which a source's words come to its target.

    Closed form: in falling order of weight the first k classes are capped, where
    k is the first index at which the level no longer lifts the next one above
    the cap.  A source has at most ``MAX_WEIGHT`` classes.
    """
    t = targets.select(F.col("source").alias("__s"), "source_size", "target")
    c = classes.join(broadcast_bounded(t, SOURCE_BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    order = Window.partitionBy("source").orderBy(F.desc("weight"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("source")
    weighted = F.col("weight") * F.col("words")
    c = c.withColumns(
        {
            "capped": max_copies * F.coalesce(F.sum("words").over(before), F.lit(0)),
            "open_words": F.sum(weighted).over(all_) - F.coalesce(F.sum(weighted).over(before), F.lit(0)),
        }
    )
    level = F.when(F.col("open_words") > 0, (F.col("target") - F.col("capped")) / F.col("open_words").cast("double"))
    c = c.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= max_copies, F.struct((-F.col("weight")).alias("w"), F.col("level").alias("level")))
    c = c.withColumn("first", F.min(fits).over(all_))
    copies = (
        F.when(F.col("source_size") <= 0, 0.0)
        .when(F.col("first").isNull() | (F.col("weight") > -F.col("first.w")), float(max_copies))
        .otherwise(F.col("first.level") * F.col("weight"))
    )
    return c.select("source", "weight", "words", "source_size", "target", copies.alias("copies"))


def uniform_draw(seed: int, doc_id: Column, text: Column) -> Column:
    """U in (0, 1) with 52 bits, from MD5 of (seed, doc_id, text): equal rows draw equally."""
    mark = F.concat_ws("|", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    bits = F.conv(F.substring(F.md5(mark), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def _after(bucket: str, last: str) -> Column:
    """Ranks (__b, __q) beyond a cut: its bucket and the last rank taken in it (null: none)."""
    return (F.col("__b") > F.col(bucket)) | ((F.col("__b") == F.col(bucket)) & F.coalesce(F.col("__q") > F.col(last), F.lit(True)))


def _cut(units: DataFrame) -> DataFrame:
    """Units (__src, __need, __b, __q, n) -> (__cs, __cb, __lq, __left) of each source whose units exceed
    its need: the bucket and last rank up to which they fit, and what they leave open."""
    sums = units.groupBy("__src", "__need", "__b").agg(F.sum("n").alias("__words"))
    upto = Window.partitionBy("__src").orderBy("__b")
    bucket = (
        sums.withColumn("__cum", F.sum("__words").over(upto))
        .where(F.col("__cum") > F.col("__need"))
        .groupBy("__src", "__need")
        .agg(F.min_by(F.struct("__b", (F.col("__cum") - F.col("__words")).alias("base")), F.col("__b")).alias("__cut"))
        .select(F.col("__src").alias("__cs"), F.col("__need").alias("__cn"), F.col("__cut.__b").alias("__cb"), F.col("__cut.base").alias("__base"))
    )
    bucket = scratch_table(bucket)
    at = F.col("__src").eqNullSafe(F.col("__cs"))
    inside = units.join(broadcast_bounded(bucket, SOURCE_BROADCAST_ROWS), at & (F.col("__b") == F.col("__cb")))
    cum = F.col("__base") + F.sum("n").over(Window.partitionBy("__src").orderBy("__q"))
    fits = F.when(F.col("__cum") <= F.col("__need"), F.struct("__q", "__cum"))
    last = inside.withColumn("__cum", cum).groupBy("__src").agg(F.max(fits).alias("__last"))
    return bucket.join(last, F.col("__src").eqNullSafe(F.col("__cs"))).select(
        "__cs", "__cb", F.col("__last.__q").alias("__lq"), (F.col("__cn") - F.coalesce("__last.__cum", "__base")).alias("__left")
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = 42,
    weight_col: str | None = None,
    bucket_rows: int = BUCKET_ROWS,
    lookahead: int = LOOKAHEAD,
) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``copies`` is how often the mix takes the row (0 .. max_copies) and
    ``taken = copies * size``.  A source's taken words do not exceed its target,
    and miss it by less than the least unit among the ``lookahead`` ranks after the
    second cut (a unit is a document, or all rows equal in doc_id and text, which share a
    draw and are taken or left together), unless its documents run out.
    ``weight_col`` holds odds weights, rounded to 1 .. MAX_WEIGHT (null: 1); without
    it they follow from the size.

    Null text has size 0; null source is a source of its own, last in order;
    null doc_id draws by its text.  Rows of size 0, and sources of size 0, are
    taken 0 words (their fractional copies are drawn like any other).  Sizes count
    whole texts of any length.  An empty table gives an empty result.  Input columns
    named like the outputs are replaced, all others pass through.
    """
    rows = without(docs, "size", "source_size", "target", "copies", "taken", "__u", "__w")
    sized = rows.withColumn("size", word_count(F.col("text"))).withColumn("__u", uniform_draw(seed, F.col("doc_id"), F.col("text")))
    if weight_col is None:
        weight = size_odds(F.col("size"))
    else:
        given = F.round(F.col(weight_col).cast("double"))
        weight = F.when(F.isnan(given), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(MAX_WEIGHT), F.coalesce(given, F.lit(1)))))
    sized = sized.withColumn("__w", weight.cast("int"))
    # the decisions need four narrow columns only: computed once, kept in the shared folder
    narrow = scratch_table(sized.select("source", "size", "__u", "__w"))
    classes = scratch_table(
        narrow.groupBy("source", F.col("__w").alias("weight")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n_docs"))
    )
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n_docs").alias("n_docs"))
    targets = scratch_table(source_targets(sizes, weights, max_copies))
    copies = expected_copies(classes.drop("n_docs"), targets, max_copies)
    plan = copies.select(
        F.col("source").alias("__src"),
        F.col("weight").alias("__pw"),
        "words",
        "source_size",
        "target",
        F.floor("copies").cast("int").alias("__whole"),
        (F.col("copies") - F.floor("copies")).alias("__lambda"),
    )
    per_source = plan.groupBy("__src", "source_size", "target").agg(
        F.sum(F.col("__whole") * F.col("words")).alias("__sure"),
        F.sum(F.when(F.col("__lambda") > 0, F.col("words")).otherwise(0)).alias("__drawn"),
    )
    need = F.col("target") - F.col("__sure")
    # the source's mean odds bring its ranks to an even spread over the buckets
    mean = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), need / F.greatest(F.col("__drawn"), F.lit(1))))
    heads = scratch_table(per_source.select("__src", need.alias("__need"), (mean / (1 - mean)).alias("__odds")))
    plan = scratch_table(plan.join(heads.withColumnRenamed("__src", "__hs"), F.col("__src").eqNullSafe(F.col("__hs"))).drop("__hs", "words"))
    total = targets.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // bucket_rows))

    def ranked(df: DataFrame) -> DataFrame:
        """With whole copies, rank and bucket (null without a fraction to draw)."""
        lam, u = F.col("__lambda"), F.col("__u")
        q = F.when(lam > 0, (u / (1 - u)) / (lam / (1 - lam)))
        s = F.col("__q") * F.col("__odds")
        same = F.col("source").eqNullSafe(F.col("__src")) & (F.col("__w") == F.col("__pw"))
        return (
            df.join(broadcast_bounded(plan, SOURCE_BROADCAST_ROWS), same)
            .withColumn("__q", q)
            .withColumn("__b", F.floor(s / (1 + s) * buckets).cast("long"))
        )

    draws = ranked(narrow).where("__q IS NOT NULL")
    units = scratch_table(draws.groupBy("__src", "__need", "__b", "__q").agg(F.max("size").alias("size"), F.sum("size").alias("n")))
    first = scratch_table(_cut(units))
    at_cut = F.col("__src").eqNullSafe(F.col("__cs"))
    # in rank order beyond the cut, what does not overshoot by itself
    passed = units.join(broadcast_bounded(first, SOURCE_BROADCAST_ROWS), at_cut & _after("__cb", "__lq") & (F.col("size") <= F.col("__left")))
    second = _cut(passed.select("__src", F.col("__left").alias("__need"), "__b", "__q", "size", "n"))
    second = second.toDF("__cs2", "__cb2", "__lq2", "__left2")
    cuts = scratch_table(first.join(second, F.col("__cs").eqNullSafe(F.col("__cs2")), "left").drop("__cs2"))
    # the ranks after that cut fill what is left
    beyond = units.join(broadcast_bounded(cuts.where("__cb2 IS NOT NULL"), SOURCE_BROADCAST_ROWS), at_cut & _after("__cb", "__lq"))
    beyond = beyond.where(_after("__cb2", "__lq2") & (F.col("size") <= F.col("__left"))).select("__src", F.col("__left2").alias("__left"), "__q", "n")
    by_rank = Window.partitionBy("__src").orderBy("__q")
    near = beyond.withColumn("__rank", F.row_number().over(by_rank)).where(F.col("__rank") <= lookahead)
    listed = near.groupBy("__src", "__left").agg(F.array_sort(F.collect_list(F.struct("__q", "n"))).alias("units"))  # at most ``lookahead``
    start = F.struct(F.col("__left").cast("double").alias("left"), F.array().cast("array<double>").alias("chosen"))
    step = lambda acc, x: F.when(
        x["n"] <= acc["left"], F.struct((acc["left"] - x["n"]).alias("left"), F.array_append(acc["chosen"], x["__q"]).alias("chosen"))
    ).otherwise(acc)
    filled = listed.select(F.col("__src").alias("__fs"), F.aggregate("units", start, step)["chosen"].alias("__more"))
    decided = scratch_table(cuts.join(filled, F.col("__cs").eqNullSafe(F.col("__fs")), "left").drop("__fs", "__left2"))
    joined = ranked(sized).join(broadcast_bounded(decided, SOURCE_BROADCAST_ROWS), at_cut, "left")
    q = F.col("__q")
    again = (F.col("size") <= F.col("__left")) & (F.col("__cb2").isNull() | ~_after("__cb2", "__lq2"))
    taken = F.col("__cb").isNull() | ~_after("__cb", "__lq") | again | F.coalesce(F.array_contains("__more", q), F.lit(False))
    extra = F.when(q.isNotNull() & taken, 1).otherwise(0)
    return joined.withColumn("copies", (F.col("__whole") + extra).cast("int")).select(
        *[F.col(f"`{c}`") for c in rows.columns],
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )
