"""Operator 4 -- language identification by word-first backoff.

Training counts, per language, the words and the character n-grams (lengths 1
to 4, with word boundaries) of a bounded, documented sample of labelled texts.
A known word scores by its per-language log frequency; an unseen word by its
n-grams of the longest length at which any is known, falling back to shorter
ones.  A text's language is the one with the highest sum over all its words.

The counting is a Spark aggregation.  The model that tasks receive holds every
word and n-gram of the sample; nothing learned is dropped by rank.  Its size is
bounded by the sample: ``fit_rows`` texts per language, of which a text longer
than ``fit_chars`` characters teaches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillspark.llm.common import scratch_table, without
from tillspark.llm.decontaminate import Hasher

#: expected number of labelled rows per language that the model is fitted on
FIT_ROWS = 2_000
#: labelled texts longer than this are not fitted on (they are predicted whole)
FIT_CHARS = 1 << 17
GRAM_LENGTHS = (4, 3, 2, 1)
UNDETERMINED = "und"
#: marks both ends of a word in n-grams
EDGE = "_"
#: texts are scored together in chunks of about this many characters
CHUNK_CHARS = 1 << 16
SLOT_BITS = 20
#: weight of a backoff score against a known word's
BACKOFF = 0.5


def _words(text: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> dict:
    """(text, lang) -> model.  Rows with a null text or lang, or a text of more
    than ``fit_chars`` characters, teach nothing.

    The sample is Bernoulli by a hash of the text, at rate fit_rows / rows of
    the language: the same rows in every run, about ``fit_rows`` per language
    whatever the table's size; equal texts are in or out together and count once.
    """
    known = labelled.where(F.col("lang").isNotNull() & (F.length("text") <= fit_chars)).select("lang", "text")
    per_lang = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}  # one row per language
    if not per_lang:
        return {"langs": [], "tables": {k: {} for k in (0, *GRAM_LENGTHS)}, "scores": np.zeros((0, 0), np.float32)}
    rate = F.lit(0.0)
    for lang, n in sorted(per_lang.items()):
        rate = F.when(F.col("lang") == lang, min(1.0, fit_rows / n)).otherwise(rate)
    share = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    texts = known.where(share < rate).dropDuplicates(["lang", "text"])
    words = texts.select("lang", F.explode(_words(F.col("text"))).alias("t")).groupBy("lang", "t").agg(F.count(F.lit(1)).alias("n"))
    words = scratch_table(words)
    marked = F.concat(F.lit(EDGE), F.col("t"), F.lit(EDGE))
    tables_by_length = [words.select(F.lit(0).alias("k"), "lang", "t", "n")]
    for k in GRAM_LENGTHS:
        source = marked if k > 1 else F.col("t")
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(source) - k + 1))
        grams = words.where(F.length(source) >= k).select("lang", "n", F.explode(F.transform(starts, lambda i: F.substring(source, i, F.lit(k)))).alias("t"))
        tables_by_length.append(grams.groupBy("lang", "t").agg(F.sum("n").alias("n")).select(F.lit(k).alias("k"), "lang", "t", "n"))
    langs = sorted(per_lang)
    scores: list[np.ndarray] = []
    tables: dict[int, dict[str, int]] = {}
    held = 0
    for k, table in zip((0, *GRAM_LENGTHS), tables_by_length):
        counts = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).cast("long").alias(f"n{i}") for i, lang in enumerate(langs)]
        found = table.groupBy("t").agg(*counts).toArrow()  # bounded by the sample; columns, not rows, on the driver
        tokens = found.column("t").to_pylist()
        order = sorted(range(len(tokens)), key=tokens.__getitem__)
        n = np.array([found.column(f"n{i}").to_numpy() for i in range(len(langs))], np.float64).reshape(len(langs), len(tokens)).T[order]
        v = np.log((n + 0.5) / (n.sum(axis=0) + len(tokens) + 1))
        scores.append((v - v.max(axis=1, keepdims=True)).astype(np.float32) if len(tokens) else np.zeros((0, len(langs)), np.float32))  # only differences matter
        tables[k] = {tokens[j]: held + i for i, j in enumerate(order)}
        held += len(tokens)
    return {"langs": langs, "tables": tables, "scores": np.concatenate(scores)}


def backoff_rows(word: str, tables: dict, lengths: tuple[int, ...] = GRAM_LENGTHS) -> tuple[list[int], float]:
    """Rows of the score matrix that an unseen word sums, and the factor on
    their sum: its n-grams of the longest of ``lengths`` at which any is known,
    averaged over all its n-grams of that length and weighted by its letters (8
    at most).  With none known the word scores nothing."""
    marked = f"{EDGE}{word}{EDGE}"
    for k in lengths:
        source = marked if k > 1 else word
        n = len(source) - k + 1
        rows = [tables[k][g] for g in (source[i : i + k] for i in range(n)) if g in tables[k]]
        if rows:
            return rows, BACKOFF * min(len(word), 8) / n
    return [], 0.0


class Scorer:
    """Scores chunks of texts with numpy: known words by hash, unseen words by
    their longest n-grams; only words without a known one take the slow way."""

    def __init__(self, model: dict) -> None:
        self.langs, self.tables, self.scores = model["langs"], model["tables"], model["scores"]
        self.hasher = Hasher()
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.word_hash, self.word_row = self._hashes(self.tables[0], 0)
        self.gram_hash, self.gram_row = self._hashes(self.tables[GRAM_LENGTHS[0]], GRAM_LENGTHS[0])
        slot = (self.gram_hash >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slot = np.full(1 << SLOT_BITS, -1, np.int32)  # index of the only gram in a slot; -2: several
        self.slot[slot] = np.arange(len(slot))
        used, times = np.unique(slot, return_counts=True)
        self.slot[used[times > 1]] = -2

    def _codes(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def _hashes(self, table: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
        tokens = list(table)
        codes = self._codes("".join(t.replace(EDGE, "\0") for t in tokens))
        if k:
            flat = self.hasher.grams(codes.astype(np.uint64), k)[::k] if tokens else np.zeros(0, np.uint64)
        else:
            ends = np.cumsum([len(t) for t in tokens], dtype=np.int64)
            flat = self.hasher.words(codes, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if tokens else np.zeros(0, np.uint64)
        order = np.argsort(flat)
        return flat[order], np.fromiter(table.values(), np.int64, len(table))[order]

    @staticmethod
    def _find(sorted_hash: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Index in ``sorted_hash``, -1 where absent."""
        if not len(sorted_hash):
            return np.full(len(h), -1)
        at = np.searchsorted(sorted_hash, h)
        at[at == len(sorted_hash)] = 0
        return np.where(sorted_hash[at] == h, at, -1)

    def _gram_rows(self, h: np.ndarray) -> np.ndarray:
        at = self.slot[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.int64)
        several = np.flatnonzero(at == -2)
        at[several] = self._find(self.gram_hash, h[several])
        known = at >= 0
        rows = np.full(len(h), -1)
        if known.any():
            hit = np.flatnonzero(known)
            hit = hit[self.gram_hash[at[hit]] == h[hit]]
            rows[hit] = self.gram_row[at[hit]]
        return rows

    def chunk(self, texts: list[str]) -> list[tuple[str, float]]:
        joined = "\0" + "\0\0".join(t.lower() for t in texts) + "\0"
        codes = self._codes(joined)
        first = np.concatenate([[0], np.cumsum([len(t.lower()) + 2 for t in texts])])
        is_letter = self.letter[codes]
        codes = np.where(is_letter, codes, 0)
        edge = np.diff(is_letter.astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        bound = np.searchsorted(starts, first)
        n_langs, n_words = len(self.langs), len(starts)
        if not n_langs or not n_words:
            return [(UNDETERMINED, 0.0)] * len(texts)
        m = np.zeros((n_words, n_langs))
        at = self._find(self.word_hash, self.hasher.words(codes, starts, ends))
        seen = at >= 0
        m[seen] = self.scores[self.word_row[at[seen]]]
        k = GRAM_LENGTHS[0]
        unseen = np.flatnonzero(~seen)
        rows = self._gram_rows(self.hasher.grams(codes.astype(np.uint64), k))
        known = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(rows >= 0, out=known[1:])
        lo = starts[unseen] - 1
        hi = np.maximum(lo, np.minimum(ends[unseen] + 2 - k, len(rows)))  # one past the last n-gram of the word
        some = known[hi] > known[lo]
        length = ends[unseen] - starts[unseen]
        total = np.zeros(len(rows) + 1)
        for j in range(n_langs):
            column = np.append(self.scores[:, j], np.float32(0))  # row -1: nothing
            np.cumsum(column[rows], dtype=np.float64, out=total[1:])
            m[unseen, j] = (total[hi] - total[lo]) * BACKOFF * np.minimum(length, 8) / np.maximum(hi - lo, 1)
        for i in unseen[~some].tolist():
            m[i] = 0
            own, factor = backoff_rows(joined[starts[i] : ends[i]], self.tables, GRAM_LENGTHS[1:])
            if own:
                m[i] = self.scores[own].sum(axis=0) * factor
        post = np.exp(m - m.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        out = []
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
            if a == b:
                out.append((UNDETERMINED, 0.0))
            else:
                best = int(np.argmax(m[a:b].sum(axis=0)))  # the first of equals, in code-point order
                out.append((self.langs[best], min(1.0, float(post[a:b, best].mean()))))
        return out

    def batch(self, texts) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size >= CHUNK_CHARS:
                out += self.chunk(held)
                held, size = [], 0
        return out + (self.chunk(held) if held else [])


def predict(text: Column, model: dict, spark) -> Column:
    """struct(lang, score): the best language of the whole text and its
    probability, the mean over words of each word's posterior for it."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(held.value)
        for texts in batches:  # a text becomes a Python string only while its chunk is scored
            found = scorer.batch(t.as_py() for t in texts)
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in found], pa.string()), pa.array([r[1] for r in found], pa.float64())], names=["lang", "score"])

    return of(text)


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """True for rows that must not teach: crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify_language(docs: DataFrame, model: dict | None = None, **fit_options) -> DataFrame:
    """All rows of ``docs`` with ``held_out``, ``lang_pred`` and ``score``.

    Without a ``model`` one is fitted on the rows that are not held out.  Only
    the text enters a prediction.  Null texts and texts without a letter get
    ``und`` and score 0, as does every text when nothing could be learned;
    equal texts get equal results; ties go to the first language in order.  Texts are
    scored whole; a task holds about CHUNK_CHARS characters, or one longer text.
    Input columns named like the outputs are replaced.
    """
    rows = without(docs, "held_out", "lang_pred", "score", "__p")
    if model is None:
        model = fit(rows.where(~held_out(F.col("doc_id"))).select("text", "lang"), **fit_options)
    out = rows.withColumn("__p", predict(F.col("text"), model, docs.sparkSession))
    return out.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("__p.lang").alias("lang_pred"),
        F.col("__p.score").alias("score"),
    )
