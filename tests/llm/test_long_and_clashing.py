"""Very long texts, input columns named like outputs, and results that other tests
take from examples only, held against plain Python."""

import re

import numpy as np
import pytest
import xxhash
from test_operators import brute_fingerprint, frame, words

from tillspark.llm import decontaminate, langid, license_scan, secret_scan, sharding, simhash, suffix_dedup


def test_shards_are_drawn_uniformly(spark):
    """Over many seeds every row comes to every shard, and every pair of rows is apart as often as chance has it."""
    n, shards, runs = 24, 4, 60
    table = frame(spark, [f"text {i}" for i in range(n)])
    seen, together = np.zeros((n, shards)), 0
    for seed in range(runs):
        of = {r.doc_id: r.shard for r in sharding.shard_rows(table, shards, seed=seed, block_rows=5, cell_rows=3).select("doc_id", "shard").collect()}
        for i, s in of.items():
            seen[i, s] += 1
        together += sum(of[i] == of[j] for i in range(n) for j in range(i))
    expected = runs / shards
    chi = ((seen - expected) ** 2 / expected).sum()
    assert chi < n * (shards - 1) + 5 * (2 * n * (shards - 1)) ** 0.5
    pairs = n * (n - 1) / 2 * runs
    assert together / pairs == pytest.approx((n / shards - 1) / (n - 1))  # exact sizes


def test_long_texts_are_decontaminated_whole(spark):
    hit = words(40, 91)
    text = " ".join([*words(200_000, 92), *hit, *words(200_000, 93), *hit[5:25]])  # over 2 MiB
    bench = spark.createDataFrame([("a", " ".join(hit[3:30])), ("b", " ".join(words(30, 94)))], "item_id string, text string")
    rows = spark.createDataFrame([(1, text, "x", "y", "z", "w", "v")], "doc_id long, text string, n_words string, n_hit string, hit_windows string, items string, contaminated string")
    out = decontaminate.mark_contaminated(rows, bench)
    assert len(out.columns) == len(set(out.columns)) == 7
    r = out.collect()[0]
    assert r.n_words == 400_060 and r.n_hit == 27 + 20 and list(r["items"]) == ["a"] and r.contaminated is True


def test_long_texts_have_a_language(spark):
    rng = np.random.default_rng(9)
    vocabulary = {"xx": [f"{c}a{d}a" for c in "bcdf" for d in "ghjk"], "yy": [f"{c}o{d}u" for c in "lmnp" for d in "qrst"]}
    draw = lambda lang, n: " ".join(rng.choice(vocabulary[lang], n))
    rows = [(i, draw(lang, 30), lang) for i, lang in enumerate(["xx", "yy"] * 30)]
    long = [(1000, draw("yy", 5000) + " " + draw("xx", 150_000), None), (1001, "9 " * 400_000 + draw("yy", 3), None)]
    docs = spark.createDataFrame([(i, t, lang, "o", "p", "q") for i, t, lang in rows + long], "doc_id long, text string, lang string, held_out string, lang_pred string, score string")
    out = langid.identify_language(docs)
    assert sorted(out.columns) == ["doc_id", "held_out", "lang", "lang_pred", "score", "text"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[1000].lang_pred == "xx" and got[1001].lang_pred == "yy" and 0 < got[1000].score <= 1
    assert all(got[i].lang_pred == lang for i, _, lang in rows)


def test_language_scores_equal_a_plain_scorer(spark):
    """Every word by itself: known words by their row, unseen ones by the longest known n-grams."""
    rng = np.random.default_rng(10)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "er"], "cc": ["que", "ment", "oi"]}
    word = lambda lang: "".join(rng.choice(syllables[lang], rng.integers(1, 4)))
    labelled = [(" ".join(word(lang) for _ in range(12)), lang) for lang in syllables for _ in range(20)]
    model = langid.fit(spark.createDataFrame(labelled, "text string, lang string"))
    mixed = [" ".join(word(rng.choice(list(syllables))) for _ in range(int(n))) for n in rng.integers(1, 9, 60)]
    texts = [*mixed, "xyzzy", "Kalo, Schung!  unger", "日本 kalo", "12 3", "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("p", langid.predict("text", model, spark)).collect()
    for r in got:
        tokens = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        if not tokens:
            assert tuple(r.p) == ("und", 0.0)
            continue
        m = []
        for t in tokens:
            if t in model["tables"][0]:
                m.append(model["scores"][model["tables"][0][t]].astype(float))
            else:
                rows, factor = langid.backoff_rows(t, model["tables"])
                m.append(model["scores"][rows].sum(axis=0, dtype=float) * factor if rows else np.zeros(3))
        best = int(np.argmax(np.sum(m, axis=0)))
        post = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in m]
        assert r.p.lang == model["langs"][best] and r.p.score == pytest.approx(np.mean([p[best] for p in post]), abs=1e-5)


def test_nothing_learned_is_cut_by_rank(spark):
    """Each of 60,000 words seen once decides for its language."""
    rows = [(" ".join(f"{lang}{''.join(chr(97 + int(c)) for c in str(i))}" for i in range(30_000)), lang) for lang in ("p", "q")]
    model = langid.fit(spark.createDataFrame(rows * 1, "text string, lang string"), fit_chars=10**7)
    assert len(model["tables"][0]) == 60_000


def test_long_texts_have_a_simhash(spark):
    text = " ".join(words(70_000, 95, 10**6))
    rows = spark.createDataFrame([(1, text, "f", "c"), (2, text + " more", "f", "c"), (3, "other", "f", "c")], "doc_id long, text string, fingerprint string, component_id string")
    got = {r.doc_id: r for r in simhash.simhash_components(rows).collect()}
    assert got[1].fingerprint == f"{brute_fingerprint(text) % 2**64:016x}"
    assert got[1].component_id == got[2].component_id == 1 and got[3].component_id == 3


def test_outputs_replace_input_columns_of_their_names(spark):
    text = "password = hunter2hunter2 and more. Released under the MIT License."
    base = [(1, text), (2, "x" * 250), (3, "x" * 260)]
    table = lambda *names: spark.createDataFrame([(*r, *["old"] * len(names)) for r in base], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    secrets = secret_scan.scan_secrets(table("base_spans", "base_list", "SPAN_LIST", "kind")).collect()[0].asDict()
    assert secrets["kind"] == "old" and len(secrets["base_spans"]) == 1 and "SPAN_LIST" not in secrets
    cut = suffix_dedup.remove_repeats(table("n_bytes", "n_removed", "n_spans", "kept", "key", "lo", "hi", "d")).collect()
    by_id = {r.doc_id: r for r in cut}
    assert by_id[1].n_removed == 0 and by_id[2].n_removed == 250 and by_id[3].n_removed == 260 and by_id[1].key == by_id[1].lo == "old"
    found = license_scan.scan_licenses(table("n_sentences", "sentence_ids", "Licenses", "rules")).collect()[0].asDict()
    assert found["licenses"] == ["MIT"] and found["rules"] == "old" and "Licenses" not in found


def test_hash_of_python_and_spark_agree(spark):
    """The licence table is parted in Python by the hash that Spark looks up with."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("abc",), ("",), ("déjà vu",)], "s string").select("s", F.xxhash64("s").alias("h")).collect()
    assert {r.s: r.h % 2**64 for r in rows} == {r.s: xxhash.xxh64_intdigest(r.s.encode(), 42) for r in rows}


def test_language_scoring_holds_little_at_once():
    """Three workers of an executor score side by side; a chunk took 36 MB of arrays in each."""
    import tracemalloc

    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(2000)]
    tables = {k: {} for k in (0, *langid.GRAM_LENGTHS)} | {0: {w: i for i, w in enumerate(words[:1000])}}
    scorer = langid.Scorer({"langs": ["x", "y"], "tables": tables, "scores": np.ones((1000, 2), np.float32)})
    texts = [" ".join(words[:500] * 2) for _ in range(800)]
    tracemalloc.start()
    assert len(scorer.batch(texts)) == 800
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
