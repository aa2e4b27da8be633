"""HyperMinHash near-duplicates, embedding whitening and periodic runs against
brute force, with the edge cases that each operator defines."""

import collections
import itertools

import numpy as np
import pytest

from tillspark.llm import minhash, periodic, whitening

SCHEMA = "doc_id long, text string, n_shingles string, component_id string, kept string, runs string, key long"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y", "z", "r", 5) for i, t in zip(ids, texts)], SCHEMA)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute_components(rows, k, percent):
    """(id, text) rows -> (set size, least id of the component) per row."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            root[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[find(i)].append(key)
    return [(len(s), (min(ids[find(i)]) if ids[find(i)] else None) if s else rows[i][0]) for i, s in enumerate(sets)]


def mutated(words, rng, share):
    return [f"m{rng.integers(10**6)}" if rng.random() < share else w for w in words]


def near_copies():
    rng = np.random.default_rng(7)
    texts = [None, "", " \n\t", "one", "ONE", "two words", "Two  words\n", "!!! 12", "déjà vu " * 30]
    for size in (3, 12, 40, 150):
        base = [f"w{x}" for x in rng.integers(0, 5000, size)]
        texts += [" ".join(mutated(base, rng, s)) for s in (0, 0, 0.02, 0.04, 0.06, 0.1, 0.3)]
    base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
    texts += [" ".join(mutated(base, rng, 0.06)) for _ in range(120)]  # one crowded bucket, links and near misses
    texts.append(" ".join(f"w{x}" for x in rng.integers(0, 300, 30_000)))  # very long
    return texts


@pytest.mark.parametrize("tile_bytes", [1 << 22, 1 << 13])
def test_minhash_components_equal_brute_force(spark, monkeypatch, tile_bytes):
    monkeypatch.setattr(minhash, "TILE_BYTES", tile_bytes)
    texts = near_copies()
    ids = [i * 7 % 1009 for i in range(len(texts))]
    ids[20] = None  # a null id
    ids[31] = ids[30]  # an id of two rows
    got = minhash.minhash_components(frame(spark, texts, ids), 2, keep=["key"]).collect()
    want = brute_components(list(zip(ids, texts)), 2, 80)
    expected = collections.Counter((i, 5, n, c, i == c) for i, (n, c) in zip(ids, want))
    assert collections.Counter((r.doc_id, r.key, r.n_shingles, r.component_id, r.kept) for r in got) == expected
    sizes = collections.Counter(c for _, c in want)
    assert sizes.most_common(1)[0][1] > 30 and len(sizes) > 25


def test_minhash_defaults_are_five_words(spark):
    base = [f"w{i}" for i in range(100)]
    near, far = [*base[:50], "x", *base[51:]], [w if i % 20 else "x" for i, w in enumerate(base)]
    texts = [" ".join(w) for w in (base, near, far)]
    got = {r.doc_id: r.component_id for r in minhash.minhash_components(frame(spark, texts)).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute_components(list(enumerate(texts)), 5, 80))} == {0: 0, 1: 0, 2: 2}


def test_minhash_keeps_columns_of_any_name(spark):
    names = ["d1", "d2", "n", "regs", "key", "root", "bucket", "component_id", "KEPT"]
    rows = spark.createDataFrame([(i, "a b c", *["x"] * len(names)) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = minhash.minhash_components(rows, 2, keep=names)
    assert out.columns == ["doc_id", *names[:7], "n_shingles", "component_id", "kept"]
    assert [(r.key, r.component_id) for r in out.collect()] == [("x", 0)] * 3


def test_minhash_only_null_ids_and_empty_table(spark):
    rows = minhash.minhash_components(frame(spark, ["a b", "a b", None], [None] * 3), 2).collect()
    assert [(r.n_shingles, r.component_id, r.kept) for r in sorted(rows, key=lambda r: r.n_shingles)] == [(0, None, True), (1, None, True), (1, None, True)]
    assert minhash.minhash_components(frame(spark, []), 2).collect() == []


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    agree, sizes, true = [], [], []
    for n in (2, 5, 30, 400, 9000):
        for share in (0.5, 0.8, 0.95):
            both = max(1, round(n * share))
            h = np.unique(rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64))
            a, b = h[:n], np.concatenate([h[:both], h[n:]])
            x, y = minhash.sketch(a), minhash.sketch(b)
            assert (minhash.sketch(a[::-1]) == x).all()
            agree.append((x == y).sum())
            sizes.append((len(a), len(b)))
            true.append(both / (2 * n - both))
    a, b = np.array(sizes).T
    assert np.abs(minhash.estimate(np.array(agree), a, b) - true).max() < 0.14
    # the registers keep the order of magnitude of the least hash: two unrelated sets agree as often as the correction says
    x = np.array([minhash.sketch(rng.integers(0, 1 << 63, 50, dtype=np.uint64)) for _ in range(400)])
    seen = (x[:200] == x[200:]).mean()
    assert abs(seen - minhash.accidental(np.array([50]), np.array([50]))[0]) < 2e-4 and seen > 0


VECTORS = "vec_id long, embedding array<float>, component string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)


def brute_whitening(rows, dim):
    usable = [(i, v) for i, v in rows if v and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in usable], np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in usable], n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ axes[:, ::-1] / np.sqrt(np.abs(values[::-1])), values[::-1]


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(20, 20))
    data = (rng.normal(size=(300, 20)) @ mix).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(1000 + i, data[0].tolist()) for i in range(150)]  # a third of the rows is one vector
    rows += [(7, data[1].tolist()), (None, data[2].tolist())]
    bad = [(2000, None), (2001, []), (2002, [None] * 20), (2003, [float("nan")] * 20), (2004, [float("inf")] * 20), (2005, [1.0] * 19), (2006, [3e38] * 20)]
    got = whitening.whiten(vectors(spark, rows + bad)).toPandas()
    ids, n, deviation, whitened, values = brute_whitening(rows, 20)
    assert set(got.n) == {n} and len(got) == 16 * len(ids)
    assert sorted(set(got.component)) == list(range(1, 17))
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    share = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.allclose(share, values[:16] / values.sum(), rtol=1e-9)
    by_id = collections.defaultdict(dict)
    for r in got[got.vec_id != 7].itertuples():
        by_id[None if np.isnan(r.vec_id) else int(r.vec_id)][r.component - 1] = (r.deviation, r.whitened)
    table = {i: (d, w) for i, d, w in zip(ids, deviation, whitened) if i != 7}
    assert by_id.keys() == table.keys()
    sign = np.sign([by_id[0][c][1] * table[0][1][c] for c in range(16)])
    for i, found in by_id.items():
        assert {d for d, _ in found.values()} == {table[i][0]}
        assert np.allclose([found[c][1] for c in range(16)] * sign, table[i][1][:16], atol=1e-8)


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    flat = whitening.whiten(vectors(spark, [(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [3.0, 5.0])])).collect()
    assert [r.component for r in flat] == [1, 1, 1]  # the constant dimension has no component
    assert sorted(round(abs(r.whitened), 9) for r in flat) == [0.0, *[round(1.5**0.5, 9)] * 2]


def test_whitening_of_large_numbers(spark):
    rows = [(i, [1e12 * (i + 1), float(i % 3)]) for i in range(5)]
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x)]
    exact = [sum((5 * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    got = {r.vec_id: r.deviation for r in whitening.whiten(vectors(spark, rows)).collect()}
    assert got == {i: d if d < 2**63 else None for i, d in enumerate(exact)}  # null beyond 64 bits
    assert None in got.values() and any(got.values())


def brute_runs(words, min_length, min_exponent):
    out = {}
    for q in range(1, len(words) // min_exponent + 1):
        j = 0
        while j + q < len(words):
            s = j
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - s + q >= max(min_length, min_exponent * q):
                out.setdefault((s, j - s + q), q)
            j += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def run_texts():
    rng = np.random.default_rng(11)
    texts = [None, "", " \n\x0b", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "x " * 3000, "ab c " * 4 + "ab d", "           "]
    for k in (1, 2, 3, 8):
        for size in (7, 30, 90):
            w = [f"w{x}" for x in rng.integers(0, k, size)]
            unit = [f"w{x}" for x in rng.integers(0, k + 2, rng.integers(1, 6))]
            texts += [" ".join(w), "\n".join(w[: size // 2] + unit * 6 + w[size // 2 :])]
    thue = [f"t{bin(i).count('1') % 2}" for i in range(2000)]
    texts += [" ".join(thue), " ".join(str(i % 13) for i in range(20_000))]
    return texts


@pytest.mark.parametrize("limits", [(6, 4), (2, 2)])
def test_periodic_runs_equal_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(periodic, "BATCH_WORDS", 500)
    texts = run_texts()
    if limits == (2, 2):
        texts = [t for t in texts if len(t or "") < 20_000]
    got = {r.doc_id: r for r in periodic.periodic_runs(frame(spark, texts), *limits).collect()}
    assert list(got[0].asDict()) == ["doc_id", "text", "n_shingles", "component_id", "kept", "key", "n_words", "runs", "collapsed"]
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        want = brute_runs(words, *limits)
        gone = {j for s, n, q in want for j in range(s + q, s + n)}
        assert [tuple(r) for r in got[i].runs] == want and got[i].n_words == len(words)
        assert got[i].collapsed.encode() == b" ".join(w for j, w in enumerate(words) if j not in gone)


def test_periodic_runs_empty_table_and_limits(spark):
    assert periodic.periodic_runs(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(frame(spark, []), 2, 1)
