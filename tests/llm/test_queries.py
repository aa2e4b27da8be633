"""The registered corpus queries and the pipeline on the sf0.001 tables."""

import collections
import os
import re
import sys
import tempfile

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from tillspark.llm import queries

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "scripts"))
from oracle_check import digest  # noqa: E402
from test_operators import brute_components, brute_fingerprint  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    res = con.execute(queries.ORACLE[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == sorted(df.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(names, res.fetchall())[0]


def test_native_queries_plan_no_python(spark):
    for name in ("op5_secrets", "op8_licenses"):
        text = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(m in text for m in ("Python", "Pandas", "Arrow", "Exchange")), name


def test_all_operators_and_the_pipeline_are_registered():
    numbers = {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")}
    assert numbers == set(range(1, 14)) and "pipeline" in queries.QUERIES


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    ids = [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        from tillspark.llm.common import scratch_table

        seen = scratch_table(stage(spark, seen, SF))
        if name != "shard":
            assert seen.columns == docs.columns
        ids.append({r.doc_id for r in seen.collect()})
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[-1] == ids[-2]
    comps = {r.component_id for r in queries.QUERIES["op6_simhash"](spark, SF).collect()}
    assert len(ids[2]) < len(ids[1]) and (ids[1] != ids[0] or ids[2] == comps)
    dirty = {r.doc_id for r in queries.QUERIES["op3_decontaminate"](spark, SF).collect() if r.contaminated}
    assert ids[3] == ids[2] - dirty
    rows = seen.collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 40


def test_pipeline_matches_brute_force(spark):
    """Every stage in plain Python (the mix by its oracle SQL), with a null id, an
    equal id, exact copies and texts without a language added to the table."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    some = table.orderBy("doc_id").first()
    extra = [(None, "a text of its own without an id", "en", "web", 31), (10**9, some.text, some.lang, some.source, some.n_chars)]
    extra += [(10**9 + 1, "12 !! 3", "en", "web", 7), (10**9 + 2, None, None, None, 0)]
    folder = tempfile.mkdtemp(prefix="tillspark-test-")
    table.unionByName(spark.createDataFrame(extra, table.select("doc_id", "text", "lang", "source", "n_chars").schema)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    # language
    rows = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    assert not {10**9 + 1, 10**9 + 2} & {r[0] for r in rows}
    # near duplicates: the least id of a component
    prints = [brute_fingerprint(r[1]) for r in rows]
    comps = brute_components(set(prints))
    first = {}
    for r, f in zip(rows, prints):
        held = first.get(comps[f])
        if held is None or (r[0] is None, r[0] or 0) < (held[0] is None, held[0] or 0):
            first[comps[f]] = r
    before, rows = len(rows), list(first.values())
    assert len(rows) < before and 10**9 not in {r[0] for r in rows}
    # benchmark windows of ten words
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for b in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = fold(b.text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[n].add(tuple(w[i : i + n]))
    clean = []
    for r in rows:
        w = fold(r[1])
        if not any(tuple(w[i : i + n]) in known for n, known in windows.items() for i in range(len(w) - n + 1)):
            clean.append(r)
    assert len(clean) < len(rows)
    # the mix, copies and all
    documents = pa.table({"doc_id": pa.array([r[0] for r in clean], pa.int64()), "text": [r[1] for r in clean], "source": [r[2] for r in clean]})
    con = duckdb.connect()
    con.register("documents", documents)
    res = con.execute(queries.ORACLE["op9_mix"])
    assert [c[0] for c in res.description] == ["doc_id", "size", "source_size", "target", "taken"]
    copies = {x[0]: x[4] // x[1] for x in res.fetchall()}
    want = collections.Counter({r: copies[r[0]] for r in clean if copies[r[0]]})
    assert len({r[0] for r in clean}) == len(clean) and max(want.values()) > 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert collections.Counter((r.doc_id, r.text, r.source) for r in got) == want
    # shards of equal size, slots without a gap
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    sizes = [len(v) for v in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == corpus_pipeline.SHARDS
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
