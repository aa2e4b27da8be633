"""The registered queries of the subpackage: thin views of its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.llm import decontaminate, fingerprints, langid, license_scan, minhash, mixing, periodic, secret_scan, sharding, simhash, substring, suffix_dedup, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register("op1_shard")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(documents(spark, sf_dir), 40, pinned=True)
    text = F.coalesce(F.col("text"), F.lit(""))
    return placed.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register("op2_fuzzy_passages")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.passage_classes(documents(spark, sf_dir), pinned=True, counts=True)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT 'd' AS side, row_number() OVER () AS rid, CAST(doc_id AS VARCHAR) AS id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), wins AS (
  SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS win
  FROM items, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS t(i)
  WHERE len(ws) > 0
), lens AS (SELECT DISTINCT n FROM wins),
dwin AS (
  SELECT rid, i, lens.n, array_to_string(ws[i : i + lens.n - 1], ' ') AS win
  FROM w, lens, unnest(range(1, greatest(len(ws) - lens.n + 1, 0) + 1)) AS t(i)
), hits AS (
  SELECT d.rid, d.i, d.n, x.item FROM dwin d JOIN wins x ON d.n = x.n AND d.win = x.win
), per_word AS (
  SELECT DISTINCT rid, p FROM hits, unnest(range(i, i + n)) AS t(p)
), n_hits AS (SELECT rid, count(*) AS n_hit FROM per_word GROUP BY rid),
n_items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid
)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n_hits USING (rid) LEFT JOIN n_items USING (rid)
"""


@register("op3_decontaminate", OP3_SQL.replace("WITH RECURSIVE", "WITH"))
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = decontaminate.mark_contaminated(documents(spark, sf_dir), bench)
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@register("op4_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify_language(documents(spark, sf_dir))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@register("op5_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2("base_list", 256).alias("base_sha256"),
        F.col("span_list").alias("spans"),
    )


@register("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


@register("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(documents(spark, sf_dir), pinned=True)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op8_licenses")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses")
    )


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT)
            + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [1, 2, 3][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w
  FROM d GROUP BY source
), c AS (
  SELECT *, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS BIGINT) AS left_words,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS BIGINT) AS left_w,
         row_number() OVER (ORDER BY 3 * source_size / w, source IS NULL, source) AS pos
  FROM s
  WINDOW before AS (ORDER BY 3 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT min(pos) AS first_open FROM c WHERE left_words * w <= cap * left_w),
lv AS (SELECT left_words AS lw, left_w AS lwt FROM c, f WHERE pos = first_open),
t AS (
  SELECT source, source_size,
         CASE WHEN first_open IS NULL OR pos < first_open THEN CAST(cap AS DOUBLE)
              ELSE CAST(w * (SELECT lw FROM lv) AS DOUBLE) / CAST((SELECT lwt FROM lv) AS DOUBLE) END AS target
  FROM c, f
), cls AS (
  SELECT source, 20 - least(16, length(bin(size))) AS weight, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY 1, 2
), lvl AS (
  SELECT cls.*, t.source_size, t.target,
         (t.target - 3 * coalesce(sum(words) OVER before, 0)) /
         nullif(CAST(sum(weight * words) OVER (PARTITION BY cls.source) - coalesce(sum(weight * words) OVER before, 0) AS DOUBLE), 0) AS level
  FROM cls JOIN t ON cls.source IS NOT DISTINCT FROM t.source
  WINDOW before AS (PARTITION BY cls.source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), opened AS (
  SELECT source, max(weight) AS top, arg_max(level, weight) AS level FROM lvl WHERE level * weight <= 3 GROUP BY source
), e AS (
  SELECT lvl.source, lvl.weight, words, source_size, target,
         CASE WHEN source_size <= 0 THEN 0.0::DOUBLE WHEN top IS NULL OR lvl.weight > top THEN 3.0::DOUBLE ELSE opened.level * lvl.weight END AS copies
  FROM lvl LEFT JOIN opened ON lvl.source IS NOT DISTINCT FROM opened.source
), p AS (
  SELECT *, CAST(floor(copies) AS BIGINT) AS whole, copies - floor(copies) AS lam,
         target - sum(CAST(floor(copies) AS BIGINT) * words) OVER (PARTITION BY source) AS need FROM e
), q AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.need, CASE WHEN lam > 0 THEN (u / (1 - u)) / (lam / (1 - lam)) END AS q
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND p.weight = 20 - least(16, length(bin(size)))
), units AS (
  SELECT source, q, need, max(size) AS size, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY q) AS cum
  FROM q WHERE q IS NOT NULL GROUP BY source, q, need
), cut AS (
  SELECT source, coalesce(max(q) FILTER (cum <= need), -1) AS last_q, any_value(need) - coalesce(max(cum) FILTER (cum <= need), 0) AS left_over
  FROM units GROUP BY source HAVING max(cum) > any_value(need)
), passed AS (
  SELECT u.source, u.q, u.n, c.left_over, sum(u.n) OVER (PARTITION BY u.source ORDER BY u.q) AS cum
  FROM units u JOIN cut c ON u.source IS NOT DISTINCT FROM c.source AND u.q > c.last_q AND u.size <= c.left_over
), cut2 AS (
  SELECT source, coalesce(max(q) FILTER (cum <= left_over), -1) AS last_q, any_value(left_over) - coalesce(max(cum) FILTER (cum <= left_over), 0) AS left_over
  FROM passed GROUP BY source HAVING max(cum) > any_value(left_over)
), near AS (
  SELECT source, left_over, list(CAST(q AS DOUBLE) ORDER BY q) AS qs, list(n ORDER BY q) AS ns
  FROM (SELECT p.source, p.q, p.n, c.left_over, row_number() OVER (PARTITION BY p.source ORDER BY p.q) AS k
        FROM passed p JOIN cut2 c ON p.source IS NOT DISTINCT FROM c.source AND p.q > c.last_q)
  WHERE k <= 64 GROUP BY source, left_over
), fill AS (
  SELECT source, qs, ns, CAST(0 AS BIGINT) AS i, CAST(left_over AS DOUBLE) AS left_over, CAST([] AS DOUBLE[]) AS chosen FROM near
  UNION ALL
  SELECT source, qs, ns, i + 1, CASE WHEN ns[i + 1] <= left_over THEN left_over - ns[i + 1] ELSE left_over END,
         CASE WHEN ns[i + 1] <= left_over THEN list_append(chosen, qs[i + 1]) ELSE chosen END
  FROM fill WHERE i < len(qs)
), more AS (SELECT source, unnest(chosen) AS q FROM fill WHERE i = len(qs))
SELECT q.doc_id, q.size, q.source_size, q.target,
       CAST((q.whole + CASE WHEN q.q IS NOT NULL AND (c.last_q IS NULL OR q.q <= c.last_q OR m.q IS NOT NULL
                                                      OR q.size <= c.left_over AND (c2.last_q IS NULL OR q.q <= c2.last_q))
                       THEN 1 ELSE 0 END) * q.size AS BIGINT) AS taken
FROM q LEFT JOIN cut c ON q.source IS NOT DISTINCT FROM c.source LEFT JOIN cut2 c2 ON q.source IS NOT DISTINCT FROM c2.source
LEFT JOIN more m ON q.source IS NOT DISTINCT FROM m.source AND q.q = m.q
"""


@register("op9_mix", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@register("op10_fingerprint")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir))


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT rid, array_to_string(ws[i : i + 1], ' ') AS sh
  FROM w, unnest(range(1, greatest(len(ws) - 1, 1) + 1)) AS t(i) WHERE len(ws) > 0
), n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
common AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rid < b.rid GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT rid AS a, rid AS b FROM w
  UNION
  SELECT r.a, l.y FROM reach r JOIN both_ways l ON l.x = r.b
), least AS (SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN w ON w.rid = b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM w JOIN least USING (rid) LEFT JOIN n USING (rid)
"""


@register("op11_minhash", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.minhash_components(documents(spark, sf_dir), k=2, percent=80, pinned=True)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@register("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         CASE WHEN doc_id IS NOT NULL THEN
           xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                 lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
               lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384::BIGINT)), 4294967295::BIGINT)
         END AS h
  FROM documents
), g AS (SELECT *, len(ws) AS n, h // 10 AS g, h % 10 = 0 AND len(ws) > 0 AS edited FROM w),
a AS (SELECT *, CASE WHEN edited THEN g % n END AS a FROM g),
p AS (SELECT *, CASE WHEN edited THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
words AS (
  SELECT rid, i, n, CASE WHEN edited AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS word
  FROM p, unnest(range(0, n)) AS t(i)
), same AS (  -- words q apart that are equal
  SELECT x.rid, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT rid, q, min(i) AS start, max(i) - min(i) + 1 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS grp FROM same) GROUP BY rid, q, grp
), runs AS (
  SELECT rid, start, length, min(q) AS period FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY rid, start, length
), best AS (
  SELECT rid, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256
  FROM runs GROUP BY rid
), top AS (
  SELECT rid, start, length, period FROM (
    SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM runs) WHERE k = 1
), gone AS (SELECT DISTINCT rid, i FROM runs, unnest(range(start + period, start + length)) AS t(i)),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
       CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM w LEFT JOIN best USING (rid) LEFT JOIN top USING (rid) LEFT JOIN kept USING (rid)
"""


WORD = r"[^\x20\x09-\x0D]+"


def _with_repeated_tail(docs: DataFrame) -> DataFrame:
    """The edit of operator 13's contract: a tenth of the texts end in a repeated stretch."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = (h % 10 == 0) & F.col("text").rlike(WORD)
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n = F.size("__w").cast("long")
    shift = lambda i: F.when(i >= F.col("__a"), F.col("__a") + (i - F.col("__a")) % F.col("__p")).otherwise(i)
    edited = F.array_join(F.transform("__w", lambda w, i: F.get("__w", shift(i).cast("int"))), " ")
    return (
        docs.select("doc_id", "text", words.alias("__w"), F.floor(h / 10).alias("__g"))
        .withColumn("__a", F.when(F.col("__w").isNotNull(), F.col("__g") % n))
        .withColumn("__p", F.lit(1) + F.floor((n - F.col("__a")) / (F.lit(3) + F.col("__g") % 8)))
        .select("doc_id", F.when(F.col("__w").isNull(), F.col("text")).otherwise(edited).alias("text"))
    )


@register("op13_periodic", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(_with_repeated_tail(documents(spark, sf_dir)))
    denser = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  ties: the earlier one stays
    first = F.get("runs", F.lit(0))
    top = F.aggregate("runs", first, lambda best, r: F.when(denser(r, best), r).otherwise(best))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.floor(F.lit(1000) * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
