"""The queries of this subpackage, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmill.llm import bpe, codes, lexical, linededup, matroska, minhash, mixing, packing, substring, topk, toxicity, urlfilter, warc

#: (action, host and path) of the URL filter query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.MinMax(words=3, percent=85))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors.where("vec_id % 100 = 0"), vectors)


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), RULES)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.amounts(table(spark, sf_dir, "documents"))


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(table(spark, sf_dir, "documents"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules alone decide; the verdicts of the model have no SQL."""
    judged = urlfilter.judge(table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.amounts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def media_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_minhash, op2_topk, op3_urlfilter, op4_toxicity, op5_packing, op6_warc, op7_linededup, op8_mixing, op9_matroska, op10_substring, op11_lexical, op12_codes, op13_bpe, pipeline, url_rules, mixing_targets, media_bytes]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1, "op2_topk": OP2, "op6_warc": OP6, "op10_substring": OP10, "op11_lexical": OP11, "op12_codes": op12_sql(), "url_rules": URLS, "mixing_targets": TARGETS, "media_bytes": MEDIA}


OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n_shingles, grams FROM s),
g AS (SELECT doc_id, n_shingles, unnest(grams) AS gram FROM n),
f AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common, any_value(a.n_shingles) AS m, any_value(b.n_shingles) AS n
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM f WHERE 100 * common >= 85 * (m + n - common)),
reach(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON r.v = e.u),
c AS (SELECT u, min(v) AS low FROM reach GROUP BY u)
SELECT n.doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(low, n.doc_id)) AS component_id,
  n.doc_id = least(n.doc_id, coalesce(low, n.doc_id)) AS kept FROM n LEFT JOIN c ON n.doc_id = c.u
"""

OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS sha, max(page_id) OVER (PARTITION BY sha1(html)) AS head FROM p),
x AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(sha, 5 * i + 1, 5) AS BIGINT)) AS parts FROM d),
b AS (SELECT *, array_to_string(list_transform(parts, lambda y: array_to_string(list_transform([15, 10, 5, 0],
  lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((y >> k) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest FROM x)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to FROM b
"""

OP10 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM w WHERE len(words) >= 20),
h AS (SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS win FROM s),
r AS (SELECT doc_id, start, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) AS nth FROM h),
m AS (SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS pos FROM r WHERE nth > 1),
g AS (SELECT doc_id, list(pos) AS gone, count(*) AS n_removed FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(words, ' ')
    ELSE array_to_string(list_filter(words, lambda x, i: NOT list_contains(gone, i)), ' ') END) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""

URLS = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
v AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(action, name, start)),
m AS (SELECT page_id, name || start AS rule, action FROM u JOIN v ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
  QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(name || start) DESC) = 1)
SELECT u.page_id, host, path, rule, action AS ruled FROM u LEFT JOIN m ON u.page_id = m.page_id
"""

TARGETS = r"""
WITH RECURSIVE w AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM w GROUP BY source),
k AS (SELECT source, source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS BIGINT)] AS weight FROM s),
f AS (  -- rounds: sources whose share would pass twice their size stop there
  SELECT 0 AS round, source, source_size, weight, CAST(NULL AS DOUBLE) AS stop FROM k
  UNION ALL
  SELECT round + 1, source, source_size, weight, CASE WHEN stop IS NOT NULL THEN stop
      WHEN weight * (1.5 * sum(source_size) OVER () - coalesce(sum(stop) OVER (), 0)) / sum(weight) FILTER (stop IS NULL) OVER () > 2.0 * source_size THEN 2.0 * source_size END
  FROM f WHERE round < (SELECT count(*) FROM k)),
e AS (SELECT source, source_size, coalesce(stop, weight * (1.5 * sum(source_size) OVER () - coalesce(sum(stop) OVER (), 0)) / sum(weight) FILTER (stop IS NULL) OVER ()) AS target
  FROM f WHERE round = (SELECT count(*) FROM k))
SELECT doc_id, size, source_size, round(target, 3) AS target FROM w JOIN e ON w.source IS NOT DISTINCT FROM e.source
"""

MEDIA = r"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS body FROM documents),
n AS (SELECT doc_id, body, CAST(octet_length(body) AS BIGINT) AS n_bytes FROM t),
p AS (SELECT *, CASE WHEN n_bytes = 0 THEN 64 ELSE (n_bytes + 63) // 64 * 64 END AS payload_bytes FROM n)
SELECT doc_id, n_bytes, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha256(body || unhex(repeat('00', CAST(payload_bytes - n_bytes AS INTEGER)))) AS payload_sha256 FROM p
"""

OP11 = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) FILTER (len(terms) > 0) AS big_n, CAST(sum(len(terms)) AS BIGINT) AS big_l FROM t),
m AS (SELECT doc_id, terms, CAST(100 - 75 + (75 * len(terms) * big_n) // greatest(big_l, 1) AS BIGINT) AS m FROM t, s),
f AS (SELECT doc_id, term, any_value(m) AS m, count(*) AS tf FROM (SELECT doc_id, m, unnest(terms) AS term FROM m) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, big_n),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN f USING (term) JOIN w USING (term) GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""


def op12_sql(rounds: int = 6) -> str:
    """Lloyd rounds over all parts and entries, one after the other."""
    distance = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
    text = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] AS x FROM v, (SELECT unnest(range(8)) AS part)),
b0 AS MATERIALIZED (SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS BIGINT) AS e, x AS c FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 16)"""
    for r in range(rounds + 1):
        text += f""",
a{r} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, arg_min(e, 16 * ({distance}) + e) AS e, min({distance}) AS d FROM p JOIN b{r} USING (part) GROUP BY vec_id, part)"""
        if r < rounds:
            text += f""",
n{r} AS (SELECT part, e, list(m ORDER BY k) AS c FROM (SELECT part, e, k, floor(sum(y) / count(*)) AS m FROM (
  SELECT part, e, unnest(x) AS y, generate_subscripts(x, 1) AS k FROM a{r}) GROUP BY part, e, k) GROUP BY part, e),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(n.c, b.c) AS c FROM b{r} b LEFT JOIN n{r} n ON b.part = n.part AND b.e = n.e)"""
    return text + f""",
g AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  sha256((SELECT string_agg(array_to_string(list_transform(c, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY part, e) FROM b{rounds})) AS codebooks_sha256
FROM g JOIN v USING (vec_id)
"""
