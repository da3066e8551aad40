"""Queries over the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, mixing, ngram_join, pii, quality_rules, secrets, sharding, toxicity, url_filters, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 24)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, canonical forms, links in the html, and the redirects of `moved_pages`, as the tables have none."""
    pages = _table(spark, sf_dir, "pages")
    return url_filters.judge_pages(pages, redirects=url_filters.moved_pages(pages)).select("page_id", "host", "path", "rule", "verdict", "by_alias")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_url_filters": op2_url_filters,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_secrets": op6_secrets,
    "op7_ngram_join": op7_ngram_join,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_decontam": op10_decontam,
    "pipeline": pipeline,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op7_ngram_join": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(generate_series(1, len(w) - 3), lambda k: array_to_string(w[k:k + 3], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END AS s
  FROM words),
rows_ AS (SELECT doc_id, unnest(s) AS t FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM rows_ a JOIN rows_ b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT h.a, h.b FROM shared h JOIN sets x ON x.doc_id = h.a JOIN sets y ON y.doc_id = h.b
  WHERE 100 * h.n >= 85 * (len(x.s) + len(y.s) - h.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, other) AS (SELECT a, b FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(other) FROM reach WHERE node = doc_id), doc_id)) AS component_id
FROM sets""",
    "op10_decontam": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS x
  FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, generate_subscripts(xs, 1) AS k, unnest(xs) AS x
  FROM (SELECT doc_id, n, list_transform(generate_series(1, len(w) - n + 1), lambda k: array_to_string(w[k:k + n - 1], ' ')) AS xs FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.k, p.n, v.item_id FROM places p JOIN windows v ON p.n = v.n AND p.x = v.x),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id""",
    # The pages of the tables name no canonical address and don't refresh, so edges are the redirects of `moved_pages` alone.
    "op2_url_filters": r"""
WITH RECURSIVE split AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    array_to_string(list_filter(string_split(coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)(=|$)')), '&') AS query
  FROM pages),
rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
hits AS (
  SELECT s.*, r.verdict, r.rhost || r.rpath AS rule
  FROM split s LEFT JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)),
judged AS MATERIALIZED (
  SELECT page_id, any_value(host) AS host, any_value(path) AS path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict,
    any_value(CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(/+|\.html?)$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END END) AS node
  FROM hits GROUP BY page_id),
moved AS (SELECT x.node AS a, y.node AS b FROM judged x JOIN judged y ON x.page_id % 7 IN (0, 1) AND y.page_id = x.page_id + 1),
edges AS MATERIALIZED (SELECT a, b FROM moved UNION SELECT b, a FROM moved),
bad(node) AS (
  SELECT node FROM judged WHERE verdict = 'block'
  UNION
  SELECT e.b FROM bad JOIN edges e ON bad.node = e.a)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN node IN (SELECT node FROM bad WHERE node IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict,
  rule IS NULL AND coalesce(node IN (SELECT node FROM bad WHERE node IS NOT NULL), false) AS by_alias
FROM judged""",
    "op8_warc": r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f""",
    "op4_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos
  FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE pos % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, CAST(source_size * 2 AS DOUBLE) AS cap FROM sources),
levels AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - (CAST(sum(cap) OVER w AS DOUBLE) - cap))
      / (sum(weight) OVER () - sum(weight) OVER w + weight) AS level
  FROM weighted WINDOW w AS (ORDER BY cap / weight, pos ROWS UNBOUNDED PRECEDING)),
level AS (SELECT arg_min(level, ratio * 1e6 + pos) AS level FROM levels WHERE level <= ratio),
targets AS (SELECT source, source_size, least(cap, coalesce(level.level * weight, cap)) AS target FROM levels, level),
running AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.size, s.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, CAST(round(target) AS BIGINT) - whole * source_size - start)) AS BIGINT) AS taken
FROM running""",
}
