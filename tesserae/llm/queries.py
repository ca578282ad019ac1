"""Queries ``opN_<name>``: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import (
    decontaminate,
    embedding_dedup,
    license_scan,
    mixing,
    pii,
    quality,
    secret_scan,
    simhash,
    token_counts,
    warc,
)
from tesserae.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.map_entries("merged_headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    micros = lambda c: F.unix_micros(c).alias(c)
    return found.select(
        "record_id", "url", micros("warc_date"), "outcome", "match_id", micros("match_date"), "payload_digest", "payload_length",
        F.array_join(F.array_sort(lines), "\n").alias("merged_headers"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[0]


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_secret_scan, op2_quality, op3_warc_revisits, op4_license_scan, op5_embedding_dedup, op6_token_counts, op7_simhash,
        op8_mixing, op9_decontamination, op10_pii,
    )
    return {f.__name__: f for f in every}


_WARC_SQL = r"""
WITH p AS (
  SELECT page_id AS p, trim(url) AS u, coalesce(html, '') AS body FROM pages
), q AS (
  SELECT p, body, md5(body) AS digest, (1704067200 + p * 60) * 1000000 AS t,
         strftime(make_timestamp((1704067200 + p * 60) * 1000000), '%Y-%m-%d') AS day,
         lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?', 1)) AS scheme,
         lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?', 2)) AS host,
         regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?', 3) AS port,
         regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?', 4) AS path,
         regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(\?[^#]*)?', 5) AS query
  FROM p
), r AS (
  SELECT p, t, digest, length(body) AS n, day, t + (5400 + (p % 7) * 86400) * 1000000 AS v,
         scheme || '://' || host
           || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
           || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '?' THEN '' ELSE query END AS url
  FROM q
), joined AS (
  SELECT a.p, a.v, a.url, a.digest AS own, a.day AS own_day, b.p AS mp, b.t AS mt, b.digest AS d, b.n, b.day
  FROM r a LEFT JOIN (
    SELECT x.p AS k, max({'t': y.t, 'id': 'r' || y.p, 'p': y.p}) AS m
    FROM r x JOIN r y ON x.url = y.url AND y.t < x.v GROUP BY x.p
  ) c ON c.k = a.p LEFT JOIN r b ON b.p = c.m.p
), decided AS (
  SELECT *, CASE WHEN mp IS NULL THEN 'no_earlier'
                 WHEN p % 5 = 0 THEN 'mismatch'
                 WHEN p % 7 = 0 THEN CASE WHEN own_day = day THEN 'resolved' ELSE 'mismatch' END
                 WHEN own = d THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM joined
)
SELECT 'v' || p AS record_id, url, v AS warc_date, outcome, 'r' || mp AS match_id, mt AS match_date,
       CASE WHEN outcome = 'resolved' THEN d END AS payload_digest,
       CASE WHEN outcome = 'resolved' THEN n END AS payload_length,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || n || chr(10)
         || 'content-type: text/html' || chr(10) || 'etag: ' || CASE WHEN p % 7 = 0 THEN d ELSE 'W/' || own END || chr(10)
         || 'last-modified: ' || day END AS merged_headers
FROM decided
"""

_EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), u AS (
  SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN least c USING (vec_id)
"""

_CONTAMINATION_SQL = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM windows
), docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)
), met AS (
  SELECT p.r, p.n, p.i, x.item_id FROM places p JOIN windows x ON p.n = x.n AND p.win = x.win
), hits AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM met) GROUP BY r
), found AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM met GROUP BY r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits h USING (r) LEFT JOIN found f USING (r)
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can state the operator; the rest is held against brute force in the tests."""
    return {"op3_warc_revisits": _WARC_SQL, "op5_embedding_dedup": _EMBEDDING_SQL, "op9_decontamination": _CONTAMINATION_SQL}
