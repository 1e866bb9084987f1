"""The opN queries: each operator on its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, hnsw, html_extract, line_dedup, minhash, mixing, packing, pii, quality_fm, suffix_dedup
from .common import table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents", "doc_id", "text")).drop("found")


def op4_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_quality_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_fm.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_fm.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op8_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_line_dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_small_world_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


# Bytes are two hexadecimal digits each, as blobs can't be cut.
_OP1 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, o, md5_number(substr(x, 2 * o + 1, 400)) AS h FROM (SELECT r, x, unnest(range(strlen(x) // 2 - 199)) AS o FROM d)),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hits AS (SELECT r, o FROM w SEMI JOIN twice USING (h)),
marked AS (SELECT r, o, coalesce(o - lag(o) OVER (PARTITION BY r ORDER BY o) > 200, true) AS first FROM hits),
islands AS (SELECT r, o, sum(first::INT) OVER (PARTITION BY r ORDER BY o) AS i FROM marked),
spans AS (SELECT r, min(o) AS a, max(o) + 200 AS e FROM islands GROUP BY r, i),
gaps AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
cut AS (
  SELECT d.r, count(*) AS n, sum(e - a) AS removed, max(e) AS tail, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM gaps JOIN d ON d.r = gaps.r GROUP BY d.r
)
SELECT doc_id, CAST(strlen(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN x ELSE head || substr(x, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut ON cut.r = d.r
"""

_OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS v, a AS u FROM both_ways UNION SELECT r.v, e.b FROM reach r JOIN both_ways e ON r.u = e.a),
comp AS (SELECT v, min(u) AS u FROM reach GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(comp.u, d.doc_id) AS component_id, coalesce(comp.u, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.v = d.doc_id
"""

_OP9 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), o AS (SELECT key, min(doc_id) AS first, max(doc_id) AS last FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.doc_id, k.i, k.line, coalesce(o.first <> o.last AND o.first <> k.doc_id, false) AS gone FROM k LEFT JOIN o ON o.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_suffix_array_dedup, op2_html_extraction, op3_personal_data, op4_multiset_fingerprints, op5_minhash_near_dedup,
            op6_quality_factorisation, op7_pivotal_mixing, op8_bin_slack_packing, op9_line_dedup_runs, op10_small_world_neighbours,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array_dedup": _OP1, "op5_minhash_near_dedup": _OP5, "op9_line_dedup_runs": _OP9}
