"""op11: product codes of every vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from .codebooks import compress, digest
from .registry import register
from .scratch import Scratch


def _assigned(of: str, parts: str, book: str) -> str:
    return f"""
{of} AS MATERIALIZED (
  SELECT rid, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
    SELECT x.rid, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM {parts} x JOIN {book} b ON b.p = x.p)
  GROUP BY rid, p)"""


def _moved(to: str, of: str, book: str) -> str:
    return f"""
{to} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM {book} b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT a.p, a.e, i, sum(x.v[i])::BIGINT AS s, count(*) AS n
      FROM {of} a JOIN parts x USING (rid, p), unnest(range(1, len(x.v) + 1)) AS t(i) GROUP BY a.p, a.e, i)
    GROUP BY p, e) m USING (p, e))"""


SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT rid, p, w[p * len(w) // 16 + 1 : (p + 1) * len(w) // 16] AS v FROM kept, unnest(range(16)) AS t(p)),
b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v FROM parts WHERE rid <= 64),
{_assigned("a1", "parts", "b0")},
{_moved("b1", "a1", "b0")},
{_assigned("a2", "parts", "b1")},
{_moved("b2", "a2", "b1")},
{_assigned("a3", "parts", "b2")},
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY rid),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (rid), book
"""


@register("op11_vector_codes", SQL)
def op11_vector_codes(spark, sf_dir):
    coded, entries = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(entries)).alias("codebooks_sha256"))
