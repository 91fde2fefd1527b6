"""op9: near-duplicate vectors."""

from __future__ import annotations

from .embedding_dedup import near_duplicates
from .registry import register
from .scratch import Scratch

SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95),
reach AS (
  WITH RECURSIVE r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.b, r.c FROM r JOIN links ON links.a = r.id)
  SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, reach.c AS component_id, e.vec_id = reach.c AS kept
FROM embeddings e JOIN reach ON reach.id = e.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = e.vec_id
"""


@register("op9_embedding_dedup", SQL)
def op9_embedding_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark))
