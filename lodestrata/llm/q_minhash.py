"""op1: near-duplicate documents on two-word shingles."""

from __future__ import annotations

from .minhash import near_duplicates
from .registry import register
from .scratch import Scratch

SHINGLE = 2

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# Pairs are sought through each set's rare shingles: sets with similarity 0.8 share one among the first
# n - ceil(0.8 n) + 1 of either, in order of frequency.
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g
  FROM d, unnest(range(1, greatest(len(ws) - 1, 1) + 1)) AS t(i) WHERE len(ws) > 0),
f AS (SELECT g, count(*) AS df FROM s GROUP BY g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS k FROM s JOIN f USING (g)),
p AS (SELECT doc_id, g FROM r JOIN n USING (doc_id) WHERE k <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y USING (g) WHERE x.doc_id < y.doc_id),
l AS (
  SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  GROUP BY a, b, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (
  WITH RECURSIVE w(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.id)
  SELECT id, min(c) AS c FROM w GROUP BY id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM documents JOIN reach ON id = doc_id LEFT JOIN n USING (doc_id)
"""


@register("op1_minhash_dedup", SQL)
def op1_minhash_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), SHINGLE)
