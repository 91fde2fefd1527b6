"""op7: passages that repeat across documents."""

from __future__ import annotations

from .registry import register
from .scratch import Scratch
from .substring_dedup import find

SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS s FROM d, unnest(range(1, len(ws) - 48)) AS t(i)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
g AS (SELECT DISTINCT doc_id, j FROM w JOIN f USING (s), unnest(range(i, i + 50)) AS t(j) WHERE first < doc_id),
h AS (SELECT doc_id, list(j) AS js FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN ws ELSE (
         SELECT coalesce(list(x ORDER BY k), []) FROM (SELECT unnest(ws) AS x, generate_subscripts(ws, 1) AS k) WHERE NOT list_contains(js, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN h USING (doc_id)
"""


@register("op7_substring_dedup", SQL)
def op7_substring_dedup(spark, sf_dir):
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
