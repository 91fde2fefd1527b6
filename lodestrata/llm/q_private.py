"""op13: personal data in every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from .private import BASE, KINDS, LEAST_SECRET, SECRET_WORDS, count, find_private, joined
from .registry import register

_LOCAL, _LABEL, _AT, _DOT = "[A-Za-z0-9._%+-]+", "[A-Za-z0-9-]+", r"(?:\[(?i:at)\]|\((?i:at)\))", r"(?:\[(?i:dot)\]|\((?i:dot)\))"
#: Each kind as one pattern; group 1 of the last two is what is shown.
PATTERNS = {
    "email": rf"{_LOCAL}@{_LABEL}(\.{_LABEL})+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "spelled": rf"{_LOCAL}\x20?{_AT}\x20?{_LABEL}(?:(?:\.|\x20?{_DOT}\x20?){_LABEL})+",
    "login": rf"[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9._~%-]+:[!#-.0-;=?A-~]+@{_LABEL}(?:\.{_LABEL})*",
    "iban": r"(?i:iban)[\x20:#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?)",
    "secret": rf"""(?i:{"|".join(SECRET_WORDS)})["']?\x20{{0,2}}[=:]\x20{{0,2}}["']?([A-Za-z0-9_/+.-]{{{LEAST_SECRET},}})""",
}


def _sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def remainder(x: str) -> str:
        digits = f"list_transform(string_split(substring({x}, 5) || substring({x}, 1, 4), ''), lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
        return f"len({x}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, {digits}), lambda a, b: CASE WHEN b < 10 THEN (a * 10 + b) % 97 ELSE (a * 100 + b) % 97 END) = 1"

    each = " UNION ALL ".join(f"SELECT r, {k} AS k, {quoted(kind)} AS kind, regexp_extract_all(t, {quoted(p)}) AS m, string_split_regex(t, {quoted(p)}) AS g FROM d WHERE regexp_matches(t, {quoted(p)})" for k, (kind, p) in enumerate(PATTERNS.items()))
    secret, iban = quoted(PATTERNS["secret"]), quoted(PATTERNS["iban"])
    luhn = "list_sum(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN (len(x) - i) % 2 = 0 THEN CAST(x[i] AS INT) WHEN CAST(x[i] AS INT) > 4 THEN 2 * CAST(x[i] AS INT) - 9 ELSE 2 * CAST(x[i] AS INT) END)) % 10 = 0"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({each}),
w AS (
  SELECT r, k, kind, m[i] AS s, list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS a
  FROM f, unnest(range(1, len(m) + 1)) AS u(i)),
c AS (
  SELECT r, k, kind, s, CAST(a AS BIGINT) AS a, CAST(a + len(s) AS BIGINT) AS z, regexp_replace(s, '[^0-9]', '', 'g') AS x,
    CASE kind WHEN 'secret' THEN regexp_extract(s, {secret}, 1) WHEN 'iban' THEN regexp_extract(s, {iban}, 1) END AS v,
    CASE kind WHEN 'iban' THEN regexp_extract(s, {iban}, 2) ELSE '' END AS tail FROM w),
i AS (SELECT *, CASE kind WHEN 'iban' THEN replace(v, ' ', '') END AS y, CASE WHEN tail <> '' THEN replace(substring(v, 1, len(v) - len(tail)), ' ', '') END AS y2 FROM c),
p AS (
  SELECT r, k, kind, CASE WHEN v IS NOT NULL THEN z - len(v) ELSE a END AS a,
    CASE WHEN kind = 'iban' AND NOT coalesce({remainder("y")}, FALSE) THEN z - len(tail) ELSE z END AS z
  FROM i WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(s, '.'), lambda p: len(ltrim(p, '0')) > 3 OR CAST('0' || right(ltrim(p, '0'), 3) AS INT) > 255)) = 0
    WHEN 'card' THEN len(x) BETWEEN 16 AND 19 AND {luhn}
    WHEN 'phone' THEN len(x) BETWEEN 8 AND 15
    WHEN 'iban' THEN coalesce({remainder("y")}, FALSE) OR coalesce({remainder("y2")}, FALSE)
    WHEN 'secret' THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
    ELSE TRUE END),
n AS (
  SELECT r, {counts}, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY k, a) FILTER (WHERE k < {len(BASE)}) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY k, a) AS spans
  FROM p GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN n USING (r)
"""


SQL = _sql()


@register("op13_private_data", SQL)
def op13_private_data(spark, sf_dir):
    found = find_private(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(BASE), 256).alias("base_sha256"), joined(KINDS).alias("spans"))
