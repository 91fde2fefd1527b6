"""Defects planted in a given table by key arithmetic, one SQL text for both engines, and what must be found of them.

Every query reads ``orders`` (or all given tables); the SQL beside it counts the planted defects in the same table and
says from these counts what an analysis has to report.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import repair as P
from ..operators.config import ColumnPolicy, Config, ConfigError, parse
from ..operators.drift import compare
from ..operators.findings import Finding, collapse, redact
from ..operators.profile import profile
from ..sources.tables import TextTable
from .catalog import register
from .quality import NOW, _is_null

_PAD = "lpad(CAST({} AS STRING), {}, '0')".format


def _one_of(*words: str) -> str:
    """A word by id."""
    return f"CASE id % {len(words)} " + " ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(words)) + " END"


_DAY2, _MON2 = _PAD("id % 28 + 1", 2), _PAD("id % 12 + 1", 2)
_LOW = _PAD("id % 11 + 1", 2) + " || '/' || " + _PAD("(id + 5) % 11 + 1", 2) + " || '/1999'"
_WORD = _one_of("alder", "birch", "cedar", "maple", "rowan")


def planted(spark, sf_dir, columns: dict[str, str], where: str = "true", header: list[str] | None = None) -> TextTable:
    """Columns over ``orders``, whose key is ``id``."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("id", F.col("o_orderkey")).where(where)
    return TextTable(df.select(F.col("id").alias("row_no"), *[F.expr(e).alias(f"c{k}") for k, e in enumerate(columns.values())]), header or list(columns))


def cells(columns: dict[str, str], name: str = "d", where: str = "true") -> str:
    """The same columns as a common table of the oracle, named c0, c1 ... beside id."""
    return f"{name} AS (SELECT id, {', '.join(f'{e} AS c{k}' for k, e in enumerate(columns.values()))} FROM (SELECT *, o_orderkey AS id FROM orders) WHERE {where})"


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _counts(found: list[Finding]) -> str:
    return ",".join(str(f.detail["count"]) for f in sorted(found, key=lambda f: f.code) if "count" in f.detail)


# --- kinds, conventions and the findings of each column ----------------------------------------------

_ALL = "count(*) > 0"
#: column: (expression, kind, convention, date order, codes, what must hold of the table, the defects that findings count)
KINDS = {
    "nothing": ("''", "empty", "en", None, "empty-column", _ALL, ()),
    "same": ("'fixed'", "categorical", "en", None, "constant-column", "count(*) > 1", ()),
    "flag": (_one_of("yes", "no"), "boolean", "en", None, "", "count(DISTINCT {c}) = 2", ()),
    "mostly numbers": ("CASE WHEN id % 10 = 3 THEN 'later' ELSE CAST(id * 3 AS STRING) END", "numeric", "en", None, "mixed-types", "count(*) FILTER ({c} = 'later') BETWEEN 1 AND 0.3 * count(*)", ("{c} = 'later'",)),
    "half numbers": (f"CASE WHEN id % 2 = 1 THEN {_WORD} ELSE CAST(id * 3 AS STRING) END", "mixed", "en", None, "mixed-types", "count(*) FILTER (regexp_matches({c}, '^[0-9]+$')) BETWEEN 0.4 * count(*) AND 0.69 * count(*)", ("NOT regexp_matches({c}, '^[0-9]+$')",)),
    "grouped": ("CAST(id % 900 + 1 AS STRING) || ',' || " + _PAD("id % 1000", 3), "numeric", None, None, "ambiguous-decimal-separator", "count(*) = count(*) FILTER (regexp_matches({c}, '^[0-9]{{1,3}},[0-9]{{3}}$'))", ()),
    "two conventions": ("CASE WHEN id % 2 = 0 THEN CAST(id % 900 + 1 AS STRING) || ',500.25' ELSE CAST(id % 900 + 1 AS STRING) || '.500,25' END", "numeric", None, None, "conflicting-number-formats", "least(count(*) FILTER ({c} LIKE '%,25'), count(*) FILTER ({c} LIKE '%.25')) > 0", ()),
    "comma": ("CAST(id + 100 AS STRING) || ',5'", "numeric", "eu", None, "european-numbers", "count(*) = count(*) FILTER ({c} LIKE '%,5')", ()),
    "money": ("'$' || CAST(id + 100 AS STRING)", "numeric", "en", None, "number-as-text", "count(*) FILTER ({c} LIKE '$%') > 0", ()),
    "either day": (_LOW, "date", "en", None, "ambiguous-dates", "count(*) FILTER (CAST({c}[1:2] AS INT) > 12 OR CAST({c}[4:5] AS INT) > 12) = 0", ()),
    "both orders": (f"CASE WHEN id % 2 = 0 THEN '25/' || {_MON2} || '/1999' ELSE {_MON2} || '/25/1999' END", "date", "en", None, "conflicting-date-formats", "least(count(*) FILTER (CAST({c}[1:2] AS INT) > 12), count(*) FILTER (CAST({c}[4:5] AS INT) > 12)) > 0", ()),
    "hardly proven": (f"CASE WHEN id % 20 = 0 THEN '25/03/1999' ELSE {_LOW} END", "date", "en", "dmy", "weak-date-evidence", "count(*) FILTER (CAST({c}[1:2] AS INT) > 12) BETWEEN 1 AND 0.24 * count(*)", ()),
    "iso beside": (f"CASE WHEN id % 2 = 0 THEN '1999-' || {_MON2} || '-17' ELSE '17/' || {_MON2} || '/1999' END", "date", "en", "dmy", "mixed-date-formats", "least(count(*) FILTER ({c} LIKE '%/%'), count(*) FILTER ({c} LIKE '%-%')) > 0", ()),
    "eight digits": (f"'1999' || {_MON2} || {_DAY2}", "numeric", "en", None, "compact-date-or-number", _ALL, ("len({c}) = 8",)),
    "eight beside": (f"CASE WHEN id % 2 = 0 THEN '1999' || {_MON2} || {_DAY2} ELSE '1999-' || {_MON2} || '-' || {_DAY2} END", "date", "en", "ymd", "", "count(*) FILTER (len({c}) = 10) > 0", ()),
    "odd days": (f"CASE WHEN id % 10 = 0 THEN '1900-01-01' WHEN id % 10 = 1 THEN '1850-02-03' WHEN id % 10 = 2 THEN '2040-01-01' ELSE '1999-' || {_MON2} || '-' || {_DAY2} END", "date", "en", "ymd", "future-dates,implausible-dates,sentinel-dates", "count(DISTINCT id % 10) = 10", ("{c} > '2001-01-02'", "{c} < '1900'", "{c} = '1900-01-01'")),
    "some missing": (f"CASE WHEN id % 5 = 0 THEN '' ELSE {_WORD} END", "categorical", "en", None, "missing-values", "count(*) FILTER ({c} = '') BETWEEN 0.1 * count(*) AND 0.49 * count(*)", ()),
    "prose": ("'remark of visitor ' || translate(CAST(id + 1000 AS STRING), '0123456789', 'abcdefghij') || ' here'", "text", "en", None, "high-cardinality", "count(DISTINCT {c}) > greatest(50, 0.95 * count(*))", ()),
    "slips": (f"CASE WHEN id = 7 THEN 'maplee' ELSE {_WORD} END", "categorical", "en", None, "near-duplicate-labels", "count(*) FILTER ({c} = 'maplee') = 1 AND count(*) FILTER ({c} = 'maple') > 20", ()),
    "quantity": ("CAST(id % 9 - 1 AS STRING)", "numeric", "en", None, "numeric-sentinel,unexpected-negative", "count(*) FILTER ({c} = '-1') >= 0.01 * count(*)", ("{c} = '-1'", "{c} LIKE '-%'")),
    "far off": ("CASE WHEN id = 11 THEN '100000' ELSE CAST(100 + id % 17 AS STRING) END", "numeric", "en", None, "outliers", "abs(0.6745 * (100000 - median(CAST({c} AS DOUBLE)))) > 6 * mad(CAST({c} AS DOUBLE))", ("{c} = '100000'",)),
    "phone": ("'+1 555 ' || " + _PAD("id % 1000", 3) + " || ' 0199'", "text", "en", None, "formula-injection,sensitive-column-name,sensitive-data", "count(DISTINCT {c}) >= 0.5 * least(count(*), 1000) AND count(DISTINCT {c}) <= 0.95 * count(*)", ("{c} LIKE '+%'", "regexp_matches({c}, '^[+][0-9][0-9 ]+[0-9]$')")),
    "cards": (_one_of("4111111111111111", "5500005555555559"), "numeric", "en", None, "sensitive-data", _ALL, ("len({c}) = 16",)),
    "run": (f"CASE WHEN id % 50 = 0 THEN '=SUM(A1)' ELSE {_WORD} END", "categorical", "en", None, "formula-injection", "count(*) FILTER ({c} LIKE '=%') > 0", ("{c} LIKE '=%'",)),
}
_KIND_COLUMNS = {k: v[0] for k, v in KINDS.items()}


def _kind_row(k: int, name: str, kind: str, convention: str | None, order: str | None, codes: str, holds: str, hits: tuple) -> str:
    c = f"c{k}"
    counts = " || ',' || ".join(f"CAST(count(*) FILTER ({h.format(c=c)}) AS VARCHAR)" for h in hits) or "''"
    own = [f"CASE WHEN {holds.format(c=c)} THEN {x} END" for x in (_text(kind), _text(convention), _text(order), _text(codes), counts)]
    return f"SELECT {_text(name)} AS column_name, {own[0]} AS kind, {own[1]} AS convention, {own[2]} AS date_order, {own[3]} AS codes, {own[4]} AS counts FROM d"


@register("kind_decisions", f"WITH {cells(_KIND_COLUMNS)} " + " UNION ALL ".join(_kind_row(k, name, *v[1:]) for k, (name, v) in enumerate(KINDS.items())))
def kind_decisions(spark, sf_dir):
    done = profile(planted(spark, sf_dir, _KIND_COLUMNS), NOW)
    by: dict[str | None, list[Finding]] = {}
    for f in C.run_checks(done, Config(ignore=["candidate-key"])):
        by.setdefault(f.column, []).append(f)
    rows = [(p.name, p.kind, p.number_reading.value, p.date_reading.value if p.kind == "date" else None, ",".join(sorted(f.code for f in by.get(p.name, []))), _counts(by.get(p.name, []))) for p in done.columns]
    return spark.createDataFrame(rows, "column_name string, kind string, convention string, date_order string, codes string, counts string")


# --- twenty-eight damages ------------------------------------------------------------------------------

_AMOUNT = "CAST(100 + (id * 7) % 400 AS STRING) || '.' || " + _PAD("id % 100", 2)
_ISO = f"'2024-' || {_MON2} || '-' || {_DAY2}"
_REGION = _one_of("North", "South", "East", "West")
CLEAN = {
    "id": "'A-' || CAST(1000 + id AS STRING)",
    "date": _ISO,
    "region": _REGION,
    "customer": _one_of("Ashgrove", "Brindle", "Calder", "Dunmore", "Elstow"),
    "amount": _AMOUNT,
    "postcode": "CAST(10000 + (id * 137) % 80000 AS STRING)",
    "note": _one_of("delivered", "collected", "held at depot", "signature required"),
}


def _where(hit: str, then: str, otherwise: str) -> str:
    return f"CASE WHEN {hit} THEN {then} ELSE {otherwise} END"


#: damage to a column: (rows damaged, what stands there, what stands elsewhere, code that must be reported)
DAMAGE = {
    "currency signs": ("id % 4 = 0", "'$' || " + _AMOUNT, _AMOUNT, "number-as-text"),
    "thousands": ("id % 4 = 0", "'1,2' || " + _PAD("id % 100", 2) + " || '.50'", _AMOUNT, "number-as-text"),
    "european decimals": ("id >= 0", f"replace({_AMOUNT}, '.', ',')", _AMOUNT, "european-numbers"),
    "mixed decimals": ("id % 2 = 0", f"replace({_AMOUNT}, '.', ',')", _AMOUNT, "conflicting-number-formats"),
    "text among numbers": ("id % 20 = 0", "'see note'", _AMOUNT, "mixed-types"),
    "numeric sentinel": ("id % 15 = 0", "'-999'", _AMOUNT, "numeric-sentinel"),
    "extreme value": ("id = 30", "'9876543.21'", _AMOUNT, "outliers"),
    "zero-padded codes": ("id >= 0", "'0' || CAST(1000 + (id * 137) % 8000 AS STRING)", "'1'", "leading-zeros"),
    "blanked": ("id % 3 = 0", "''", _REGION, "missing-values"),
    "nulls as words": ("id % 6 = 0", "'N/A'", _REGION, "disguised-null"),
    "emptied": ("id >= 0", "''", _REGION, "empty-column"),
    "one value": ("id >= 0", "'GBP'", _REGION, "constant-column"),
    "casing": ("id % 8 = 0", f"upper({_REGION})", _REGION, "label-variants"),
    "rare typo": ("id = 5", "'Northh'", _REGION, "near-duplicate-labels"),
    "padding": ("id % 7 = 0", f"{_REGION} || '  '", _REGION, "whitespace"),
    "wrong encoding": ("id % 9 = 0", "'Caf' || chr(195) || chr(169)", _REGION, "mojibake"),
    "undecidable dates": ("id >= 0", _PAD("id % 11 + 1", 2) + " || '/' || " + _PAD("(id + 4) % 11 + 1", 2) + " || '/2024'", _ISO, "ambiguous-dates"),
    "conflicting dates": ("id % 2 = 0", "'25/03/2024'", "'03/26/2024'", "conflicting-date-formats"),
    "future dates": ("id % 20 = 0", "'2091-05-06'", _ISO, "future-dates"),
    "placeholder dates": ("id % 12 = 0", "'1900-01-01'", _ISO, "sentinel-dates"),
}
_DAMAGED = {k: _where(*v[:3]) for k, v in DAMAGE.items()}
#: damage to the table: (code, rows damaged, what the table is then)
ROWS = {"repeated rows": ("duplicate-rows", "id % 100 = 3"), "repeated key": ("key-not-unique", "id % 100 = 9")}
NAMES = {"doubled name": ("duplicate-column-name", 2, "id"), "no name": ("unnamed-column", 1, ""), "names that differ in case": ("similar-column-names", 1, "ID")}
FILES = {"ragged row": "ragged-rows", "byte-order mark": "bom", "two line ends": "mixed-line-endings"}
_COUNTED = {"mixed-types", "numeric-sentinel", "outliers", "leading-zeros", "disguised-null", "whitespace", "mojibake", "future-dates", "sentinel-dates"}


def _damage_sql() -> str:
    rows = [f"SELECT '{k}' AS damage, CASE WHEN count(*) FILTER ({hit}) > 0 THEN '{code}' END AS code, {f'count(*) FILTER ({hit})' if code in _COUNTED else 'CAST(NULL AS BIGINT)'} AS n FROM t" for k, (hit, _, _, code) in DAMAGE.items()]
    rows += [f"SELECT '{k}', CASE WHEN count(*) FILTER ({hit}) > 0 THEN '{code}' END, count(*) FILTER ({hit}) FROM t" for k, (code, hit) in ROWS.items()]
    rows += [f"SELECT '{k}', CASE WHEN count(*) > 0 THEN '{code}' END, NULL FROM t" for k, (code, *_) in NAMES.items()]
    hits = {"ragged row": "count(*) FILTER (id % 10 = 7)", "byte-order mark": "NULL", "two line ends": "NULL"}
    rows += [f"SELECT '{k}', CASE WHEN count(*) > 0 THEN '{code}' END, {hits[k]} FROM t" for k, code in FILES.items()]
    return "WITH t AS (SELECT o_orderkey AS id FROM orders) " + " UNION ALL ".join(rows) + " UNION ALL SELECT 'none', '', NULL"


@register("planted_damage", _damage_sql())
def planted_damage(spark, sf_dir):
    """Each of 28 damages is found and nothing is found in the clean table (its only row has no code)."""
    from .files import damaged_files

    now, config = NOW.replace(year=2025), Config(key=["id"])
    out, codes = [], {}
    for f in C.run_checks(profile(planted(spark, sf_dir, _DAMAGED), now), Config()):
        codes.setdefault((f.column, f.code), f.detail.get("count"))
    out += [(k, code if (k, code) in codes else None, codes.get((k, code)) if code in _COUNTED else None) for k, (*_, code) in DAMAGE.items()]
    clean = planted(spark, sf_dir, CLEAN)
    again = clean.df.where("(row_no % 100) = 3").withColumn("row_no", F.col("row_no") + 10**9)
    twice = TextTable(clean.df.unionByName(again), clean.header)
    keyed = TextTable(clean.df.withColumn("c0", F.expr("CASE WHEN row_no % 100 = 9 THEN 'A-' || CAST(1000 + row_no - 1 AS STRING) ELSE c0 END")), clean.header)
    for (name, (code, _)), table, check, count in zip(ROWS.items(), (twice, keyed), (C.duplicate_rows, C.key), ("extra_rows", "repeated"), strict=True):
        found = [f for f in check(profile(table, now), config) if f.code == code]
        out.append((name, found[0].code if found else None, found[0].detail[count] if found else None))
    whole = profile(clean, now)
    noise = sorted({f.code for f in C.run_checks(whole, config) if f.severity != "info"})
    for name, (code, k, to) in NAMES.items():
        whole.table = TextTable(clean.df, [*clean.header[:k], to, *clean.header[k + 1 :]])
        out.append((name, next((f.code for f in C.header(whole, config) if f.code == code), None), None))
    for name, table in damaged_files(spark, sf_dir).items():
        found = next((f for f in table.findings if f.code == FILES[name]), None)
        out.append((name, found and found.code, found.detail["count"] if found and name == "ragged row" else None))
    out.append(("none", ",".join(noise), None))
    return spark.createDataFrame(out, "damage string, code string, n long")


# --- headers, empty tables, silence, redaction ----------------------------------------------------------


@register("header_checks", """WITH s AS (SELECT min(o_orderstatus) AS a FROM orders) SELECT code, severity, column_name FROM (
SELECT 'duplicate-column-name' AS code, 'error' AS severity, a AS column_name FROM s UNION ALL SELECT 'padded-column-name', 'warning', ' ' || lower(a) || ' ' FROM s UNION ALL
SELECT 'similar-column-names', 'warning', NULL FROM s WHERE lower(a) <> a UNION ALL SELECT 'unnamed-column', 'warning', NULL FROM s UNION ALL SELECT 'formula-injection', 'warning', '=' || a FROM s)""")
def header_checks(spark, sf_dir):
    """Names taken from the table's own values."""
    a = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.min("o_orderstatus")).first()[0]
    table = planted(spark, sf_dir, dict.fromkeys("abcde", "'x'"), header=[a, f" {a.lower()} ", a, "", f"={a}"])
    return spark.createDataFrame([(f.code, f.severity, f.column) for f in C.header(profile(table, NOW), Config())], "code string, severity string, column_name string")


@register("no_rows", "SELECT 'no-data-rows' AS code WHERE (SELECT count(*) FROM orders WHERE o_orderkey < 0) = 0")
def no_rows(spark, sf_dir):
    return spark.createDataFrame([(f.code,) for f in C.run_checks(profile(planted(spark, sf_dir, {"a": "'x'"}, "id < 0"), NOW))], "code string")


_PADDED = {f"w{k}": _where(f"id % {k + 2} = 0", f"'  x' || CAST(id % 3 AS STRING)", "'y'") for k in range(10)}


@register("collapsed_findings", f"WITH {cells(_PADDED)}, f AS (" + " UNION ALL ".join(f"SELECT {k} AS k FROM d HAVING count(*) FILTER (c{k} LIKE ' %') > 0" for k in range(10)) + ") SELECT 'whitespace' AS code, CAST(NULL AS VARCHAR) AS column_name, count(*) AS n FROM f HAVING count(*) > 8")
def collapsed_findings(spark, sf_dir):
    found = collapse(C.whitespace(profile(planted(spark, sf_dir, _PADDED), NOW), Config()))
    return spark.createDataFrame([(f.code, f.column, f.detail.get("collapsed")) for f in found], "code string, column_name string, n long")


_SHY = {"mail": "'  u' || CAST(id % 20 AS STRING) || '@example.com'", "word": "CASE WHEN id % 2 = 0 THEN '  w' ELSE 'w' END"}


@register("redacted_findings", f"""WITH {cells(_SHY)} SELECT code, column_name, examples, n FROM (
SELECT 'sensitive-data' AS code, 'mail' AS column_name, '' AS examples, count(*) FILTER (c0 LIKE '%@%') AS n FROM d UNION ALL
SELECT 'whitespace', 'mail', '', count(*) FILTER (c0 LIKE ' %') FROM d UNION ALL
SELECT 'whitespace', 'word', '''' || min(c1) || '''', count(*) FILTER (c1 LIKE ' %') FROM d UNION ALL
SELECT 'duplicate-rows', NULL, '', (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM d GROUP BY c0, c1))) WHERE n > 0""")
def redacted_findings(spark, sf_dir):
    """Neither a private column's cells nor whole rows are shown; counts stay."""
    done = profile(planted(spark, sf_dir, _SHY), NOW)
    found = redact(C.sensitive_data(done, Config()) + C.whitespace(done, Config()) + C.duplicate_rows(done, Config()), C.sensitive_columns(done))
    return spark.createDataFrame([(f.code, f.column, "; ".join(f.examples), f.detail.get("count", f.detail.get("extra_rows"))) for f in found], "code string, column_name string, examples string, n long")


_QUIET = {"a": "CASE WHEN id % 2 = 0 THEN ' x' ELSE 'x' END", "b": "CASE WHEN id % 3 = 0 THEN ' y' ELSE 'y' END"}


@register("silenced_findings", f"""WITH {cells(_QUIET)} SELECT code, column_name, n FROM (
SELECT 'whitespace' AS code, 'b' AS column_name, count(*) FILTER (c1 LIKE ' %') AS n FROM d UNION ALL
SELECT 'label-variants', 'a', (SELECT count(*) FROM (SELECT trim(c0) FROM d GROUP BY 1 HAVING count(DISTINCT c0) > 1))) WHERE n > 0""")
def silenced_findings(spark, sf_dir):
    """Without the codes that a configuration silences, everywhere or in one column."""
    config = parse({"ignore": ["duplicate-rows"], "ignore_columns": {"a": ["whitespace"], "b": ["label-variants"]}})
    found = C.run_checks(profile(planted(spark, sf_dir, _QUIET), NOW), config)
    return spark.createDataFrame([(f.code, f.column, f.detail.get("count", f.detail.get("groups"))) for f in found], "code string, column_name string, n long")


@register("configurations", """SELECT m, m / 12.0 <= 0.5 AS null_warn, m / 12.0 >= 0.1 AS null_error, m <= 6 AS value_range, status IN ('F') AS role
FROM (SELECT month(o_orderdate) AS m, min(o_orderstatus) AS status FROM orders GROUP BY 1)""")
def configurations(spark, sf_dir):
    """Settings made of the table's values: thresholds that cross, bounds that cross, roles that there are not."""

    def accepted(data: dict) -> bool:
        try:
            parse(data)
        except ConfigError:
            return False
        return True

    months = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.month("o_orderdate").alias("m")).agg(F.min("o_orderstatus").alias("s")).collect()  # twelve
    roles = {"F": "measure"}
    rows = [(r["m"], accepted({"null_warn": r["m"] / 12}), accepted({"null_error": r["m"] / 12}), accepted({"columns": {"a": {"min_value": r["m"], "max_value": 6}}}), accepted({"columns": {"a": {"role": roles.get(r["s"], r["s"])}}})) for r in months]
    return spark.createDataFrame(rows, "m long, null_warn boolean, null_error boolean, value_range boolean, role boolean")


# --- drift between two versions of a table ---------------------------------------------------------------

_OLD = {"order_id": "CAST(id AS STRING)", "state": _one_of("new", "open", "shut"), "price": "CAST(100 + id % 50 AS STRING)", "size": "CAST(id % 70 AS STRING)", "mark": _WORD, "gone": "'x' || CAST(id % 4 AS STRING)"}
_NEW = {"order_id": "CAST(id AS STRING)", "price": "CAST(300 + id % 50 AS STRING)", "state": _one_of("new", "open", "held", "lost"), "size": "CASE WHEN id % 10 < 9 THEN 'size ' || CAST(id % 70 AS STRING) ELSE 'none left' END", "mark": f"CASE WHEN id % 3 = 0 THEN '' ELSE {_WORD} END", "added": "'y' || CAST(id % 4 AS STRING)"}
_HALF = "id % 3 = 0"


@register("drift_findings", f"""WITH {cells(_OLD, "o", _HALF)}, {cells(_NEW, "n")}, fresh AS (SELECT c2 AS v FROM n EXCEPT SELECT c1 FROM o), lost AS (SELECT c1 AS v FROM o EXCEPT SELECT c2 FROM n)
SELECT code, severity, column_name, n, examples FROM (
SELECT 'column-removed' AS code, 'error' AS severity, 'gone' AS column_name, NULL AS n, '' AS examples UNION ALL SELECT 'column-added', 'info', 'added', NULL, '' UNION ALL SELECT 'column-order-changed', 'warning', NULL, NULL, '' UNION ALL
SELECT 'new-category', 'warning', 'state', count(*), string_agg(v, ',' ORDER BY v) FROM fresh HAVING count(*) > 0 UNION ALL
SELECT 'missing-category', 'info', 'state', count(*), string_agg(v, ',' ORDER BY v) FROM lost HAVING count(*) > 0 UNION ALL
SELECT 'distribution-shift', 'warning', 'price', NULL, '' WHERE (SELECT median(CAST(c1 AS DOUBLE)) FROM n) >= 1.25 * (SELECT median(CAST(c2 AS DOUBLE)) FROM o) UNION ALL
SELECT 'type-changed', 'error', 'size', NULL, '' WHERE (SELECT count(*) FROM n WHERE regexp_matches(c3, '^[0-9]+$')) = 0 UNION ALL
SELECT 'null-rate-jump', 'warning', 'mark', NULL, '' WHERE (SELECT count(*) FILTER (c4 = '') / count(*) FROM n) - (SELECT count(*) FILTER (c4 = '') / count(*) FROM o) >= 0.1 UNION ALL
SELECT 'row-count-shift', 'warning', NULL, NULL, '' WHERE (SELECT count(*) FROM n) >= 1.5 * (SELECT count(*) FROM o))""")
def drift_findings(spark, sf_dir):
    found = compare(profile(planted(spark, sf_dir, _OLD, _HALF), NOW), profile(planted(spark, sf_dir, _NEW), NOW))
    return spark.createDataFrame([(f.code, f.severity, f.column, f.detail.get("count"), ",".join(f.examples)) for f in found], "code string, severity string, column_name string, n long, examples string")


# --- policies ---------------------------------------------------------------------------------------------

_RULED = {"word": "CASE WHEN id % 5 = 0 THEN 'n/a' WHEN id % 5 = 1 THEN 'odd' ELSE 'even' END", "open": "CAST(id % 900 + 1 AS STRING) || ',' || " + _PAD("id % 1000", 3), "share": "CASE WHEN id % 4 = 0 THEN '5%' ELSE '7' END", "size": "CASE WHEN id % 10 = 0 THEN 'large' ELSE CAST(id AS STRING) END"}


@register("policy_findings", f"""WITH {cells(_RULED)} SELECT code, column_name, n FROM (
SELECT 'required-column-missing' AS code, 'absent' AS column_name, NULL AS n UNION ALL
SELECT 'required-value-missing', 'word', count(*) FILTER ({_is_null('c0')}) FROM d UNION ALL
SELECT 'value-not-allowed', 'word', count(*) FILTER (c0 = 'odd') FROM d UNION ALL
SELECT 'range-unverifiable', 'open', NULL FROM d HAVING count(*) = count(*) FILTER (regexp_matches(c1, '^[0-9]+,[0-9]{{3}}$')) UNION ALL
SELECT 'range-unverifiable', 'share', count(*) FILTER (c2 LIKE '%\\%' ESCAPE '\\') FROM d UNION ALL
SELECT 'range-nonnumeric', 'size', count(*) FILTER (TRY_CAST(c3 AS DOUBLE) IS NULL) FROM d UNION ALL
SELECT 'value-out-of-range', 'size', count(*) FILTER (TRY_CAST(c3 AS DOUBLE) > 10) FROM d) WHERE n IS NULL OR n > 0""")
def policy_findings(spark, sf_dir):
    rules = {"absent": ColumnPolicy(required=True), "word": ColumnPolicy(required=True, allowed_values=["even"]), "open": ColumnPolicy(max_value=5), "share": ColumnPolicy(min_value=0), "size": ColumnPolicy(max_value=10)}
    found = C.policies(profile(planted(spark, sf_dir, _RULED), NOW), Config(columns=rules))
    return spark.createDataFrame([(f.code, f.column, f.detail.get("count")) for f in found], "code string, column_name string, n long")


# --- what is refused, and what may not be written -----------------------------------------------------------

#: column: (expression, rule refused, rows that give the reason)
REFUSED = {
    "note": ("CASE WHEN id % 9 = 0 THEN 'Caf' || chr(195) || chr(169) ELSE 'plain' END", "mojibake", "contains({c}, chr(195))"),
    "mail": ("' u' || CAST(id AS STRING) || '@example.com'", "sensitive-value-preserved", "{c} LIKE ' %@%'"),
    "half": ("CASE WHEN id % 10 = 0 THEN 'none yet' ELSE CAST(id AS STRING) END", "mixed-types", "TRY_CAST({c} AS DOUBLE) IS NULL"),
    "dates": (_LOW, "iso-date", "CAST({c}[1:2] AS INT) <= 12 AND CAST({c}[4:5] AS INT) <= 12"),
    "both": ("CASE WHEN id % 2 = 0 THEN '1,500.25' ELSE '1.500,25' END", "plain-number", "{c} LIKE '%,25'"),
    "run": ("CASE WHEN id % 30 = 3 THEN '=A1' ELSE ' x' END", "formula-injection", "{c} LIKE '=%'"),
    "share": ("CASE WHEN id % 4 = 0 THEN '5%' ELSE '7' END", "plain-number", "right({c}, 1) = '%'"),
}
_REFUSED = {k: v[0] for k, v in REFUSED.items()}


@register("repair_refusals", f"WITH {cells(_REFUSED)} " + " UNION ALL ".join(f"SELECT '{k}' AS column_name, '{rule}' AS rule FROM d HAVING count(*) FILTER ({hit.format(c=f'c{i}')}) > 0" for i, (k, (_, rule, hit)) in enumerate(REFUSED.items())))
def repair_refusals(spark, sf_dir):
    out = P.plan(profile(planted(spark, sf_dir, _REFUSED), NOW), None, "medium")
    return spark.createDataFrame([(r.column, r.rule) for r in out.refusals], "column_name string, rule string")


_GATED = {"word": "CASE WHEN id % 10 = 1 THEN 'abc' ELSE 'abd' END", "sum": "CASE WHEN id % 7 = 0 THEN '=1+1' ELSE ' 12' END"}


@register("write_gates", f"WITH {cells(_GATED)} SELECT 'header-hazard' AS gate, count(*) FILTER (c1 LIKE '=%') AS formulas, count(*) FILTER (c1 LIKE ' %') AS untouched FROM d WHERE (SELECT count(*) FROM orders) > 0")
def write_gates(spark, sf_dir):
    """A name that would run stops a write; columns with formulas are left as they are, so that a repair makes none."""
    table = planted(spark, sf_dir, _GATED, header=["=word", "sum"])
    out = P.plan(profile(table, NOW), None, "medium")
    kept = out.every_row.agg(F.count_if(F.col("r1").startswith("=")).alias("formulas"), F.count_if(F.col("r1").startswith(" ")).alias("untouched"))
    gates = spark.createDataFrame([(g,) for g in P.hazards(out)], "gate string")
    return gates.join(kept)


# --- values of every sort ---------------------------------------------------------------------------------

_SORTS = _where("id % 8 = 0", "' YES '", _where("id % 8 = 1", "'f'", _where("id % 8 = 2", "'maybe'", _where("id % 8 = 3", "'+44 20 7946 ' || " + _PAD("id % 10000", 4), _where("id % 8 = 4", "'(555) 010-' || " + _PAD("id % 10000", 4), _where("id % 8 = 5", "'555-010-' || " + _PAD("id % 10000", 4), _where("id % 8 = 6", "CAST(id AS STRING)", "''")))))))


@register("text_predicates", f"""WITH {cells({"v": _SORTS})}, p AS (SELECT trim(c0) AS v FROM d) SELECT count(*) AS n, count(*) FILTER (lower(v) IN ('yes', 'true', 'y', 't')) AS yes, count(*) FILTER (lower(v) IN ('no', 'false', 'n', 'f')) AS no,
count(*) FILTER (regexp_matches(v, '^[+][0-9][0-9 ().-]{{6,16}}[0-9]$')) AS international, count(*) FILTER (regexp_matches(v, '^[(]?[0-9]{{3}}[)]?[ .-][0-9]{{3}}[ .-][0-9]{{4}}$')) AS local,
count(*) FILTER (lower(v) IN ('yes', 'true', 'y', 't', 'no', 'false', 'n', 'f')) AS booleans FROM p""")
def text_predicates(spark, sf_dir):
    from ..functions import text as X

    v = F.col("c0")
    return planted(spark, sf_dir, {"v": _SORTS}).df.agg(
        F.count("*").alias("n"), F.count_if(X.parse_bool(v)).alias("yes"), F.count_if(~X.parse_bool(v)).alias("no"),
        F.count_if(X.is_international_phone(v)).alias("international"), F.count_if(X.is_local_phone(v)).alias("local"), F.count_if(X.is_boolean(v)).alias("booleans"),
    )


_NAMED = "CASE o_orderstatus WHEN 'F' THEN 'Customer' WHEN 'O' THEN 'order' ELSE 'e' END || " + _one_of("_id", " No", "-Mail", "mail address", " Key", "id", "mail", "_code")


@register("name_predicates", f"""WITH n AS (SELECT DISTINCT {_NAMED} AS name FROM (SELECT *, o_orderkey AS id FROM orders)), p AS (SELECT name, trim(regexp_replace(lower(name), '[ _-]+', ' ', 'g')) AS plain FROM n)
SELECT name, plain IN ('id', 'key', 'code', 'uuid', 'guid', 'ref') OR plain LIKE '% id' OR plain LIKE '% key' OR plain LIKE '% code' OR (plain LIKE '%id' AND len(plain) <= 12) AS id_like, plain IN ('email', 'email address') AS sensitive FROM p""")
def name_predicates(spark, sf_dir):
    """Names made of the table's values; there are 24 at most."""
    from ..functions.text import names_identifier, plain_name

    names = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("id", F.col("o_orderkey")).select(F.expr(_NAMED).alias("name")).distinct().collect()
    return spark.createDataFrame([(r["name"], names_identifier(r["name"]), plain_name(r["name"]) in C.SENSITIVE_NAMES) for r in names], "name string, id_like boolean, sensitive boolean")


_A, _B, _C3 = "CAST(id % 9 + 1 AS STRING)", _PAD("id % 1000", 3), _PAD("(id * 7) % 1000", 3)
_SHAPES = "CASE id % 10 " + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate((f"{_A} || ',' || {_B} || ',' || {_C3}", f"{_A} || '.' || {_B} || '.' || {_C3}", f"{_A} || ',' || {_B}", f"{_A} || '.' || {_B}", f"{_A} || ',' || {_B} || '.5'", f"{_A} || '.' || {_B} || ',5'", f"{_A} || '.5'", f"{_A} || ',5'", _A, f"'x' || {_A}"))) + " END"


@register("number_evidence_kinds", f"""WITH {cells({"v": _SHAPES})} SELECT CASE
WHEN regexp_matches(c0, '^[0-9]{{1,3}},[0-9]{{3}}$') THEN 'group-en' WHEN regexp_matches(c0, '^[0-9]{{1,3}}[.][0-9]{{3}}$') THEN 'group-eu'
WHEN regexp_matches(c0, '^[0-9]{{1,3}}(,[0-9]{{3}}){{2,}}$|^[0-9]{{1,3}}(,[0-9]{{3}})*[.][0-9]{{1,2}}$') THEN 'en' WHEN regexp_matches(c0, '^[0-9]{{1,3}}([.][0-9]{{3}}){{2,}}$|^[0-9]{{1,3}}([.][0-9]{{3}})*,[0-9]{{1,2}}$') THEN 'eu'
WHEN regexp_matches(c0, '^[0-9]+$') THEN 'neutral' END AS evidence, count(*) AS n FROM d GROUP BY 1""")
def number_evidence_kinds(spark, sf_dir):
    from ..functions import numbers as N

    v = F.col("c0")
    return planted(spark, sf_dir, {"v": _SHAPES}).df.groupBy(N.evidence(N.parse_number(v), N.parse_number(v, "eu")).alias("evidence")).agg(F.count("*").alias("n"))
