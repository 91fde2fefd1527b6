"""Small typed cases of decisions, checks, repairs, reports and readers, with what each must say beside it."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from lodestrata.functions import numbers as N
from lodestrata.functions import text as X
from lodestrata.operators import checks as C
from lodestrata.operators import repair as P
from lodestrata.operators import report
from lodestrata.operators.config import ColumnPolicy, Config, ConfigError, parse
from lodestrata.operators.drift import compare
from lodestrata.operators.findings import Finding, collapse, redact
from lodestrata.operators.profile import profile
from lodestrata.sources.tables import TextTable, quote_fault, read_csv, scan_bytes, sniff_delimiter
from lodestrata.plans.catalog import shared_path
from lodestrata.plans.quality import NOW


CASES: dict = {}


def register(name, sql):
    def add(case):
        CASES[name] = (case, sql)
        return case

    return add


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"CAST({value} AS {'DOUBLE' if isinstance(value, float) else 'BIGINT'})"


def values(names: str, rows: list[tuple]) -> str:
    """SQL of a table given row by row."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) AS t({names})"


def _made(spark, n: int, columns: dict[str, str], header: list[str] | None = None) -> TextTable:
    df = spark.range(n).select(F.col("id").alias("row_no"), *[F.expr(e).alias(f"c{i}") for i, e in enumerate(columns.values())])
    return TextTable(df, header or list(columns))


def _codes(found: list[Finding]) -> dict[str, str]:
    out: dict[str, set] = {}
    for f in found:
        out.setdefault(f.column or "", set()).add(f.code)
    return {k: ",".join(sorted(v)) for k, v in out.items()}


# --- kinds, conventions and the findings of each column ----------------------------------------------

_PAD = "lpad(CAST({} AS STRING), {}, '0')".format
_DAY2, _MON2 = _PAD("id % 28 + 1", 2), _PAD("id % 12 + 1", 2)
_WORD = "element_at(array('alder', 'birch', 'cedar', 'maple', 'rowan'), CAST(id % 5 + 1 AS INT))"
#: column: (expression, kind, convention, date order, codes)
KINDS = {
    "nothing": ("''", "empty", "en", None, "empty-column"),
    "same": ("'fixed'", "categorical", "en", None, "constant-column"),
    "flag": ("CASE WHEN id % 2 = 0 THEN 'yes' ELSE 'no' END", "boolean", "en", None, ""),
    "mostly numbers": ("CASE WHEN id % 10 = 3 THEN 'later' ELSE CAST(id * 3 AS STRING) END", "numeric", "en", None, "mixed-types"),
    "half numbers": ("CASE WHEN id % 2 = 1 THEN " + _WORD + " ELSE CAST(id * 3 AS STRING) END", "mixed", "en", None, "mixed-types"),
    "grouped": ("CAST(id + 1 AS STRING) || ',' || " + _PAD("id", 3), "numeric", None, None, "ambiguous-decimal-separator"),
    "two conventions": ("CASE WHEN id % 2 = 0 THEN CAST(id + 1 AS STRING) || ',500.25' ELSE CAST(id + 1 AS STRING) || '.500,25' END", "numeric", None, None, "conflicting-number-formats"),
    "comma": ("CAST(id + 100 AS STRING) || ',5'", "numeric", "eu", None, "european-numbers"),
    "money": ("'$' || CAST(id + 100 AS STRING)", "numeric", "en", None, "number-as-text"),
    "either day": (_PAD("id % 11 + 1", 2) + " || '/' || " + _PAD("(id + 5) % 11 + 1", 2) + " || '/1999'", "date", "en", None, "ambiguous-dates"),
    "both orders": ("CASE WHEN id % 2 = 0 THEN '25/' || " + _MON2 + " || '/1999' ELSE " + _MON2 + " || '/25/1999' END", "date", "en", None, "conflicting-date-formats"),
    "hardly proven": ("CASE WHEN id % 20 = 0 THEN '25/03/1999' ELSE " + _PAD("id % 11 + 1", 2) + " || '/' || " + _PAD("(id + 5) % 11 + 1", 2) + " || '/1999' END", "date", "en", "dmy", "weak-date-evidence"),
    "iso beside": ("CASE WHEN id % 2 = 0 THEN '1999-' || " + _MON2 + " || '-17' ELSE '17/' || " + _MON2 + " || '/1999' END", "date", "en", "dmy", "mixed-date-formats"),
    "eight digits": ("'1999' || " + _MON2 + " || " + _DAY2, "numeric", "en", None, "compact-date-or-number"),
    "eight beside": ("CASE WHEN id % 2 = 0 THEN '1999' || " + _MON2 + " || " + _DAY2 + " ELSE '1999-' || " + _MON2 + " || '-' || " + _DAY2 + " END", "date", "en", "ymd", ""),
    "odd days": ("CASE WHEN id % 10 = 0 THEN '1900-01-01' WHEN id % 10 = 1 THEN '1850-02-03' WHEN id % 10 = 2 THEN '2040-01-01' ELSE '1999-' || " + _MON2 + " || '-' || " + _DAY2 + " END", "date", "en", "ymd", "future-dates,implausible-dates,sentinel-dates"),
    "some missing": ("CASE WHEN id % 5 = 0 THEN '' ELSE " + _WORD + " END", "categorical", "en", None, "missing-values"),
    "prose": ("'remark of visitor ' || translate(CAST(id + 1000 AS STRING), '0123456789', 'abcdefghij') || ' here'", "text", "en", None, "high-cardinality"),
    "slips": ("CASE WHEN id = 7 THEN 'maplee' ELSE " + _WORD + " END", "categorical", "en", None, "near-duplicate-labels"),
    "quantity": ("CAST(id % 9 - 1 AS STRING)", "numeric", "en", None, "numeric-sentinel,unexpected-negative"),
    "far off": ("CASE WHEN id = 11 THEN '100000' ELSE CAST(100 + id % 17 AS STRING) END", "numeric", "en", None, "outliers"),
    "phone": ("'+1 555 ' || " + _PAD("id", 3) + " || ' 0199'", "text", "en", None, "formula-injection,high-cardinality,sensitive-column-name,sensitive-data"),
    "cards": ("CASE WHEN id % 2 = 0 THEN '4111111111111111' ELSE '5500005555555559' END", "numeric", "en", None, "sensitive-data"),
    "run": ("CASE WHEN id % 50 = 0 THEN '=SUM(A1)' ELSE " + _WORD + " END", "categorical", "en", None, "formula-injection"),
}
_KINDS_CONFIG = Config(ignore=["candidate-key"])


@register("kind_decisions", values("column_name, kind, convention, date_order, codes", [(k, *v[1:]) for k, v in KINDS.items()]))
def kind_decisions(spark, sf_dir):
    done = profile(_made(spark, 200, {k: v[0] for k, v in KINDS.items()}), NOW)
    codes = _codes(C.run_checks(done, _KINDS_CONFIG))
    rows = [(p.name, p.kind, p.number_reading.value, p.date_reading.value if p.kind == "date" else None, codes.get(p.name, "")) for p in done.columns]
    return spark.createDataFrame(rows, "column_name string, kind string, convention string, date_order string, codes string")


# --- planted damage ---------------------------------------------------------------------------------

_AMOUNT = "CAST(100 + (id * 7) % 400 AS STRING) || '.' || " + _PAD("id % 100", 2)
_ISO = "'2024-' || " + _MON2 + " || '-' || " + _DAY2
_REGION = "element_at(array('North', 'South', 'East', 'West'), CAST(id % 4 + 1 AS INT))"
CLEAN = {
    "id": "'A-' || CAST(1000 + id AS STRING)",
    "date": _ISO,
    "region": _REGION,
    "customer": "element_at(array('Ashgrove', 'Brindle', 'Calder', 'Dunmore', 'Elstow'), CAST(id % 5 + 1 AS INT))",
    "amount": _AMOUNT,
    "postcode": "CAST(10000 + (id * 137) % 80000 AS STRING)",
    "note": "element_at(array('delivered', 'collected', 'held at depot', 'signature required'), CAST(id % 4 + 1 AS INT))",
}
#: damage to a column: (expression, code that must be reported)
DAMAGE = {
    "currency signs": ("CASE WHEN id % 4 = 0 THEN '$' || " + _AMOUNT + " ELSE " + _AMOUNT + " END", "number-as-text"),
    "thousands": ("CASE WHEN id % 4 = 0 THEN '1,2' || " + _PAD("id", 2) + " || '.50' ELSE " + _AMOUNT + " END", "number-as-text"),
    "european decimals": ("replace(" + _AMOUNT + ", '.', ',')", "european-numbers"),
    "mixed decimals": ("CASE WHEN id % 2 = 0 THEN replace(" + _AMOUNT + ", '.', ',') ELSE " + _AMOUNT + " END", "conflicting-number-formats"),
    "text among numbers": ("CASE WHEN id % 20 = 0 THEN 'see note' ELSE " + _AMOUNT + " END", "mixed-types"),
    "numeric sentinel": ("CASE WHEN id % 15 = 0 THEN '-999' ELSE " + _AMOUNT + " END", "numeric-sentinel"),
    "extreme value": ("CASE WHEN id = 30 THEN '9876543.21' ELSE " + _AMOUNT + " END", "outliers"),
    "zero-padded codes": ("'0' || CAST(1000 + (id * 137) % 8000 AS STRING)", "leading-zeros"),
    "blanked": ("CASE WHEN id % 3 = 0 THEN '' ELSE " + _REGION + " END", "missing-values"),
    "nulls as words": ("CASE WHEN id % 6 = 0 THEN 'N/A' ELSE " + _REGION + " END", "disguised-null"),
    "emptied": ("''", "empty-column"),
    "one value": ("'GBP'", "constant-column"),
    "casing": ("CASE WHEN id % 8 = 0 THEN upper(" + _REGION + ") ELSE " + _REGION + " END", "label-variants"),
    "rare typo": ("CASE WHEN id = 5 THEN 'Northh' ELSE " + _REGION + " END", "near-duplicate-labels"),
    "padding": ("CASE WHEN id % 7 = 0 THEN " + _REGION + " || '  ' ELSE " + _REGION + " END", "whitespace"),
    "wrong encoding": ("CASE WHEN id % 9 = 0 THEN 'CafÃ©' ELSE " + _REGION + " END", "mojibake"),
    "undecidable dates": (_PAD("id % 11 + 1", 2) + " || '/' || " + _PAD("(id + 4) % 11 + 1", 2) + " || '/2024'", "ambiguous-dates"),
    "conflicting dates": ("CASE WHEN id % 2 = 0 THEN '25/03/2024' ELSE '03/26/2024' END", "conflicting-date-formats"),
    "future dates": ("CASE WHEN id % 20 = 0 THEN '2091-05-06' ELSE " + _ISO + " END", "future-dates"),
    "placeholder dates": ("CASE WHEN id % 12 = 0 THEN '1900-01-01' ELSE " + _ISO + " END", "sentinel-dates"),
}
_TABLE_DAMAGE = {"repeated rows": "duplicate-rows", "repeated key": "key-not-unique", "doubled name": "duplicate-column-name", "no name": "unnamed-column", "names that differ in case": "similar-column-names", "ragged row": "ragged-rows", "byte-order mark": "bom", "two line ends": "mixed-line-endings"}


def _at_2025():
    return NOW.replace(year=2025)


def _bytes_table(spark, content: bytes) -> TextTable:
    """A file of these bytes, written where all executors see it, read as delimited text."""
    path = shared_path(spark, "bytes")
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}.csv")
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(content))
    out.close()
    return read_csv(spark, f"{path}.csv")


@register("planted_damage", values("damage, code, found", [(k, v[1], True) for k, v in DAMAGE.items()] + [(k, v, True) for k, v in _TABLE_DAMAGE.items()] + [("none", "", True)]))
def planted_damage(spark, sf_dir):
    now, config = _at_2025(), Config(key=["id"])
    codes = _codes(C.run_checks(profile(_made(spark, 60, {k: v[0] for k, v in DAMAGE.items()}), now), Config()))
    out = [(k, v[1], v[1] in codes.get(k, "").split(",")) for k, v in DAMAGE.items()]
    clean = _made(spark, 60, CLEAN)
    names = list(CLEAN)

    def seen(code: str, table: TextTable, check=None) -> bool:
        found = check(profile(table, now, [0]), config) if check else table.findings
        return any(f.code == code for f in found)

    twice = dataclasses.replace(clean, df=clean.df.union(clean.df.where("row_no < 3").withColumn("row_no", F.col("row_no") + 60)))
    keyed = dataclasses.replace(clean, df=clean.df.withColumn("c0", F.when(F.col("row_no") == 9, "A-1001").otherwise(F.col("c0"))))
    whole = profile(clean, now)
    tables = [seen("duplicate-rows", twice, C.duplicate_rows), seen("key-not-unique", keyed, C.key)]
    for header in (["id", "date", "id", *names[3:]], ["id", "", *names[2:]], ["id", "ID", *names[2:]]):
        whole.table = dataclasses.replace(clean, header=header)
        tables.append(any(f.code in list(_TABLE_DAMAGE.values())[2:5][len(tables) - 2 : len(tables) - 1] for f in C.header(whole, config)))
    whole.table = clean
    for content in (b"a,b\n1,2\n3\n4,5\n", b"\xef\xbb\xbfa,b\n1,2\n", b"a,b\r\n1,2\r\n3,4\n"):
        tables.append(seen(list(_TABLE_DAMAGE.values())[len(tables)], _bytes_table(spark, content)))
    out += [(k, v, yes) for (k, v), yes in zip(_TABLE_DAMAGE.items(), tables, strict=True)]
    noise = sorted({f.code for f in C.run_checks(whole, config) if f.severity != "info"})
    out.append(("none", ",".join(noise), not noise))
    return spark.createDataFrame(out, "damage string, code string, found boolean")


_OLD = {"order_id": "CAST(id AS STRING)", "state": "element_at(array('new', 'open', 'shut'), CAST(id % 3 + 1 AS INT))", "price": "CAST(100 + id % 50 AS STRING)", "size": "CAST(id % 70 AS STRING)", "mark": _WORD, "gone": "'x' || CAST(id % 4 AS STRING)"}
_NEW = {"order_id": "CAST(id AS STRING)", "price": "CAST(300 + id % 50 AS STRING)", "state": "element_at(array('new', 'open', 'held', 'lost'), CAST(id % 4 + 1 AS INT))", "size": "CASE WHEN id % 10 < 9 THEN 'size ' || CAST(id % 70 AS STRING) ELSE 'none left' END", "mark": "CASE WHEN id % 3 = 0 THEN '' ELSE " + _WORD + " END", "added": "'y' || CAST(id % 4 AS STRING)"}


@register("drift_findings", values("code, severity, column_name, n", [("column-removed", "error", "gone", None), ("column-added", "info", "added", None), ("column-order-changed", "warning", None, None), ("new-category", "warning", "state", 2), ("missing-category", "info", "state", 1), ("distribution-shift", "warning", "price", None), ("type-changed", "error", "size", None), ("null-rate-jump", "warning", "mark", None), ("row-count-shift", "warning", None, None)]))
def drift_findings(spark, sf_dir):
    found = compare(profile(_made(spark, 300, _OLD), NOW), profile(_made(spark, 600, _NEW), NOW))
    return spark.createDataFrame([(f.code, f.severity, f.column, f.detail.get("count")) for f in found], "code string, severity string, column_name string, n long")


_CODES = [(f"c{i}", "'  x' || CAST(id % 3 AS STRING)") for i in range(10)]


@register("collapsed_findings", values("code, column_name, n", [("whitespace", None, 10)]))
def collapsed_findings(spark, sf_dir):
    found = collapse(C.whitespace(profile(_made(spark, 30, dict(_CODES)), NOW), Config()))
    return spark.createDataFrame([(f.code, f.column, f.detail.get("collapsed")) for f in found], "code string, column_name string, n long")


@register("redacted_findings", values("code, column_name, examples, detail", [("sensitive-data", "mail", "", "column_index,count,kind"), ("whitespace", "mail", "", "column_index,count"), ("whitespace", "word", "'  w0'", "column_index,count"), ("duplicate-rows", None, "", "extra_rows,groups")]))
def redacted_findings(spark, sf_dir):
    done = profile(_made(spark, 40, {"mail": "'  u' || CAST(id % 20 AS STRING) || '@example.com'", "word": "'  w' || CAST(id % 1 AS STRING)"}), NOW)
    found = redact(C.sensitive_data(done, Config()) + C.whitespace(done, Config()) + C.duplicate_rows(done, Config()), C.sensitive_columns(done))
    return spark.createDataFrame([(f.code, f.column, "; ".join(f.examples), ",".join(sorted(f.detail))) for f in found], "code string, column_name string, examples string, detail string")


@register("no_rows", values("code", [("no-data-rows",)]))
def no_rows(spark, sf_dir):
    return spark.createDataFrame([(f.code,) for f in C.run_checks(profile(_made(spark, 0, {"a": "'x'"}), NOW))], "code string")


@register("policy_findings", values("code, column_name, n", [("required-column-missing", "absent", None), ("required-value-missing", "word", 4), ("value-not-allowed", "word", 4), ("range-unverifiable", "open", None), ("range-unverifiable", "share", 5), ("range-nonnumeric", "size", 2), ("value-out-of-range", "size", 9)]))
def policy_findings(spark, sf_dir):
    columns = {"word": "CASE WHEN id % 5 = 0 THEN 'n/a' WHEN id % 5 = 1 THEN 'odd' ELSE 'even' END", "open": "CAST(id + 1 AS STRING) || ',' || " + _PAD("id", 3), "share": "CASE WHEN id % 4 = 0 THEN '5%' ELSE '7' END", "size": "CASE WHEN id % 10 = 0 THEN 'large' ELSE CAST(id AS STRING) END"}
    rules = {"absent": ColumnPolicy(required=True), "word": ColumnPolicy(required=True, allowed_values=["even"]), "open": ColumnPolicy(max_value=5), "share": ColumnPolicy(min_value=0), "size": ColumnPolicy(max_value=10)}
    found = C.policies(profile(_made(spark, 20, columns), NOW), Config(columns=rules))
    return spark.createDataFrame([(f.code, f.column, f.detail.get("count")) for f in found], "code string, column_name string, n long")


# --- values -------------------------------------------------------------------------------------------

_TEXTS = [(" YES ", True, False, False, True), ("f", False, False, False, True), ("maybe", None, False, False, False), ("+44 20 7946 0018", None, True, False, False), ("(555) 010-9999", None, False, True, False), ("555-010-9999", None, False, True, False), ("12", None, False, False, False), ("", None, False, False, False)]


@register("text_predicates", values("v, bool_value, international, local, is_bool", _TEXTS))
def text_predicates(spark, sf_dir):
    v = F.col("v")
    return spark.createDataFrame([(x[0],) for x in _TEXTS], "v string").select(v, X.parse_bool(v).alias("bool_value"), X.is_international_phone(v).alias("international"), X.is_local_phone(v).alias("local"), X.is_boolean(v).alias("is_bool"))


_NAMES = [("customer_id", True, False), ("Order No", False, False), ("E-Mail", False, False), ("email address", False, True), ("Date of Birth", False, True), ("quantity", False, False), ("uuid", True, False), ("paid", True, False)]


@register("name_predicates", values("name, id_like, sensitive", _NAMES))
def name_predicates(spark, sf_dir):
    return spark.createDataFrame([(n, X.names_identifier(n), X.plain_name(n) in C.SENSITIVE_NAMES) for n, _, _ in _NAMES], "name string, id_like boolean, sensitive boolean")


_NUMBERS = [("1,234,567", "en"), ("1.234.567", "eu"), ("1,234", "group-en"), ("1.234", "group-eu"), ("1,234.5", "en"), ("1.234,5", "eu"), ("12.5", "en"), ("12,5", "eu"), ("42", "neutral"), ("x1", None)]


@register("number_evidence_kinds", values("v, evidence", _NUMBERS))
def number_evidence_kinds(spark, sf_dir):
    v = F.col("v")
    return spark.createDataFrame([(x,) for x, _ in _NUMBERS], "v string").select(v, N.evidence(N.parse_number(v), N.parse_number(v, "eu")).alias("evidence"))


# --- readers ------------------------------------------------------------------------------------------

_FILES = [("plain", b"a,b\n1,2\n", ",", False, 0, 2, 0, None, False), ("semicolons", b"a;b\r\n1;2\r\n3;4\r\n", ";", False, 3, 0, 0, None, False), ("tabs", b"a\tb\n1\t2", "\t", False, 0, 1, 0, None, True), ("bars", b"a|b\n1|2\n3|4\n", "|", False, 0, 3, 0, None, False), ("marked", b"\xef\xbb\xbfa,b\n1,2\n", ",", True, 0, 2, 0, None, False), ("nuls", b"a,b\n1,\x002\n", ",", False, 0, 2, 1, None, False), ("latin", b"a,b\n\xe9,2\n", ",", False, 0, 2, 0, 4, False)]


@register("file_bytes", values("name, delimiter, bom, crlf, lf, nuls, invalid_at, ends_open", [(n, *r) for n, _, *r in _FILES]))
def file_bytes(spark, sf_dir):
    rows = []
    for name, content, *_ in _FILES:
        f = scan_bytes(content)
        rows.append((name, sniff_delimiter(content.decode("utf-8-sig" if f["invalid_at"] is None else "latin-1")), f["bom"], f["crlf"], f["lf"], f["nuls"], f["invalid_at"], f["ends_open"]))
    return spark.createDataFrame(rows, "name string, delimiter string, bom boolean, crlf long, lf long, nuls long, invalid_at long, ends_open boolean")


_QUOTES = [('a,"b"\n', None), ('a,"b\nc",d\n', None), ('a,"b""c"\n', None), ('a,b"c\n', "line 1: a quote stands inside an unquoted field"), ('a\n"b"c\n', "line 2: text follows a closing quote"), ('a\n"b\n', "line 2: a quoted field never ends")]


@register("quote_states", values("text, fault", _QUOTES))
def quote_states(spark, sf_dir):
    return spark.createDataFrame([(t, quote_fault(t, ",")) for t, _ in _QUOTES], "text string, fault string")


@register("ragged_lines", values("rows, lines, expected, example, capped", [(2, "3,5", 2, "3|", 2)]))
def ragged_lines(spark, sf_dir):
    table = _bytes_table(spark, b"a,b\n1,2\n3\n4,5\n6,7,8\n")
    f = next(f for f in table.findings if f.code == "ragged-rows")
    example = table.df.where("row_no = 1").select(F.concat_ws("|", "c0", "c1")).first()[0]
    capped = dataclasses.replace(table, df=table.df.orderBy("row_no").limit(2)).df.count()
    return spark.createDataFrame([(f.detail["count"], ",".join(map(str, f.detail["lines"])), f.detail["expected"], example, capped)], "rows long, lines string, expected long, example string, capped long")


# --- repairs, sinks, configuration, reports -----------------------------------------------------------


@register("repair_refusals", values("column_name, rule", [("note", "mojibake"), ("mail", "sensitive-value-preserved"), ("half", "mixed-types"), ("dates", "iso-date"), ("both", "plain-number"), ("run", "formula-injection"), ("share", "plain-number")]))
def repair_refusals(spark, sf_dir):
    columns = {"note": "CASE WHEN id % 9 = 0 THEN 'CafÃ©' ELSE 'plain' END", "mail": "' u' || CAST(id AS STRING) || '@example.com'", "half": "CASE WHEN id % 10 = 0 THEN 'none yet' ELSE CAST(id AS STRING) END", "dates": _PAD("id % 11 + 1", 2) + " || '/' || " + _PAD("(id + 5) % 11 + 1", 2) + " || '/1999'", "both": "CASE WHEN id % 2 = 0 THEN '1,500.25' ELSE '1.500,25' END", "run": "CASE WHEN id = 3 THEN '=A1' ELSE ' x' END", "share": "CASE WHEN id % 2 = 0 THEN '5%' ELSE '6%' END"}
    out = P.plan(profile(_made(spark, 40, columns), NOW), None, "medium")
    return spark.createDataFrame([(r.column, r.rule) for r in out.refusals], "column_name string, rule string")


@register("write_gates", values("gate", [("introduced-formula",), ("header-hazard",)]))
def write_gates(spark, sf_dir):
    """A repair that would leave a formula, and a header that is one, stop a write."""
    table = _made(spark, 20, {"word": "CASE WHEN id < 2 THEN 'abc' ELSE '-abc' END", "=A1": "'v'"})
    done = profile(table, NOW)
    for p in done.columns:  # as if the value had not been seen to be a formula before the repair
        p.facts["formula"] = 0
    return spark.createDataFrame([(g,) for g in P.hazards(P.plan(done, None, "medium"))], "gate string")


_SETTINGS = [("null_warn = 0.9 above null_error", {"null_warn": 0.9}, False), ("unknown name", {"nul_warn": 0.1}, False), ("bad severity", {"fail_on": "never mind"}, False), ("role", {"columns": {"a": {"role": "measure", "min_value": 1}}}, True), ("bounds of a text", {"columns": {"a": {"role": "text", "min_value": 1}}}, False), ("lists", {"ignore": ["bom"], "key": "id"}, True), ("true is no number", {"outlier_z": True}, False)]


@register("configurations", values("name, accepted", [(n, a) for n, _, a in _SETTINGS]))
def configurations(spark, sf_dir):
    rows = []
    for name, data, _ in _SETTINGS:
        try:
            parse(data)
            rows.append((name, True))
        except ConfigError:
            rows.append((name, False))
    return spark.createDataFrame(rows, "name string, accepted boolean")


@register("silenced_findings", values("code, column_name", [("whitespace", "b"), ("constant-column", "a"), ("constant-column", "b")]))
def silenced_findings(spark, sf_dir):
    config = parse({"ignore": ["duplicate-rows"], "ignore_columns": {"a": ["whitespace"]}})
    found = C.run_checks(profile(_made(spark, 10, {"a": "' x'", "b": "' y'"}), NOW), config)
    return spark.createDataFrame([(f.code, f.column) for f in found], "code string, column_name string")


_SHOWN = [Finding("whitespace", "warning", "a\x1b <b>, 50%", "c:1", {"column_index": 0, "count": 3}, ["' x'"]), Finding("bom", "error", "mark")]


@register("report_formats", values("format, holds", [("text", True), ("json", True), ("html", True), ("ci", True), ("batch", True), ("numbers", True)]))
def report_formats(spark, sf_dir):
    """Each format with the parts that must be in it, and without what must not."""
    a = ("f.csv", 1200, 2, _SHOWN)
    text, js, page, ci = report.text(*a), report.as_json(*a), report.as_html(*a), report.annotations("f.csv", _SHOWN)
    roll = report.rollup([("f.csv", _SHOWN), ("g.csv", _SHOWN[:1])])
    holds = {
        "text": "1,200 rows, 2 columns" in text and "\\u001b" in text and "\x1b" not in text and text.index("ERROR") < text.index("WARNING"),
        "json": '"summary": {' in js and '"error": 1' in js and js.index('"bom"') < js.index('"whitespace"'),
        "html": "&lt;b&gt;" in page and "<b>" not in page,
        "ci": ci.startswith("::error file=f.csv,title=bom::mark\n") and "50%25" in ci and "' x'" not in ci,
        "batch": roll["shared"] == [{"code": "whitespace", "files": 2}] and roll["files"]["g.csv"] == {"error": 0, "warning": 1, "info": 0},
        "numbers": (report.percent(1, 100_000), report.percent(1, 4), report.number(1234.5), report.plural(1, "row")) == ("<0.1%", "25.0%", "1,234.5", "1 row"),
    }
    return spark.createDataFrame(list(holds.items()), "format string, holds boolean")


# --- a stream -----------------------------------------------------------------------------------------


@register("header_checks", values("code, severity, column_name", [("duplicate-column-name", "error", "id"), ("padded-column-name", "warning", " ID "), ("similar-column-names", "warning", None), ("unnamed-column", "warning", None), ("formula-injection", "warning", "=A1")]))
def header_checks(spark, sf_dir):
    table = _made(spark, 3, dict.fromkeys("abcde", "'x'"), ["id", " ID ", "id", "", "=A1"])
    return spark.createDataFrame([(f.code, f.severity, f.column) for f in C.header(profile(table, NOW), Config())], "code string, severity string, column_name string")
