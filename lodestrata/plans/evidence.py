"""Queries of findings, profiles, references, dates, sinks and the stream, over the given tables and a dirty copy."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import checks as C
from ..operators import repair as P
from ..operators import report
from ..operators.config import ColumnPolicy, Config
from ..operators.drift import compare
from ..operators.findings import Finding, exit_code, ordered, summary
from ..operators.initialize import learn
from ..operators.profile import profile, profile_frame
from ..operators.references import Reference, check_reference
from ..sources import sinks
from ..sources.tables import LoadError, TextTable, from_dataframe
from ..streaming.monitor import windowed_health
from .catalog import register, shared_path
from .dirt import cte, dirty
from .quality import _FIXED, _REFS, NOW, _halves, _is_null, _norm, _strip


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"CAST({value} AS {'DOUBLE' if isinstance(value, float) else 'BIGINT'})"


def values(names: str, rows: list[tuple]) -> str:
    """SQL of a table given row by row."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) AS t({names})"


# --- findings of the dirty orders, drift and references -----------------------------------------------

_PROBLEM = lambda c: f"{_strip(c)} <> '' AND ({c} <> {_strip(c)} OR regexp_matches({c}, '  '))"
_FOUND = f"""WITH {cte('orders')}, t AS (
SELECT 'mixed-types' AS code, 'error' AS severity, 'cust' AS column_name, count(*) FILTER (cust LIKE 'X%') AS n FROM d UNION ALL
SELECT 'mojibake', 'error', 'note', count(*) FILTER (contains(note, chr(195) || chr(169))) FROM d UNION ALL
SELECT 'whitespace', 'warning', 'cust', count(*) FILTER ({_PROBLEM('cust')}) FROM d UNION ALL
SELECT 'whitespace', 'warning', 'priority', count(*) FILTER ({_PROBLEM('priority')}) FROM d UNION ALL
SELECT 'disguised-null', 'warning', 'priority', count(*) FILTER ({_is_null('priority')} AND {_strip('priority')} <> '') FROM d UNION ALL
SELECT 'disguised-null', 'warning', 'total', count(*) FILTER ({_is_null('total')} AND {_strip('total')} <> '') FROM d UNION ALL
SELECT 'label-variants', 'warning', 'priority', count(*) FROM (SELECT 1 FROM d WHERE NOT {_is_null('priority')} GROUP BY {_norm('priority')} HAVING count(DISTINCT priority) > 1) UNION ALL
SELECT 'number-as-text', 'warning', 'total', count(*) FILTER (regexp_matches(total, '[$,(]')) FROM d UNION ALL
SELECT 'numeric-sentinel', 'warning', 'total', count(*) FILTER (total = '-999') FROM d UNION ALL
SELECT 'future-dates', 'warning', 'day', count(*) FILTER (CASE WHEN contains(day, '-') THEN strptime(day, '%Y-%m-%d') ELSE strptime(day, '%d/%m/%Y') END > TIMESTAMP '2001-01-02') FROM d UNION ALL
SELECT 'mixed-date-formats', 'warning', 'day', count(*) FILTER (contains(day, '-')) FROM d UNION ALL
SELECT 'leading-zeros', 'warning', 'zip', count(*) FILTER (zip LIKE '0%') FROM d UNION ALL
SELECT 'formula-injection', 'warning', 'note', count(*) FILTER (note LIKE '=%') FROM d UNION ALL
SELECT 'sensitive-data', 'warning', 'mail', count(*) FILTER (mail LIKE '%@example.com') FROM d UNION ALL
SELECT 'unexpected-negative', 'info', 'total', count(*) FILTER (total LIKE '-%' OR total LIKE '(%') FROM d)"""


@register("findings_orders_dirty", _FOUND + " SELECT code, severity, column_name, CASE WHEN code IN ('number-as-text', 'mixed-date-formats') THEN NULL ELSE n END AS n FROM t WHERE n > 0")
def findings_orders_dirty(spark, sf_dir):
    found = C.run_checks(profile(dirty(spark, sf_dir, "orders"), NOW), Config(key=["order_id"]))
    return spark.createDataFrame([(f.code, f.severity, f.column, f.detail.get("count", f.detail.get("groups"))) for f in ordered(found)], "code string, severity string, column_name string, n long")


@register("findings_summary", _FOUND + " SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, CAST(1 AS BIGINT) AS exit_error, CAST(0 AS BIGINT) AS exit_never, 'mixed-types' AS first_code, 'unexpected-negative' AS last_code FROM t WHERE n > 0")
def findings_summary(spark, sf_dir):
    found = C.run_checks(profile(dirty(spark, sf_dir, "orders"), NOW), Config(key=["order_id"]))
    own, counts = ordered(found), summary(found)
    return spark.createDataFrame([(counts["error"], counts["warning"], counts["info"], exit_code(found), exit_code(found, "never"), own[0].code, own[-1].code)], "errors long, warnings long, infos long, exit_error long, exit_never long, first_code string, last_code string")


_NUMERIC = {"order_id": "CAST(order_id AS DOUBLE)", "cust": f"TRY_CAST({_strip('cust')} AS DOUBLE)", "total": f"TRY_CAST(CASE WHEN {_is_null('total')} THEN NULL WHEN total = '-999' THEN total ELSE {_FIXED} END AS DOUBLE)", "zip": "CAST(zip AS DOUBLE)"}
_KIND_OF = {"order_id": "numeric", "cust": "numeric", "priority": "categorical", "total": "numeric", "day": "date", "zip": "numeric", "note": "text", "mail": "text"}


def _profiled(c: str) -> str:
    x = _NUMERIC.get(c, "CAST(NULL AS DOUBLE)")
    # a text column of few values is a category, and how many values mail and note have depends on the table's size
    kind = _sql(_KIND_OF[c]) if c not in ("note", "mail") else f"CASE WHEN count(DISTINCT {c}) <= 20 OR count(DISTINCT {c}) <= 50 AND count(DISTINCT {c}) < 0.5 * count(*) THEN 'categorical' ELSE 'text' END"
    return f"SELECT '{c}' AS column_name, {kind} AS kind, count(*) AS n_rows, count(*) FILTER ({_is_null(c)}) AS n_null, count(*) FILTER ({_is_null(c)} AND {_strip(c)} <> '') AS n_disguised, count(DISTINCT CASE WHEN NOT {_is_null(c)} THEN {c} END) AS distinct_values, round(median({x}), 4) AS median, min({x}) AS min, max({x}) AS max, round(avg({x}), 4) AS mean FROM d"


@register("profile_orders_dirty", f"WITH {cte('orders')} " + " UNION ALL ".join(map(_profiled, _KIND_OF)))
def profile_orders_dirty(spark, sf_dir):
    out = profile_frame(profile(dirty(spark, sf_dir, "orders"), NOW))
    return out.select(F.col("column").alias("column_name"), "kind", "n_rows", "n_null", "n_disguised", F.col("distinct").alias("distinct_values"), F.round("median", 4).alias("median"), "min", "max", F.round("mean", 4).alias("mean"))


@register("init_config", """SELECT 'c_name' AS column_name, 'high-cardinality' AS code FROM customer HAVING count(*) >= 20 AND count(DISTINCT c_name) > 0.95 * count(*) UNION ALL
SELECT 'c_mktsegment', 'high-cardinality' FROM customer HAVING count(DISTINCT c_mktsegment) > greatest(50, 0.95 * count(*))""")
def init_config(spark, sf_dir):
    learnt = learn(C.run_checks(profile(from_dataframe(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name", "c_nationkey", "c_mktsegment")), NOW)))
    return spark.createDataFrame([(c, x) for c, own in learnt.ignore_columns.items() for x in own], "column_name string, code string")


@register("drift_none", "SELECT 'x' AS code WHERE false")
def drift_none(spark, sf_dir):
    """The halves of a table that did not change."""
    return spark.createDataFrame([(f.code,) for f in compare(*_halves(spark, sf_dir, ["o_orderstatus", "o_totalprice", "o_orderpriority"])) if f.code != "row-count-shift"], "code string")


@register("reference_findings", _REFS + f""", r AS (SELECT * FROM o WHERE {_norm('k')} IN (SELECT {_norm('k')} FROM f))
SELECT code, CAST(rows_ AS BIGINT) AS rows, distinct_values, first_example FROM (
SELECT 'orphaned-reference' AS code, sum(n) AS rows_, count(*) AS distinct_values, (SELECT k FROM (SELECT cust AS k, count(*) AS n, min(CAST(order_id AS BIGINT)) AS row_ FROM d GROUP BY cust) WHERE k IN (SELECT k FROM o) ORDER BY n DESC, row_ LIMIT 1) AS first_example FROM o UNION ALL
SELECT 'reference-matches-after-cleaning', sum(n), count(*), (SELECT cust FROM d WHERE cust IN (SELECT k FROM r) ORDER BY CAST(order_id AS BIGINT) LIMIT 1) FROM r UNION ALL
SELECT 'reference-null', count(*), NULL, NULL FROM d WHERE {_strip('cust')} = '')""")
def reference_findings(spark, sf_dir):
    other = from_dataframe(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"))
    found = check_reference(dirty(spark, sf_dir, "orders", ["cust"]), Reference.parse("customer:cust=c_custkey"), Config(), lambda path: other)
    return spark.createDataFrame([(f.code, f.detail.get("rows", f.detail.get("count")), f.detail.get("distinct"), f.examples[0] if f.examples else None) for f in found], "code string, rows long, distinct_values long, first_example string")


@register("outlier_examples", "WITH m AS (SELECT median(value) AS med FROM events), a AS (SELECT median(abs(value - med)) AS mad FROM events, m), z AS (SELECT value, abs(0.6745 * (value - med) / mad) AS z FROM events, m, a) SELECT DISTINCT round(value, 6) AS value FROM (SELECT value FROM (SELECT DISTINCT value, z FROM z WHERE z > 6) ORDER BY z DESC LIMIT 3) WHERE (SELECT count(*) FROM z WHERE z > 6) <= 0.05 * (SELECT count(*) FROM z)")
def outlier_examples(spark, sf_dir):
    """The values farthest off, where they are few enough to be outliers."""
    done = profile(from_dataframe(spark.read.parquet(f"{sf_dir}/events.parquet").select("value")), NOW)
    shown = [x for f in C.numeric_values(done, Config(columns={"value": ColumnPolicy(role="measure")})) if f.code == "outliers" for x in f.examples]
    return spark.createDataFrame([(float(x),) for x in shown], "value double").select(F.round("value", 6).alias("value"))


@register("first_examples", f"WITH {cte('orders')}, w AS (SELECT note, min(CAST(order_id AS BIGINT)) AS row_ FROM d WHERE contains(note, chr(195)) OR note LIKE '=%' GROUP BY note) SELECT note AS example FROM w")
def first_examples(spark, sf_dir):
    """Examples of findings are the first distinct values in row order."""
    done = profile(dirty(spark, sf_dir, "orders", ["note"]), NOW)
    found = C.formulas(done, Config()) + C.encoding(done, Config())
    return spark.createDataFrame([(x,) for f in found for x in f.examples], "example string")


# --- values -------------------------------------------------------------------------------------------

_SHORT, _LONG = "JanFebMarAprMayJunJulAugSepOctNovDec", "January  February March    April    May      June     July     August   SeptemberOctober  November December "
_Y, _M, _MM, _D, _DD = "CAST(year(o_orderdate) AS STRING)", "CAST(month(o_orderdate) AS STRING)", "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')", "CAST(day(o_orderdate) AS STRING)", "lpad(CAST(day(o_orderdate) AS STRING), 2, '0')"
_MMM, _MMMM, _YY = f"substr('{_SHORT}', CAST(month(o_orderdate) * 3 - 2 AS INT), 3)", f"trim(substr('{_LONG}', CAST(month(o_orderdate) * 9 - 8 AS INT), 9))", "substr(CAST(year(o_orderdate) AS STRING), 3, 2)"
#: a date in each of the formats: (name, expression, order)
DATE_TEXTS = [
    ("y-m-d", f"{_Y} || '-' || {_M} || '-' || {_D}", "ymd"), ("y/m/d", f"{_Y} || '/' || {_MM} || '/' || {_DD}", "ymd"), ("y-m-dTt", f"{_Y} || '-' || {_MM} || '-' || {_DD} || 'T01:02:03'", "ymd"),
    ("y-m-dTtZ", f"{_Y} || '-' || {_MM} || '-' || {_DD} || 'T01:02:03Z'", "ymd"), ("y-m-d t", f"{_Y} || '-' || {_MM} || '-' || {_DD} || ' 10:20:30'", "ymd"), ("ymd", f"{_Y} || {_MM} || {_DD}", "ymd"),
    ("d/m/y", f"{_DD} || '/' || {_MM} || '/' || {_Y}", "dmy"), ("m/d/y", f"{_MM} || '/' || {_DD} || '/' || {_Y}", "mdy"), ("d-m-y", f"{_D} || '-' || {_M} || '-' || {_Y}", "dmy"), ("m-d-y", f"{_M} || '-' || {_D} || '-' || {_Y}", "mdy"),
    ("d.m.y", f"{_DD} || '.' || {_MM} || '.' || {_Y}", "dmy"), ("d/m/yy", f"{_DD} || '/' || {_MM} || '/' || {_YY}", "dmy"), ("m/d/yy", f"{_MM} || '/' || {_DD} || '/' || {_YY}", "mdy"), ("d mon y", f"{_D} || ' ' || {_MMM} || ' ' || {_Y}", "dmy"),
    ("d-mon-y", f"{_DD} || '-' || {_MMM} || '-' || {_Y}", "dmy"), ("mon d, y", f"{_MMM} || ' ' || {_D} || ', ' || {_Y}", "mdy"), ("month d, y", f"{_MMMM} || ' ' || {_D} || ', ' || {_Y}", "mdy"), ("mon d y", f"{_MMM} || ' ' || {_D} || ' ' || {_Y}", "mdy"),
    ("month d y", f"{_MMMM} || ' ' || {_D} || ' ' || {_Y}", "mdy"), ("d month y", f"{_D} || ' ' || {_MMMM} || ' ' || {_Y}", "dmy"),
]


@register("date_formats", "SELECT f AS format, count(*) AS n, CAST(count(*) AS BIGINT) AS right_day FROM (SELECT 1 FROM orders), (VALUES " + ", ".join(f"('{n}')" for n, _, _ in DATE_TEXTS) + ") AS t(f) GROUP BY f")
def date_formats(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderdate")
    # each distinct text is read once
    cells = F.array(*[F.struct(F.lit(n).alias("format"), F.lit(o).alias("ord"), F.expr(e).alias("v")) for n, e, o in DATE_TEXTS])
    words = orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.explode(cells).alias("x")).groupBy("day", "x").agg(F.count("*").alias("n"))
    read = words.select("day", "n", "x.*", D.parse_dates(F.col("x.v")).alias("dates"))
    right = F.exists("dates", lambda r: (r["ord"] == F.col("ord")) & (F.date_format(r["ts"], "yyyy-MM-dd") == F.col("day")))
    return read.groupBy("format").agg(F.sum("n").alias("n"), F.sum(F.when(right, F.col("n")).otherwise(0)).alias("right_day"))


# --- repairs, sinks, configuration, reports -----------------------------------------------------------


@register("repair_preview", f"WITH {cte('orders')} SELECT line, n FROM (SELECT 'total: plain-number (high)' AS line, count(*) FILTER (regexp_matches(total, '[$,(]')) AS n FROM d UNION ALL SELECT 'total: blank-null (high)', count(*) FILTER ({_is_null('total')} AND total <> '') FROM d) WHERE n > 0")
def repair_preview(spark, sf_dir):
    """The lines of the text preview that tell of changes."""
    done = profile(dirty(spark, sf_dir, "orders", ["total"]), NOW)
    text = report.plan_text(P.plan(done, None, "high"))
    rows = [line.strip().rsplit("  ", 1) for line in text.splitlines() if line.startswith("  ") and "(" in line]
    return spark.createDataFrame([(a.strip(), int(b.split()[0].replace(",", ""))) for a, b in rows], "line string, n long")


@register("sink_round_trip", f"WITH {cte('orders')} SELECT {_FIXED} AS total, count(*) AS n FROM d GROUP BY 1")
def sink_round_trip(spark, sf_dir):
    out = P.plan(profile(dirty(spark, sf_dir, "orders", ["total", "zip"]), NOW), None, "medium")
    path = sinks.write_csv(out.table, ["total", "zip"], shared_path(spark, "repaired"))
    back = spark.read.schema("total string, zip string").option("escape", '"').option("emptyValue", "").csv(path)
    return back.select(F.coalesce("total", F.lit("")).alias("total")).groupBy("total").agg(F.count("*").alias("n"))


@register("audit_sink", f"WITH {cte('orders')} SELECT 'total' AS column_name, 'blank-null' AS rule, count(*) AS n, CAST(min(order_id::BIGINT) + 2 AS BIGINT) AS first_line FROM d WHERE {_is_null('total')} AND total <> '' HAVING count(*) > 0 UNION ALL SELECT '', 'source', 1, 0")
def audit_sink(spark, sf_dir):
    out = P.plan(profile(dirty(spark, sf_dir, "orders", ["total"]), NOW), None, "high")
    log = sinks.audit_log(out, "0" * 64).where("rule <> 'plain-number'")
    return log.groupBy(F.col("column").alias("column_name"), "rule").agg(F.count("*").alias("n"), F.min("line").cast("long").alias("first_line"))


@register("format_dispatch", values("path, reader", [("a.xls", "refused"), ("a.csv", "missing"), ("nation.parquet", "parquet")]))
def format_dispatch(spark, sf_dir):
    from ..sources.tables import discover, read_any

    rows = [("nation.parquet", "parquet" if len(read_any(spark, f"{sf_dir}/nation.parquet").header) else "")]
    for path, tried, outcome in (("a.xls", lambda: read_any(spark, "a.xls"), "refused"), ("a.csv", lambda: discover(spark, ["/no/such/folder/a.csv"]), "missing")):
        try:
            tried()
        except LoadError:
            rows.append((path, outcome))
    return spark.createDataFrame(rows, "path string, reader string")


# --- a stream -----------------------------------------------------------------------------------------


@register("stream_watermark", "SELECT date_trunc('hour', ts) AS start, count(*) AS n_rows, CAST(count(*) FILTER (event_id % 10 = 0) AS BIGINT) AS n_null FROM events GROUP BY 1")
def stream_watermark(spark, sf_dir):
    """Windows of a stream that reads the events' file, with a watermark, run until it has read all."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = rows.select(F.col("ts").cast("timestamp").alias("ts"), F.expr("CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE '1' END").alias("v"))
    out = shared_path(spark, "stream")
    health = windowed_health(rows, "ts", "v")

    def put(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/health")

    query = health.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(health.schema).parquet(f"{out}/health").select(F.col("start").cast("timestamp_ntz").alias("start"), "n_rows", "n_null")
