"""Queries for every analysis, with the SQL that states the same result."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as X
from ..operators import checks as C
from ..operators import impact as I
from ..operators import references as R
from ..operators import repair as P
from ..operators.config import ColumnPolicy, Config
from ..operators.profile import DATE_EVIDENCE, NUMBER_EVIDENCE, profile, profile_frame
from ..sources.tables import TextTable, from_dataframe, read_csv, read_parquet
from .catalog import register, shared_path
from .dirt import cte, dirty

#: What counts as now, so that results do not age.
NOW = datetime.datetime(2001, 1, 1)

_WS = "\\t\\n\\v\\f\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


_NULLS = ", ".join(f"'{w}'" for w in X.NULL_WORDS)


def _is_null(c: str) -> str:
    return f"(lower({_strip(c)}) IN ({_NULLS}) OR {_strip(c)} IN ('nan', 'NAN', 'NaN'))"


def _norm(c: str) -> str:
    inner = f"regexp_replace(replace(lower({_strip(c)}), chr(160), ' '), '[{_WS}_-]+', ' ', 'g')"
    return _strip(f"regexp_replace({inner}, '[.,]+$', '')")


def _read(spark, sf_dir: str, table: str) -> TextTable:
    return read_parquet(spark, f"{sf_dir}/{table}.parquet")


# --- profile ---------------------------------------------------------------------------------------

_LINEITEM = {"l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n", "l_quantity": "n", "l_extendedprice": "n", "l_discount": "n", "l_tax": "n", "l_returnflag": "t", "l_linestatus": "t", "l_shipdate": "d"}


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    parts = []
    for c, k in columns.items():
        kind = {"n": "'numeric'", "t": "'categorical'", "d": "'date'"}[k]
        stats = f"CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(CAST(median({c}) AS DOUBLE), 6) AS median" if k == "n" else "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS median"
        parts.append(f"SELECT '{c}' AS column_name, {kind} AS kind, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_null, count(DISTINCT {c}) AS distinct_values, {stats} FROM {table}")
    return " UNION ALL ".join(parts)


@register("profile_lineitem", _profile_sql("lineitem", _LINEITEM))
def profile_lineitem(spark, sf_dir):
    done = profile(_read(spark, sf_dir, "lineitem"), NOW)
    return profile_frame(done).select(F.col("column").alias("column_name"), "kind", "n_rows", "n_null", F.col("distinct").alias("distinct_values"), "min", "max", F.round("median", 6).alias("median"))


@register("robust_stats_outliers", """
WITH m AS (SELECT median(value) AS med FROM events), a AS (SELECT median(abs(value - med)) AS mad FROM events, m)
SELECT round(med, 6) AS median, round(mad, 6) AS mad, count(*) FILTER (abs(0.6745 * (value - med) / mad) > 6.0) AS n_outliers
FROM events, m, a GROUP BY med, mad""")
def robust_stats_outliers(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("value")
    done = profile(from_dataframe(df), NOW)
    mad = done.mad([0])[0]
    z = F.abs(0.6745 * (done.number([0]) - done.columns[0].median) / mad)
    return done.words.agg(F.lit(round(done.columns[0].median, 6)).alias("median"), F.lit(round(mad, 6)).alias("mad"), F.sum(F.when(z > 6.0, F.col("n")).otherwise(0)).alias("n_outliers"))


@register("missing_values", f"""WITH {cte('orders')} SELECT column_name, count(*) AS n_rows, count(*) FILTER (blank) AS n_blank, count(*) FILTER (nul AND NOT blank) AS n_disguised
FROM (SELECT 'cust' AS column_name, {_is_null('cust')} AS nul, {_strip('cust')} = '' AS blank FROM d UNION ALL SELECT 'priority', {_is_null('priority')}, {_strip('priority')} = '' FROM d UNION ALL SELECT 'total', {_is_null('total')}, {_strip('total')} = '' FROM d) GROUP BY column_name""")
def missing_values(spark, sf_dir):
    done = profile(dirty(spark, sf_dir, "orders", ["cust", "priority", "total"]), NOW)
    return spark.createDataFrame([(p.name, p.n_rows, p.n_blank, p.n_disguised) for p in done.columns], "column_name string, n_rows long, n_blank long, n_disguised long")


# --- rows and keys ---------------------------------------------------------------------------------


@register("duplicate_rows", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows, count(*) AS groups FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang HAVING count(*) > 1)")
def duplicate_rows(spark, sf_dir):
    table = from_dataframe(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))
    return C.duplicate_groups(table).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_rows"), F.count("*").alias("groups"))


@register("key_check", "SELECT count(*) AS repeated, CAST(max(n) AS BIGINT) AS most FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)")
def key_check(spark, sf_dir):
    table = from_dataframe(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey"))
    return R.keys(table, 0).where("n > 1").agg(F.count("*").alias("repeated"), F.max("n").alias("most"))


@register("candidate_key", "SELECT 'order_key' AS column_name FROM (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS k FROM orders) WHERE n = k")
def candidate_key(spark, sf_dir):
    done = profile(from_dataframe(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("customer_key"), F.col("o_orderkey").alias("order_key"))), NOW)
    found = [f.column for f in C.key(done, Config()) if f.code == "candidate-key"]
    return spark.createDataFrame([(x,) for x in found], "column_name string")


# --- references ------------------------------------------------------------------------------------

_REFS = f"WITH {cte('orders')}, f AS (SELECT DISTINCT CAST(c_custkey AS STRING) AS k FROM customer), l AS (SELECT cust AS k, count(*) AS n FROM d WHERE {_strip('cust')} <> '' GROUP BY cust), o AS (SELECT * FROM l WHERE k NOT IN (SELECT k FROM f))"


def _sides(spark, sf_dir):
    local = R.keys(dirty(spark, sf_dir, "orders", ["cust"]), 0)
    return local, R.keys(from_dataframe(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")), 0)


@register("fk_orphans", _REFS + " SELECT k, n FROM o")
def fk_orphans(spark, sf_dir):
    return R.orphans(*_sides(spark, sf_dir)).select("k", "n")


@register("fk_recoverable", _REFS + f" SELECT k, n FROM o WHERE {_norm('k')} IN (SELECT {_norm('k')} FROM f)")
def fk_recoverable(spark, sf_dir):
    local, foreign = _sides(spark, sf_dir)
    return R.recoverable(R.orphans(local, foreign), foreign).select("k", "n")


@register("fk_unique_and_null", f"WITH {cte('orders')} SELECT (SELECT count(*) FROM d WHERE {_strip('cust')} = '') AS null_rows, (SELECT count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)) AS repeated_foreign")
def fk_unique_and_null(spark, sf_dir):
    table = dirty(spark, sf_dir, "orders", ["cust"])
    foreign = _sides(spark, sf_dir)[1].where("n > 1").agg(F.count("*").alias("repeated_foreign"))
    return table.df.agg(F.count_if(X.is_blank(F.col("c0"))).alias("null_rows")).crossJoin(foreign)


# --- labels and text -------------------------------------------------------------------------------


@register("label_variants", f"WITH {cte('orders')} SELECT {_norm('priority')} AS label, count(DISTINCT priority) AS spellings, count(*) AS n FROM d WHERE NOT {_is_null('priority')} GROUP BY 1 HAVING count(DISTINCT priority) > 1")
def label_variants(spark, sf_dir):
    done = profile(dirty(spark, sf_dir, "orders", ["priority"]), NOW)
    return C.label_groups(done.words, [0]).where(F.size("spellings") > 1).select("label", F.size("spellings").cast("long").alias("spellings"), "n")


@register("near_duplicate_labels", """WITH w AS (SELECT lower(CASE WHEN c_custkey % 101 = 0 THEN replace(c_mktsegment, 'I', 'L') ELSE c_mktsegment END) AS label, count(*) AS n FROM customer GROUP BY 1)
SELECT a.label AS a, b.label AS b FROM w a JOIN w b ON a.label < b.label AND abs(length(a.label) - length(b.label)) <= 2 AND least(length(a.label), length(b.label)) >= 4 AND levenshtein(a.label, b.label) <= 2
WHERE least(a.n, b.n) < greatest(a.n, b.n) AND greatest(a.n, b.n) >= 5 AND (least(a.n, b.n) <= 2 OR least(a.n, b.n) / greatest(a.n, b.n) < 0.15)""")
def near_duplicate_labels(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    words = df.select(F.expr("CASE WHEN c_custkey % 101 = 0 THEN replace(c_mktsegment, 'I', 'L') ELSE c_mktsegment END").alias("value"), F.col("c_custkey").alias("first_row")).groupBy(F.lit(0).alias("col"), "value").agg(F.count("*").alias("n"), F.min("first_row").alias("first_row")).withColumn("null_token", F.lit(False))
    return C.near_labels(C.label_groups(words, [0])).select("a", "b")


@register("whitespace_problems", f"""WITH {cte('orders')} SELECT problem, count(*) AS n FROM (SELECT CASE WHEN priority <> {_strip('priority')} THEN 'padded' WHEN contains(priority, chr(160)) THEN 'non-breaking space' WHEN regexp_matches(priority, '[{_WS}]{{2,}}') THEN 'repeated' WHEN regexp_matches(priority, '[\\t\\n\\r]') THEN 'tab or newline' END AS problem FROM d) WHERE problem IS NOT NULL GROUP BY problem""")
def whitespace_problems(spark, sf_dir):
    table = dirty(spark, sf_dir, "orders", ["priority"])
    return table.df.select(X.whitespace_problem(F.col("c0")).alias("problem")).where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))


@register("formula_mojibake_zeros", f"""WITH {cte('orders')} SELECT count(*) FILTER (note LIKE '=%' OR note LIKE '@%' OR (regexp_matches(note, '^[+-]') AND NOT regexp_matches(note, '^[+-][0-9]+$'))) AS formulas,
count(*) FILTER (contains(note, chr(195) || chr(169))) AS mojibake, count(*) FILTER (zip LIKE '0%') AS leading_zeros FROM d""")
def formula_mojibake_zeros(spark, sf_dir):
    done = profile(dirty(spark, sf_dir, "orders", ["note", "zip"]), NOW)
    note, code = done.columns
    return spark.createDataFrame([(note.formula, note.mojibake, code.leading_zeros)], "formulas long, mojibake long, leading_zeros long")


_LUHN = "list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (CASE WHEN CAST(substr(reverse(v), i, 1) AS INT) * 2 > 9 THEN CAST(substr(reverse(v), i, 1) AS INT) * 2 - 9 ELSE CAST(substr(reverse(v), i, 1) AS INT) * 2 END) ELSE CAST(substr(reverse(v), i, 1) AS INT) END)) % 10 = 0"


@register("sensitive_values", f"""WITH {cte('orders')}, c AS (SELECT '4' || lpad(CAST(c_custkey * 7919 AS STRING), 15, '0') AS v FROM customer)
SELECT (SELECT count(*) FROM d WHERE regexp_matches(mail, '^[^@ ,;]+@[^@ ,;]+[.][A-Za-z]{{2,}}$')) AS emails, (SELECT count(*) FROM c WHERE {_LUHN}) AS cards""")
def sensitive_values(spark, sf_dir):
    mail = dirty(spark, sf_dir, "orders", ["mail"]).df.agg(F.count_if(X.is_email(F.col("c0"))).alias("emails"))
    cards = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.expr("'4' || lpad(CAST(c_custkey * 7919 AS STRING), 15, '0')").alias("v"))
    return mail.crossJoin(cards.agg(F.count_if(X.is_card(F.col("v"))).alias("cards")))


@register("iban_values", """WITH b AS (SELECT lpad(CAST(s_suppkey * 104729 AS STRING), 18, '0') AS k, s_suppkey % 7 AS off FROM supplier),
t AS (SELECT k, off, CAST(98 - (CAST(k || '131400' AS HUGEINT) % 97) AS BIGINT) AS chk FROM b),
v AS (SELECT k, (chk + off) % 100 AS chk FROM t)
SELECT count(*) FILTER (CAST(k || '1314' || lpad(CAST(chk AS STRING), 2, '0') AS HUGEINT) % 97 = 1) AS ibans, count(*) AS n FROM v""")
def iban_values(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("lpad(CAST(s_suppkey * 104729 AS STRING), 18, '0') AS k", "s_suppkey % 7 AS off")
    v = b.withColumn("chk", F.expr("(CAST(98 - (CAST(k || '131400' AS DECIMAL(38,0)) % 97) AS BIGINT) + off) % 100"))
    text = F.concat(F.lit("DE"), F.lpad(F.col("chk").cast("string"), 2, "0"), F.col("k"))
    return v.agg(F.count_if(X.is_iban(text)).alias("ibans"), F.count("*").alias("n"))


# --- numbers and dates -----------------------------------------------------------------------------

_NUM = f"""WITH {cte('orders')}, p AS (SELECT total, {_is_null('total')} AS nul, CASE WHEN total LIKE '(%' THEN -1 ELSE 1 END * CAST(CASE WHEN {_is_null('total')} THEN NULL ELSE regexp_replace(total, '[$,()]', '', 'g') END AS DOUBLE) AS v, regexp_matches(total, ',[0-9]{{3}}[.]') AS grp, regexp_matches(total, '[.]') AS point FROM d)"""


@register("number_parse", _NUM + " SELECT count(v) AS n, round(sum(v), 2) AS total, count(*) FILTER (total LIKE '$%') AS currency, count(*) FILTER (grp) AS thousands, count(*) FILTER (total LIKE '(%') AS parens FROM p")
def number_parse(spark, sf_dir):
    x = N.parse_number(F.col("c0"))
    rows = dirty(spark, sf_dir, "orders", ["total"]).df.select(x.alias("x"))
    return rows.agg(F.count("x").alias("n"), F.round(F.sum("x.value"), 2).alias("total"), *[F.count_if(F.col(f"x.{k}")).alias(k) for k in ("currency", "thousands", "parens")])


@register("number_evidence", _NUM + " SELECT evidence, count(*) AS n FROM (SELECT CASE WHEN nul THEN NULL WHEN point THEN 'en' ELSE 'neutral' END AS evidence FROM p) WHERE evidence IS NOT NULL GROUP BY evidence")
def number_evidence(spark, sf_dir):
    done = profile(dirty(spark, sf_dir, "orders", ["total"]), NOW)
    p = done.columns[0]
    return spark.createDataFrame([(k, p.facts[f"ev_{k}"]) for k in NUMBER_EVIDENCE if p.facts[f"ev_{k}"]], "evidence string, n long")


@register("plain_numbers", _NUM + " SELECT plain, count(*) AS n FROM (SELECT CASE WHEN nul THEN total WHEN total LIKE '(%' THEN '-' || regexp_replace(total, '[()]', '', 'g') ELSE regexp_replace(total, '[$,]', '', 'g') END AS plain FROM p) GROUP BY plain")
def plain_numbers(spark, sf_dir):
    v = F.col("c0")
    return dirty(spark, sf_dir, "orders", ["total"]).df.select(F.coalesce(N.plain_number(v), v).alias("plain")).groupBy("plain").agg(F.count("*").alias("n"))


@register("european_numbers", """SELECT count(*) FILTER (eu) AS eu, count(*) FILTER (NOT eu) AS neutral, round(sum(v), 2) AS total FROM (SELECT p_partkey % 4 <> 0 AS eu, CASE WHEN p_partkey % 4 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) + 0.75 ELSE CAST(floor(p_retailprice) AS BIGINT) END AS v FROM part)""")
def european_numbers(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.expr("CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_retailprice >= 1000 THEN CAST(CAST(floor(p_retailprice / 1000) AS BIGINT) AS STRING) || '.' || lpad(CAST(CAST(floor(p_retailprice) AS BIGINT) % 1000 AS STRING), 3, '0') ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) END || ',75' ELSE CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) END").alias("v"))
    en, eu = N.parse_number(F.col("v")), N.parse_number(F.col("v"), "eu")
    ev = N.evidence(en, eu)
    return df.agg(F.count_if(ev == "eu").alias("eu"), F.count_if(ev == "neutral").alias("neutral"), F.round(F.sum(eu["value"]), 2).alias("total"))


_DAY = f"WITH {cte('orders')}, p AS (SELECT day, CASE WHEN contains(day, '-') THEN strptime(day, '%Y-%m-%d') ELSE strptime(day, '%d/%m/%Y') END AS ts, contains(day, '-') AS iso, CASE WHEN contains(day, '/') THEN CAST(substr(day, 1, 2) AS INT) END AS a, CASE WHEN contains(day, '/') THEN CAST(substr(day, 4, 2) AS INT) END AS b FROM d)"


@register("date_evidence", _DAY + " SELECT evidence, count(*) AS n FROM (SELECT CASE WHEN iso THEN 'iso' WHEN a > 12 THEN 'dmy-only' WHEN a <> b THEN 'either' END AS evidence FROM p) WHERE evidence IS NOT NULL GROUP BY evidence")
def date_evidence(spark, sf_dir):
    p = profile(dirty(spark, sf_dir, "orders", ["day"]), NOW).columns[0]
    return spark.createDataFrame([(k, p.facts[f"dev_{k}"]) for k in DATE_EVIDENCE if p.facts[f"dev_{k}"]], "evidence string, n long")


@register("iso_dates", _DAY + " SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM p GROUP BY 1")
def iso_dates(spark, sf_dir):
    v = F.col("c0")
    return dirty(spark, sf_dir, "orders", ["day"]).df.select(D.iso_date(D.parse_dates(v), "dmy").alias("day")).groupBy("day").agg(F.count("*").alias("n"))


@register("date_sanity", """WITH v AS (SELECT CASE WHEN o_orderkey % 100 = 0 THEN TIMESTAMP '1900-01-01' WHEN o_orderkey % 100 = 1 THEN TIMESTAMP '1850-05-06' ELSE o_orderdate END AS ts FROM orders)
SELECT count(*) FILTER (ts > TIMESTAMP '2001-01-02') AS future, count(*) FILTER (year(ts) < 1900) AS implausible, count(*) FILTER (strftime(ts, '%Y-%m-%d') IN ('1900-01-01', '1901-01-01', '1970-01-01', '2099-12-31', '9999-12-31')) AS sentinels FROM v""")
def date_sanity(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.expr("CASE WHEN o_orderkey % 100 = 0 THEN TIMESTAMP_NTZ '1900-01-01' WHEN o_orderkey % 100 = 1 THEN TIMESTAMP_NTZ '1850-05-06' ELSE o_orderdate END").alias("ts"))
    p = profile(from_dataframe(df), NOW).columns[0]
    return spark.createDataFrame([(p.future, p.implausible, p.sentinel_dates)], "future long, implausible long, sentinels long")


@register("numeric_sentinels", f"WITH {cte('orders')} SELECT CAST(-999 AS DOUBLE) AS value, count(*) AS n FROM d WHERE total = '-999'")
def numeric_sentinels(spark, sf_dir):
    done = profile(dirty(spark, sf_dir, "orders", ["total"]), NOW)
    p = done.columns[0]
    return spark.createDataFrame([(s, p.facts[f"en_sentinel_{k}"]) for k, s in enumerate(X.NUMERIC_SENTINELS) if p.facts[f"en_sentinel_{k}"] >= max(2, 0.01 * p.n_numbers)], "value double, n long")


# --- policies, drift -------------------------------------------------------------------------------


@register("policies", f"""WITH {cte('orders')} SELECT code, n FROM (SELECT 'required-value-missing' AS code, count(*) FILTER ({_is_null('priority')}) AS n FROM d UNION ALL
SELECT 'value-not-allowed', count(*) FILTER (NOT {_is_null('priority')} AND priority NOT IN (SELECT DISTINCT o_orderpriority FROM orders)) FROM d UNION ALL
SELECT 'value-out-of-range', (SELECT count(*) FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 100000)) WHERE n > 0""")
def policies(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    allowed = [r[0] for r in orders.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]  # a handful of labels
    table = dirty(spark, sf_dir, "orders", ["priority"])
    found = C.policies(profile(table, NOW), Config(columns={"priority": ColumnPolicy(required=True, allowed_values=allowed)}))
    price = from_dataframe(orders.select("o_totalprice"))
    found += C.policies(profile(price, NOW), Config(columns={"o_totalprice": ColumnPolicy(role="measure", min_value=1000, max_value=100000)}))
    return spark.createDataFrame([(f.code, f.detail["count"]) for f in found], "code string, n long")


_SPLIT = "1998-01-01"


def _halves(spark, sf_dir, columns):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    old, new = (df.where(f"o_orderdate {op} TIMESTAMP_NTZ '{_SPLIT}'") for op in ("<", ">="))
    return profile(from_dataframe(old.select(*columns)), NOW), profile(from_dataframe(new.select(*columns)), NOW)


@register("drift_medians", f"""SELECT round(median(o_totalprice) FILTER (o_orderdate < TIMESTAMP '{_SPLIT}'), 4) AS old_median, round(median(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '{_SPLIT}'), 4) AS new_median,
count(*) FILTER (o_orderdate < TIMESTAMP '{_SPLIT}') AS old_rows, count(*) FILTER (o_orderdate >= TIMESTAMP '{_SPLIT}') AS new_rows FROM orders""")
def drift_medians(spark, sf_dir):
    old, new = _halves(spark, sf_dir, ["o_totalprice"])
    return spark.createDataFrame([(round(old.columns[0].median, 4), round(new.columns[0].median, 4), old.n_rows, new.n_rows)], "old_median double, new_median double, old_rows long, new_rows long")


@register("drift_categories", "SELECT event_type AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1 EXCEPT SELECT CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 'other' ELSE event_type END FROM events WHERE event_id % 2 = 0")
def drift_categories(spark, sf_dir):
    from ..operators.drift import categories

    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    least = df.agg(F.min("event_type")).first()[0]
    old = profile(from_dataframe(df.where("event_id % 2 = 0").select(F.when(F.col("event_type") == least, "other").otherwise(F.col("event_type")).alias("event_type"))), NOW)
    new = profile(from_dataframe(df.where("event_id % 2 = 1").select("event_type")), NOW)
    return categories(new, 0).join(categories(old, 0), "value", "left_anti")


# --- repair and impact -----------------------------------------------------------------------------

_BEST = f"""WITH {cte('orders')}, t AS (SELECT priority AS raw, CASE WHEN {_is_null('priority')} THEN '' ELSE regexp_replace({_strip('priority')}, ' +', ' ', 'g') END AS v FROM d),
g AS (SELECT v, {_norm('v')} AS label, count(*) AS n, len(regexp_extract_all(v, '(^| )[A-Z]')) / greatest(len(regexp_extract_all(v, '(^| )[A-Za-z]')), 1) AS share FROM t WHERE v <> '' GROUP BY v),
b AS (SELECT label, first(v ORDER BY share DESC, n DESC, length(v)) AS best FROM g GROUP BY label),
r AS (SELECT raw, coalesce(best, v) AS fixed FROM t LEFT JOIN g USING (v) LEFT JOIN b USING (label))"""


def _repair(spark, sf_dir, columns, confidence="medium", drop=False):
    return P.plan(profile(dirty(spark, sf_dir, "orders", columns), NOW), None, confidence, drop)


@register("repair_labels", _BEST + " SELECT raw, fixed, count(*) AS n FROM r GROUP BY raw, fixed")
def repair_labels(spark, sf_dir):
    return _repair(spark, sf_dir, ["priority"]).rows.groupBy(F.col("c0").alias("raw"), F.col("r0").alias("fixed")).agg(F.count("*").alias("n"))


_FIXED = f"CASE WHEN {_is_null('total')} OR total = '-999' THEN '' WHEN total LIKE '(%' THEN '-' || regexp_replace(total, '[()]', '', 'g') ELSE regexp_replace(total, '[$,]', '', 'g') END"


@register("repair_grid", f"WITH {cte('orders')} SELECT CAST(order_id AS BIGINT) AS row_no, {_FIXED} AS total, CASE WHEN contains(day, '-') THEN day ELSE substr(day, 7, 4) || '-' || substr(day, 4, 2) || '-' || substr(day, 1, 2) END AS day FROM d")
def repair_grid(spark, sf_dir):
    return _repair(spark, sf_dir, ["total", "day"]).table.select("row_no", F.col("c0").alias("total"), F.col("c1").alias("day"))


@register("repair_audit", f"""WITH {cte('orders')}, t AS (SELECT total, {_is_null('total')} AS nul FROM d) SELECT rule, confidence, count(*) AS n FROM (
SELECT 'blank-null' AS rule, 'high' AS confidence FROM t WHERE nul AND total <> '' UNION ALL SELECT 'plain-number', 'high' FROM t WHERE regexp_matches(total, '[$,(]') UNION ALL SELECT 'sentinel-null', 'medium' FROM t WHERE total = '-999') GROUP BY rule, confidence""")
def repair_audit(spark, sf_dir):
    return _repair(spark, sf_dir, ["total"]).changes.groupBy("rule", "confidence").agg(F.count("*").alias("n"))


@register("drop_duplicates", "SELECT count(*) - count(DISTINCT (text, lang)) AS dropped, count(DISTINCT (text, lang)) AS kept FROM (SELECT trim(replace(lang, '_', ' ')) AS lang, source AS text FROM documents)")
def drop_duplicates(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = profile(from_dataframe(df.select("doc_id", "source", "lang"), order="doc_id"), NOW)
    out = P.plan(done, None, "high", True)
    return out.rows.agg(F.count("*").alias("kept")).crossJoin(out.dropped.agg(F.count("*").alias("dropped")))


_IMPACT = f"""WITH {cte('orders')}, t AS (SELECT total, TRY_CAST(total AS DOUBLE) AS a, TRY_CAST({_FIXED} AS DOUBLE) AS b FROM d)"""


@register("impact_sum", _IMPACT + """ SELECT count(*) AS total_rows, round(sum(a), 2) AS coerced_total, count(a) AS coerced_rows, round(sum(b), 2) AS repaired_total, count(b) AS repaired_rows,
count(*) FILTER (total <> '' AND a IS NULL AND b IS NOT NULL) AS recovered_rows, round(coalesce(sum(b) FILTER (a IS NULL), 0), 2) AS recovered_amount,
count(*) FILTER (a IS NOT NULL AND b IS NULL AND a <> 0) AS removed_rows, round(coalesce(sum(-a) FILTER (b IS NULL), 0), 2) AS removed_amount,
count(*) FILTER (total <> '' AND a IS NULL AND b IS NULL) AS still_lost_rows FROM t""")
def impact_sum(spark, sf_dir):
    out = I.sum_impact(I.prepare(profile(dirty(spark, sf_dir, "orders", ["total"]), NOW)), "total")
    money = ("coerced_total", "repaired_total", "recovered_amount", "removed_amount")
    return out.select(*[F.round(c, 2).alias(c) if c in money else F.col(c) for c in out.columns if c not in ("loads_as_number", "difference")])


@register("impact_avg_min_max", _IMPACT + " SELECT round(avg(a), 4) AS avg_coerced, round(avg(b), 4) AS avg_repaired, min(a) AS min_coerced, min(b) AS min_repaired, max(a) AS max_coerced, max(b) AS max_repaired FROM t")
def impact_avg_min_max(spark, sf_dir):
    out = I.aggregate_impact(I.prepare(profile(dirty(spark, sf_dir, "orders", ["total"]), NOW)), "total")
    return out.select(*[F.round(c, 4).alias(c) if c.startswith("avg") else F.col(c) for c in out.columns])


@register("impact_groups", _BEST + " SELECT count(DISTINCT raw) FILTER (trim(raw) <> '') AS groups_before, count(DISTINCT fixed) FILTER (fixed <> '') AS groups_after, round(count(*) FILTER (raw <> fixed AND fixed <> '') / count(*), 6) AS misplaced_share FROM r")
def impact_groups(spark, sf_dir):
    whole, _ = I.group_impact(I.prepare(profile(dirty(spark, sf_dir, "orders", ["priority"]), NOW)), "priority")
    return whole.select("groups_before", "groups_after", F.round("misplaced_share", 6).alias("misplaced_share"))


@register("impact_group_merges", _BEST + " SELECT fixed, list_sort(list(DISTINCT raw)) AS sources, CAST(count(*) AS DOUBLE) AS amount FROM r WHERE raw <> fixed AND fixed <> '' GROUP BY fixed")
def impact_group_merges(spark, sf_dir):
    return I.group_impact(I.prepare(profile(dirty(spark, sf_dir, "orders", ["priority"]), NOW)), "priority")[1]


@register("impact_duplicates", "SELECT count(*) AS duplicate_rows, round(coalesce(sum(value), 0), 4) AS duplicate_amount FROM (SELECT round(value) AS value, row_number() OVER (PARTITION BY event_type, round(value) ORDER BY event_id) AS r FROM events) WHERE r > 1")
def impact_duplicates(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    done = profile(from_dataframe(df.select("event_id", "event_type", F.round("value").alias("value")), order="event_id"), NOW)
    return I.duplicate_impact(I.prepare(done), "value").select("duplicate_rows", F.round("duplicate_amount", 4).alias("duplicate_amount"))


# --- files ------------------------------------------------------------------------------------------


@register("csv_round_trip", "SELECT CAST(n_nationkey AS STRING) AS n_nationkey, n_name, CAST(n_regionkey AS STRING) AS n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    path = shared_path(spark, "csv")
    # one part, as each part would have a header; cells are written as they are, quotes doubled
    spark.read.parquet(f"{sf_dir}/nation.parquet").coalesce(1).write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    table = read_csv(spark, path)
    return table.df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(table.header)])
