import datetime

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import dates as D
from lodestrata.functions import numbers as N
from lodestrata.functions import text as X


def run(spark, values, build):
    column = build(F.col("v"))
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string").select("i", column.alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_numbers(spark):
    values = ["1234", "1,234.50", "$1,200", "(45.00)", "12%", "-3", "twelve", "", "1.2.3", "(45", "12-", "N/A", ".5", "1.", "€ 5"]
    assert run(spark, values, lambda V: N.parse_number(V)["value"]) == [1234, 1234.5, 1200, -45, 12, -3, None, None, None, None, None, None, 0.5, None, 5]


def test_number_evidence(spark):
    values = ["1234", "1.234,56", "1,234.56", "1,23", "1.234.567", "1,200", "1.234", "abc"]
    assert run(spark, values, lambda V: N.evidence(N.parse_number(V), N.parse_number(V, "eu"))) == ["neutral", "eu", "en", "eu", "eu", "group-en", "group-eu", None]


def test_plain_number(spark):
    assert run(spark, ["$1,200.50", "(3)", "7", "x", " 5 "], lambda V: N.plain_number(V)) == ["1200.50", "-3", None, None, "5"]
    assert run(spark, ["1.234,56"], lambda V: N.plain_number(V, "eu")) == ["1234.56"]


def test_strict_double(spark):
    assert run(spark, ["1d", "1f", "1_000", "5.", "1e3", "$1", ""], lambda V: N.strict_double(V)) == [None, None, 1000, 5, 1000, None, None]


def test_dates(spark):
    values = ["05/06/2024", "27/04/2024", "31/02/2024", "2024-01-15", "12/25/70", "12/25/68", "20240115", "11620823", "Jan 5, 2024", "5.1.2024", "hello 1"]
    found = run(spark, values, lambda V: F.transform(D.parse_dates(V), lambda r: F.concat(r["ord"], F.lit(" "), F.date_format(r["ts"], "yyyy-MM-dd"))))
    assert found[0] == ["dmy 2024-06-05", "mdy 2024-05-06"]
    assert [x[0] if x else None for x in found[1:]] == ["dmy 2024-04-27", None, "ymd 2024-01-15", "mdy 1970-12-25", "mdy 2068-12-25", "ymd 2024-01-15", None, "mdy 2024-01-05", "dmy 2024-01-05", None]


@pytest.mark.parametrize("value, problem", [(" North", "padded"), ("New  York", "repeated"), ("North", None), ("a b", "non-breaking space"), ("a\tb", "tab or newline")])
def test_whitespace(spark, value, problem):
    assert run(spark, [value], lambda V: X.whitespace_problem(V)) == [problem]


def test_text(spark):
    assert run(spark, ["", " - ", "N/A", "nan", "Nan", "x"], lambda V: X.is_null_token(V)) == [True, True, True, True, False, False]
    assert run(spark, ["Acme_Corp.", " acme  corp"], lambda V: X.normalize_label(V)) == ["acme corp", "acme corp"]
    assert run(spark, ["4111 1111 1111 1111", "4111 1111 1111 1112", "1234"], lambda V: X.is_card(V)) == [True, False, False]
    assert run(spark, ["GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"], lambda V: X.is_iban(V)) == [True, False]
    assert run(spark, ["=1+1", "-5", "-x", "+1", " @a", "x"], lambda V: N.is_formula_like(V)) == [True, False, True, False, True, False]
    assert X.names_identifier("paid") and X.names_identifier("order key") and not X.names_identifier("name")


def test_repeated_and_null_columns(spark):
    assert run(spark, [None], lambda V: X.is_blank(V)) == [None]
    assert datetime.datetime(1970, 1, 1)


def test_guards_change_no_predicate(spark):
    import random

    from lodestrata.functions import text as X
    from pyspark.sql import functions as F

    draw, parts = random.Random(5), [*X.WS_CHARS, *"aZ0-.@+,;#/?()é漢𝔘ßİK", "n/a", "NULL", "Nan", "yes", "4111111111111111", "DE89370400440532013000", "gb82WEST12345698765432", "u@x.org", "+44 20 7946 0000"]
    values = [None, "", *parts, *("".join(draw.choices(parts, k=draw.randint(1, 5))) for _ in range(4_000))]
    v = F.col("v")
    assert {chr(k) for k in range(0x10000) if not 0xD800 <= k < 0xE000 and chr(k).isspace()} == set(X.WS_CHARS)
    strip = F.regexp_replace(v, f"\\A[{X.WS}]+|[{X.WS}]+\\z", "")
    iban = F.regexp_replace(F.upper(strip), f"[{X.WS}]", "").rlike("\\A[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\\z")
    pairs = {
        "strip": (X.py_strip(v), strip),
        "null": (X.is_null_token(v), F.lower(strip).isin(*X.NULL_WORDS) | strip.isin(*X.MACHINE_NAN)),
        "boolean": (X.is_boolean(v), F.lower(strip).isin(*X.TRUE_WORDS, *X.FALSE_WORDS)),
        "space": (X.whitespace_problem(v), F.when(v != strip, "padded").when(v.contains("\xa0"), "non-breaking space").when(v.rlike(f"[{X.WS}]{{2,}}"), "repeated").when(v.rlike("[\\t\\n\\r]"), "tab or newline")),
        "email": (X.is_email(v), strip.rlike(f"\\A[^@{X.WS},;]+@[^@{X.WS},;]+\\.[A-Za-z]{{2,}}\\z")),
        "phone": (X.is_international_phone(v), strip.rlike(f"\\A\\+\\d[\\d{X.WS}().\\-]{{6,16}}\\d\\z")),
        "iban": (X.is_iban(v) & ~iban, F.lit(False) & v.isNotNull()),
    }
    df = spark.createDataFrame([(x,) for x in values], "v string")
    for name, (new, old) in pairs.items():
        assert df.where(~new.eqNullSafe(old) & v.isNotNull()).limit(3).collect() == [], name
    assert df.where(X.is_iban(v)).count() > 0
    assert "regexp_replace" not in str(X.py_strip(v))
