"""Anchors and local parsers against the patterns themselves, and the query against its SQL."""

import re

from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import private, registry
from lodestrata.llm.private import find, find_private, masked
from lodestrata.llm.q_private import PATTERNS

IBAN = "GB82 WEST 1234 5698 7654 32"
TEXTS = [
    None,
    "",
    "plain words, 3 of them.",
    "mail a.b+c@mail1.example.com, or é@x.y and ü.b@c.d.e.",
    "a@b.c@d.e x@y @z.q a@b a@.c a@b..c",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.000255.3.4 1.2.3 1..2.3.4 9.9.9.9.",
    "4111 1111 1111 1111 or 4111-1111-1111-1112 or 4111111111111111 5 and 4111  111111111111",
    "+1 (017) 555-7713 +1234567 +12345678 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 +4 +44( +49) 5 ++12345678",
    "jo [at] site dot com jo (AT) site [dot] com, jo[at]site.co.uk. Then jo@site[dot]com",
    "ftp://me:p%40ss@host.example.com/x http://me@host http://:x@host 9+a://u:v@h é://u:v@h",
    f"IBAN: {IBAN} and iban#{IBAN.replace(' ', '')} IBAN DE89370400440532013000 AND IBAN GB00 WEST 1234 5698 7654 32",
    'token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" TOKEN:abcdefghijklmnopqrst secrettoken=a1a1a1a1a1a1a1a1 api_key=\'x\' password:secret=1234567890abcdefg',
    "漢字 a@b.c 𝔘 +1 (017) 555-7713 é 10.0.0.1",
    "9" * 5_000 + "." + "1" * 5_000 + ".1.1 " + "a" * 20_000 + "@b.c",
    "+" + "1-" * 3_000,
]


def digits(x):
    return re.sub("[^0-9]", "", x)


def passes(kind, x):
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in x.split("."))
    if kind == "card":
        own = [int(c) for c in digits(x)]
        return 16 <= len(own) <= 19 and sum(c if k % 2 == 0 else c * 2 - 9 * (c > 4) for k, c in enumerate(own[::-1])) % 10 == 0
    return 8 <= len(digits(x)) <= 15 if kind == "phone" else True


def remainder(x):
    x = x.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            if kind == "secret":
                good, spot = bool(re.search("[0-9]", m[1])) and bool(re.search("[A-Za-z]", m[1])), m.span(1)
            elif kind == "iban":
                short = m[1][: -len(m[2])] if m[2] else m[1]
                good = remainder(m[1]) or remainder(short)
                spot = (m.start(1), m.end(1) if remainder(m[1]) else m.end(1) - len(m[2] or ""))
            else:
                good, spot = passes(kind, m[0]), m.span()
            if good:
                out.append((kind, *spot))
    return out


PIECES = st.sampled_from(["@", "a", "b.c", ".", "-", "+", "+1", "1", "25", "256", "4111111111111111", "4", " ", "  ", "(", ")", "é", "漢", "[at]", "(AT)", "[dot]", "(dot)", "://", "h", ":", "/", "iban", "IBAN", "GB82", "WEST", "1234", "32", "#", "token", "secret", "api_key", "=", '"', "a1b2c3d4e5f6a7b8", "_", "%"])


@settings(max_examples=1_500, deadline=None)
@given(st.lists(PIECES, max_size=24).map("".join))
@example("token=token=a1a1a1a1a1a1a1a1b2")
@example("a@b.c@d.e+x@y.z")
@example("IBANIBANGB82WEST12345698765432")
def test_parsers_find_what_the_patterns_match(text):
    assert find(text) == brute(text)


def test_given_texts_and_masks():
    for text in TEXTS:
        assert find(text or "") == brute(text)
    assert find(TEXTS[12])[:2] == [("email", 3, 8), ("ip", 31, 39)]
    assert {k for t in TEXTS for k, _, _ in brute(t)} == set(private.KINDS)
    assert masked(TEXTS[12], find(TEXTS[12])) == "漢字 <EMAIL> 𝔘 <PHONE> é <IP>"


def test_operator_keeps_columns_and_all_texts(spark):
    rows = [(k, t, "fr", "clash") for k, t in enumerate([*TEXTS, TEXTS[3]])] + [(None, TEXTS[5], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, findings string").repartition(3)
    found = find_private(docs)
    assert found.columns == ["doc_id", "lang", "findings"]
    got = sorted(((r["doc_id"], r["lang"], [tuple(f) for f in r["findings"]]) for r in found.collect()), key=repr)
    assert got == sorted(((a, c, brute(b)) for a, b, c, _ in rows), key=repr)
    assert find_private(docs.limit(0)).count() == 0


def test_query_is_sql(spark, tmp_path):
    import duckdb

    rows = [(k, t) for k, t in enumerate([*TEXTS, TEXTS[4], TEXTS[4]])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.queries()["op13_private_data"](spark, str(tmp_path)).withColumn("n_email", F.col("n_email"))
    sql = con.execute(registry.oracle_sql()["op13_private_data"])
    names = [c[0] for c in sql.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(sql.fetchall())
