"""Rank and select against counting, and fill-in-the-middle against cuts of Python strings."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.llm import registry
from lodestrata.llm.buffers import slices, utf8
from lodestrata.llm.infill import fill_in_middle, restored
from lodestrata.llm.rankselect import Bits

TEXTS = [None, "", "a", "é", "naïve 漢字 𝔘ni", "has <P> in it", "<S>", "<", "P>", "<P", "x" * 70_000 + "é" * 3_000, "two\nlines\n\n", "ends with <S", "><M", "tie", "tie"]
ROWS = [(k, TEXTS[k % len(TEXTS)]) for k in range(160)] + [(None, "no id é"), (7, "P>"), (7, "P>")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=1500))
def test_rank_and_select_count_bits(bits):
    own, made = np.array(bits, bool), None
    made = Bits(own)
    ones = np.flatnonzero(own)
    assert made.ones == len(ones)
    assert made.rank(np.arange(len(own) + 1)).tolist() == [0, *np.cumsum(own).tolist()]
    assert made.select(np.arange(len(ones) + 2)).tolist() == [*ones.tolist(), len(own), len(own)]


def test_rank_and_select_over_many_blocks():
    for share in (0.0, 0.001, 0.5, 1.0):
        own = np.random.default_rng(3).random(100_003) < share
        made = Bits(own)
        assert made.select(np.arange(made.ones)).tolist() == np.flatnonzero(own).tolist()
        assert made.rank(np.array([0, 511, 512, 513, 64_000, 100_003])).tolist() == [int(own[:k].sum()) for k in (0, 511, 512, 513, 64_000, 100_003)]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_bytes_of_a_sliced_column(kind):
    raw, at = utf8(pa.array(["zz", "é", None, "", "abc"], kind).slice(1, 4))
    assert raw.tobytes().decode() == "éabc" and at.tolist() == [0, 2, 2, 2, 5]
    assert [(i, j) for i, j in slices(at, 2)] == [(0, 3), (3, 4)]
    assert utf8(pa.array([], kind))[1].tolist() == [0]


def expected(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)], len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    return doc_id, n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", text


def test_forms_cuts_and_restored_texts(spark):
    docs = spark.createDataFrame([(a, b, "kept", 5, "clash") for a, b in ROWS], "doc_id long, text string, lang string, n int, output string").repartition(3)
    made = fill_in_middle(docs)
    assert made.columns == ["doc_id", "lang", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = made.withColumn("back", restored(F.col("output"), F.col("form"))).drop("lang").collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(*r) for r in ROWS), key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_query_is_sql_over_texts_of_any_width(spark, tmp_path):
    import duckdb

    spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = registry.queries()["op12_fill_in_middle"](spark, str(tmp_path))
    sql = con.execute(registry.oracle_sql()["op12_fill_in_middle"])
    names = [c[0] for c in sql.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(sql.fetchall(), key=repr)
