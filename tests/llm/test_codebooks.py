"""Nearest entries by annulus against all entries, and product codes against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import codebooks, registry
from lodestrata.llm.codebooks import Codebook, compress
from lodestrata.llm.scratch import Scratch


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 64), st.integers(1, 5), st.integers(1, 40), st.integers(0, 2**31), st.sampled_from([1, 3, 300, 1 << 22]))
def test_annulus_loses_no_entry_and_keeps_ties_low(size, width, rows, seed, largest):
    rng = np.random.default_rng(seed)
    entries, x = rng.integers(-largest, largest + 1, (size, width)), rng.integers(-largest, largest + 1, (rows, width))
    squares = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    index, least = Codebook(entries).nearest(x)
    assert index.tolist() == squares.argmin(axis=1).tolist() and least.tolist() == squares.min(axis=1).tolist()


def test_annulus_leaves_entries_of_other_norms_out():
    rng = np.random.default_rng(1)
    entries = np.floor(rng.standard_normal((64, 4)) * rng.lognormal(4, 1.5, (64, 1))).astype(np.int64)
    book = Codebook(entries)
    book.nearest(entries[rng.integers(0, 64, 2_000)] + rng.integers(-3, 4, (2_000, 4)))
    assert book.evaluated < 0.2 * 2_000 * 64


def plain(rows):
    """{row: (code, error, label_error)} and the digest, a step at a time."""
    kept = [(v, [math.floor(256 * x) for x in e], lab) for v, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    dim = len(kept[0][1])
    fits = [len(w) == dim and max(map(abs, w)) <= codebooks.LARGEST for _, w, _ in kept]
    width = dim // 16
    parts = [[w[k * width : (k + 1) * width] for k in range(16)] if f else None for (_, w, _), f in zip(kept, fits)]
    usable = [p for p in parts if p]
    books = [[list(p[k]) for p in usable[:64]] for k in range(16)]

    def nearest(k, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[k]))

    for _ in range(2):
        for k in range(16):
            own = {}
            for p in usable:
                own.setdefault(nearest(k, p[k])[1], []).append(p[k])
            for i, members in own.items():
                books[k][i] = [sum(c) // len(members) for c in zip(*members)]
    out, by_label = [], {}
    for (v, _, lab), p in zip(kept, parts):
        found = [nearest(k, p[k]) for k in range(16)] if p else None
        out.append((v, lab, "".join(f"{i:02x}" for _, i in found) if p else None, sum(d for d, _ in found) if p else None))
        if p:
            by_label[lab] = by_label.get(lab, 0) + out[-1][3]
    return [(*r, by_label.get(r[1])) for r in out], hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vectors():
    rng = random.Random(8)
    rows = [(k, [rng.gauss(0, 1) for _ in range(32)], k % 3 if k % 7 else None) for k in range(5, 150)]
    rows += [(1_000, rows[9][1], 0), (1_000, rows[9][1], 0), (1_001, [0.0] * 32, 1), (1_002, [-0.0] * 32, 1)]
    rows += [(2_000, None, 1), (2_001, [None] * 32, 1), (2_002, [math.inf, *[0.0] * 31], 1), (2_003, [math.nan] * 32, 1)]
    return rows + [(3_000, [1.0] * 16, 2), (3_001, [], 2), (3_002, [1e30, *[0.0] * 31], 2), (None, [0.25] * 32, 1), (3_003, [1.0] * 32, 77), (3_004, [1e5] * 32, 88)]


@pytest.mark.parametrize("few", [codebooks.FEW_LABELS, 1])
def test_codes_errors_and_codebooks(spark, monkeypatch, few):
    monkeypatch.setattr(codebooks, "FEW_LABELS", few)
    df = spark.createDataFrame([(*r, "x", 1) for r in vectors()], "vec_id long, embedding array<double>, label int, code string, extra int").repartition(5)
    coded, entries = compress(df, Scratch(spark))
    assert coded.columns == ["vec_id", "label", "extra", "code", "error", "label_error"]
    want, sha = plain(vectors())
    assert sorted(map(tuple, coded.drop("extra").collect()), key=repr) == sorted(want, key=repr)
    assert codebooks.digest(entries) == sha


def test_few_other_and_no_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    few = [(3, [1.0] * 16, 1), (1, [2.0] * 16, None), (2, [2.0] * 16, 1)]
    coded, _ = compress(spark.createDataFrame(few, kind), Scratch(spark))
    assert sorted(map(tuple, coded.collect())) == [(1, None, "00" * 16, 0, 0), (2, 1, "00" * 16, 0, 0), (3, 1, "02" * 16, 0, 0)]
    odd, _ = compress(spark.createDataFrame([(1, [1.0] * 17, 1)], kind), Scratch(spark))
    assert list(map(tuple, odd.collect())) == [(1, 1, None, None, None)]
    bare, _ = compress(spark.createDataFrame([(1, [], 1), (2, [], 1)], kind), Scratch(spark))
    assert sorted(map(tuple, bare.collect())) == [(1, 1, "00" * 16, 0, 0), (2, 1, "00" * 16, 0, 0)]
    none, _ = compress(spark.createDataFrame([], kind), Scratch(spark))
    assert none.count() == 0


def test_query_is_sql_over_ragged_tables(spark, tmp_path):
    import duckdb

    rows = [r for r in vectors() if r[0] not in (None, 1_000, 3_000, 3_001, 3_002, 3_004)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = registry.queries()["op11_vector_codes"](spark, str(tmp_path))
    sql = con.execute(registry.oracle_sql()["op11_vector_codes"])
    names = [c[0] for c in sql.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(sql.fetchall(), key=repr)
