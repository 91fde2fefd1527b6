"""Columns that clash with those of an operator's own, null ids, repeated rows and very long texts."""

import random

from lodestrata.llm import decontaminate, quality, substring_dedup, toxicity
from lodestrata.llm.scratch import Scratch

RNG = random.Random(17)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 6))) for _ in range(300)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_repeats_are_cut_beside_columns_of_any_name(spark):
    shared = prose(80, 1)
    rows = [(1, shared), (2, prose(30, 2) + " " + shared), (2, prose(30, 2) + " " + shared), (None, shared), (4, None)]
    docs = spark.createDataFrame([(i, t, "k", "s", "d") for i, t in rows], "doc_id long, text string, __key string, __spans string, __doc string")
    out = substring_dedup.remove_repeats(docs, Scratch(spark))
    assert out.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, (r["text"] or "").strip(), r["__key"] + r["__spans"] + r["__doc"]) for r in out.collect())
    assert got == sorted([(False, 1, shared, "ksd"), (False, 2, prose(30, 2), "ksd"), (False, 2, prose(30, 2), "ksd"), (True, 0, shared, "ksd"), (False, 4, "", "ksd")])


def test_several_automata_keep_a_column_named_row(spark):
    items = spark.createDataFrame([(k, prose(12, 50 + k)) for k in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{prose(20, 90 + k)} {prose(12, 50 + k)}", "mine") for k in range(20)], "doc_id long, text string, __row string")
    one = decontaminate.find(docs, items)
    many = decontaminate.find(docs, items, automaton_bytes=200)
    key = lambda df: sorted((r["doc_id"], r["__row"], r["hit_items"], [tuple(x) for x in r["hit_spans"]]) for r in df.collect())
    assert key(one) == key(many) and all(r[1] == "mine" and r[2] for r in key(many))


def test_classifiers_on_null_ids_ties_repeats_and_long_texts(spark):
    good, bad = [prose(60, k) for k in range(60)], [prose(60, 100 + k) + " zzidiotzz" for k in range(60)]
    rows = [(k, t) for k, t in enumerate(good + bad)] + [(None, good[0]), (0, good[0]), (500, prose(60_000, 7)), (501, None), (502, "")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, score string, held_out string")
    labels = spark.createDataFrame([(k, int(k < 60), int(k >= 60)) for k in range(120)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        out = module.score(docs, module.fit(docs, labels)).withColumn("held", quality.held_out())
        assert out.columns == [*docs.columns, "held"]
        got = out.collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
        assert len({r["score"] for r in got if r["text"] == good[0]}) == 1
        assert [r["held"] for r in got if r["doc_id"] is None] == [None]
    assert module.score(docs.limit(0), module.fit(docs, labels)).count() == 0
