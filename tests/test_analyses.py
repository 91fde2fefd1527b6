import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import dates as D
from lodestrata.functions import numbers as N
from lodestrata.functions import text as X
from lodestrata.operators import baselines, checks, drift, impact, repair, report
from lodestrata.operators.config import Config, ConfigError, parse
from lodestrata.operators.findings import Finding, collapse, ordered, summary
from lodestrata.operators.initialize import learn, to_toml
from lodestrata.operators.profile import classes, dictionary, facts, parsed, profile
from lodestrata.operators.references import Reference, ReferenceFault, check_reference
from lodestrata.operators.rows import repeated_rows
from lodestrata.sources import sinks
from lodestrata.sources import store as files
from lodestrata.sources.tables import LoadError, TextTable, column_keys, discover, quote_fault, read_csv, read_parquet, scan_bytes, sniff_delimiter

NOW = datetime.datetime(2024, 6, 1)


def table(spark, header, *rows):
    schema = "row_no long, " + ", ".join(f"c{i} string" for i in range(len(header)))
    return TextTable(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], schema), header)


def codes(spark, header, *rows, config=None):
    done = profile(table(spark, header, *rows), NOW)
    return {f.code for f in checks.run_checks(done, config)}


CLEAN = [("A-1", "Acme", "2024-01-05", "North", "3", "19.50"), ("A-2", "Bolt", "2024-01-06", "South", "4", "20.25"), ("A-3", "Acme", "2024-01-07", "North", "5", "18.00"), ("A-4", "Core", "2024-02-07", "East", "6", "22.75")]
HEAD = ["order_id", "customer", "order_date", "region", "quantity", "order_total"]


def test_clean_table_is_silent(spark):
    found = checks.run_checks(profile(table(spark, HEAD, *CLEAN), NOW), Config(key=["order_id"]))
    assert summary(found)["error"] == summary(found)["warning"] == 0


def test_defects(spark):
    rows = [("1", "07/05/2024", "$1,000.00", "North", "=1+1", "x1@ex.com"), ("2", "27/04/2024", "12", "north", "ok", "x2@ex.com"), ("2", "04/27/2024", "twelve", "North ", "CafÃ©", "x3@ex.com"), ("", "2030-01-01", "9", "North", "N/A", "x4@ex.com"), ("5", "05/06/2024", "8", "North", "ok", "x5@ex.com")]
    found = codes(spark, ["id", "when", "amount", "region", "note", "contact"], *rows, config=Config(key=["id", "nope"]))
    assert {"key-null", "key-not-unique", "missing-key-column", "conflicting-date-formats", "future-dates", "mixed-types", "number-as-text", "label-variants", "whitespace", "formula-injection", "mojibake", "disguised-null", "sensitive-data"} <= found


def test_empty_and_header_defects(spark):
    assert "no-data-rows" in codes(spark, ["a", "b"])
    found = codes(spark, ["a", "a", "", " b", "B"], ("1", "2", "", "4", "5"), ("1", "3", "", "5", "6"))
    assert {"duplicate-column-name", "unnamed-column", "padded-column-name", "similar-column-names", "empty-column", "constant-column"} <= found


def test_column_keys_skip_names_in_use():
    assert column_keys(["a", "a", "a#1"]) == ["a#2", "a#3", "a#1"]


def test_repair_is_idempotent_and_impact_adds_up(spark):
    rows = [("1", "North", "$1,000.00"), ("2", "north", "12"), ("3", "North ", "-999"), ("4", "South", "-999"), ("5", "North", "x"), ("6", "South", "3")]
    done = profile(table(spark, ["n", "region", "total"], *rows), NOW)
    out = repair.plan(done, None, "medium")
    fixed = [tuple(r)[1:] for r in out.table.orderBy("row_no").collect()]
    assert fixed[0] == ("1", "North", "1000.00") and fixed[1][1] == fixed[2][1] == "North" and fixed[2][2] == ""
    again = repair.plan(profile(TextTable(out.table, ["n", "region", "total"]), NOW), None, "medium")
    assert again.changes.count() == 0
    r = impact.sum_impact(out, "total").first()
    assert r["difference"] == pytest.approx(r["recovered_amount"] + r["removed_amount"])
    assert (r["coerced_total"], r["repaired_total"]) == (-1983.0, 1015.0)
    whole, merges = impact.group_impact(out, "region")
    assert (whole.first()["groups_before"], whole.first()["groups_after"]) == (4, 2) and merges.count() == 1
    assert "mixed-types" in {x.rule for x in out.refusals}
    assert '"schema_version": 1' in report.plan_json(out, True)


def test_duplicates_keep_the_first(spark):
    done = profile(table(spark, ["a", "b"], ("x", "1"), ("x ", "1"), ("y", "2")), NOW)
    out = repair.plan(done, None, "high", True)
    assert [r["row_no"] for r in out.rows.orderBy("row_no").collect()] == [0, 2]
    gone = out.dropped.first()
    assert (gone["row_no"], gone["kept_row"], gone["matched_after_normalization"]) == (1, 0, True)


def test_sensitive_values_stay_hidden(spark):
    rows = [(f"u{i}@ex.com ", str(i)) for i in range(5)]
    done = profile(table(spark, ["email", "n"], *rows), NOW)
    found = checks.run_checks(done)
    assert not any("@" in x for f in found for x in f.examples)
    out = repair.plan(done)
    assert out.changes.count() == 0 and "sensitive-value-preserved" in {x.rule for x in out.refusals}


def test_references(spark):
    local = table(spark, ["id", "cust"], ("1", "C-1"), ("2", "c-1 "), ("3", "C-9"), ("4", ""))
    foreign = table(spark, ["id"], ("C-1",), ("C-2",), ("C-2",))
    found = {f.code: f for f in check_reference(local, Reference.parse("f.csv:cust=id"), Config(), lambda _: foreign)}
    assert set(found) == {"reference-not-unique", "orphaned-reference", "reference-matches-after-cleaning", "reference-null"}
    assert found["orphaned-reference"].detail["rows"] == 2
    with pytest.raises(ReferenceFault):
        Reference.parse("nothing")


def test_drift(spark):
    old = profile(table(spark, ["a", "b", "gone"], *[(x, str(10 + i), "z") for i, x in enumerate("ppqqpq")]), NOW)
    new = profile(table(spark, ["b", "a", "more"], *[(str(50 + i), x, "z") for i, x in enumerate("ppr")]), NOW)
    assert {f.code for f in drift.compare(old, new)} == {"column-removed", "column-added", "column-order-changed", "distribution-shift", "new-category", "missing-category", "row-count-shift"}
    with pytest.raises(drift.DriftError):
        drift.compare(profile(table(spark, ["a"]), NOW), new)


def test_csv_findings(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(b'a;b\r\n1;"x\ny"\n2\n\n3;z;q')
    got = read_csv(spark, str(path))
    assert [tuple(r)[1:] for r in got.df.orderBy("row_no").collect()] == [("1", "x\ny"), ("2", ""), ("3", "z")]
    assert {"ragged-rows", "mixed-line-endings", "no-trailing-newline"} <= {f.code for f in got.findings}
    path.write_text('a,b\n1,"x\n')
    with pytest.raises(LoadError):
        read_csv(spark, str(path))


def test_bytes_and_quotes():
    assert scan_bytes(b"\xef\xbb\xbfa\r\nb\n\0")["nuls"] == 1
    assert scan_bytes(b"a\xff")["invalid_at"] == 1
    assert quote_fault('a,b"c\n', ",") and quote_fault('"a"b\n', ",") and not quote_fault('"a""b",c\n', ",")
    assert sniff_delimiter("a;b\n1;2\n") == ";"
    with pytest.raises(LoadError):
        sniff_delimiter("", "ab")


@pytest.mark.parametrize("bad", [{"nope": 1}, {"null_warn": 2}, {"null_warn": 0.6, "null_error": 0.5}, {"max_examples": -1}, {"columns": {"a": {"role": "x"}}}, {"columns": {"a": {"role": "date", "min_value": 1}}}, {"columns": {"a": {"min_value": 2, "max_value": 1}}}, {"outlier_z": True}])
def test_bad_configs(bad):
    with pytest.raises(ConfigError):
        parse(bad)


def test_reports_collapse_and_learning():
    many = [Finding("whitespace", "warning", "m", f"c{i}", {"column_index": i}) for i in range(9)]
    assert len(collapse(many)) == 1
    found = [Finding("outliers", "info", "m", "x", {"column_index": 1}), Finding("mojibake", "error", "m\u001b", "y", {"column_index": 0})]
    assert ordered(found)[0].code == "mojibake"
    learnt = learn(found)
    assert learnt.ignore_columns == {"x": ["outliers"]} and [f.code for f in learnt.kept] == ["mojibake"]
    assert parse(__import__("tomllib").loads(to_toml(learnt))).silenced("outliers", "x")
    for render in (report.text, report.as_json, report.as_html):
        assert "mojibake" in render("f", 1, 2, found) and "\u001b" not in report.text("f", 1, 2, found)
    assert report.annotations("a,b", found).startswith("::error file=a%2Cb")


def test_baselines(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a\n1\n")
    store = str(tmp_path / "s")
    saved = baselines.save(spark, store, "one", str(path), 1, ["a"])
    assert saved["sha256"] == hashlib.sha256(b"a\n1\n").hexdigest()
    assert baselines.names(spark, store) == ["one"] and baselines.verify(spark, store, "one").endswith("t.csv")
    for name, rows in (("one", 1), ("two", 0), ("../x", 1)):
        with pytest.raises(baselines.BaselineError):
            baselines.save(spark, store, name, str(path), rows, ["a"])
    files.create(spark, f"{store}/.lock", b"")
    for refused in (lambda: baselines.save(spark, store, "two", str(path), 1, ["a"]), lambda: baselines.delete(spark, store, "one")):
        with pytest.raises(baselines.BaselineError):
            refused()
    files.remove(spark, f"{store}/.lock")
    folder = tmp_path / "parts.parquet"
    spark.range(5).repartition(2).write.parquet(str(folder))
    baselines.save(spark, store, "parts", str(folder), 5, ["id"])
    assert spark.read.parquet(baselines.verify(spark, store, "parts")).count() == 5
    (tmp_path / "s" / "one" / "t.csv").write_text("changed")
    with pytest.raises(baselines.BaselineError):
        baselines.verify(spark, store, "one")
    baselines.delete(spark, store, "one")
    assert baselines.names(spark, store) == ["parts"] and sorted(x.name for x in (tmp_path / "s").iterdir()) == ["parts"]
    with pytest.raises(baselines.BaselineError):
        baselines.show(spark, store, "one")


def test_files_are_whole_or_not_there(spark, tmp_path):
    path = f"{tmp_path}/r.txt"
    sinks.write_text(spark, path, "one é")
    (tmp_path / "r.txt").chmod(0o640)
    sinks.write_text(spark, path, "two")
    assert (tmp_path / "r.txt").read_text() == "two" and (tmp_path / "r.txt").stat().st_mode & 0o777 == 0o640
    assert [x.name for x in tmp_path.iterdir()] == ["r.txt"]
    with pytest.raises(FileExistsError):
        files.create(spark, path, b"three")
    assert files.read_range(spark, path, 1, 9) == b"wo"


def test_discovery(spark, tmp_path):
    for name in ("b.csv", "a.TSV", "sub/c.xlsx", "sub/d.txt", "sub/t.parquet/part-0.parquet"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    top = str(tmp_path)
    assert discover(spark, [top]) == [f"{top}/{x}" for x in ("a.TSV", "b.csv", "sub/c.xlsx", "sub/t.parquet")]
    assert discover(spark, [top], recursive=False) == [f"{top}/a.TSV", f"{top}/b.csv"]
    assert discover(spark, [f"{top}/*.csv", f"{top}/sub/d.txt", f"{top}/b.csv"]) == [f"{top}/b.csv", f"{top}/sub/d.txt"]
    assert discover(spark, [f"file://{top}/sub"])[0].startswith("file:/")
    with pytest.raises(LoadError):
        discover(spark, [f"{top}/none*"])


def test_rows_of_files_keep_their_numbers(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(1000).selectExpr("id", "CAST(id % 7 AS STRING) AS w").repartitionByRange(5, "id").sortWithinPartitions("id").write.option("parquet.block.size", 1024).parquet(path)
    want = [(k, str(k)) for k in range(1000)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "700", "2000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read_parquet(spark, path)
            assert sorted(map(tuple, got.df.select("row_no", "c0").collect())) == want
            assert {r["value"]: r["first_row"] for r in dictionary(got, [1]).collect()} == {str(k): k for k in range(7)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert read_parquet(spark, path, 3).df.count() == 3


def test_values_alike_are_counted_as_one_class(spark):
    """Readings by shape are those of the functions, and thousands of plain values make a handful of classes."""
    odd = ["", " ", "n/a", "NaN", "No", "$5", "$1.234", "€1,234", "1,234", "0,123", "1.5", "007", "20240115", "20241315", "$20240115", " 12", "-3", "12%", "(4.50)", "999", "-999,0", "1" * 400, "05/06/2024", "Jan 5, 2024", "=1+1", " @a", "+1 555 123 4567", "555-123-4567", "4111-1111-1111-1111", "gb82west12345698765432", "a@b.com", "CafÃ©", "a  b", "a\tb", "x\xa0", "٣"]
    rows = [(0, v, 2, k) for k, v in enumerate(odd)] + [(1, f"{k}", 1, k) for k in range(1000, 6000)] + [(2, f"${k}.75", 1, k) for k in range(1000, 6000)]
    words = parsed(spark.createDataFrame(rows, "col int, value string, n long, first_row long"), datetime.datetime(2001, 1, 1))
    v, own = F.col("value"), words.where("col = 0")
    real = F.when(~X.is_null_token(v), 1)
    same = own.select((F.col("en").eqNullSafe(F.when(real == 1, N.parse_number(v))) & F.col("eu").eqNullSafe(F.when(real == 1, N.parse_number(v, "eu"))) & F.col("null_token").eqNullSafe(X.is_null_token(v)) & F.col("ts").eqNullSafe(F.get(D.parse_dates(v), 0)["ts"])).alias("x"))
    assert same.where("NOT x").count() == 0
    found = {r["col"]: r for r in facts(words).collect()}
    counted = {"n_null": X.is_null_token(v), "whitespace": ~X.is_blank(v) & X.whitespace_problem(v).isNotNull(), "mojibake": X.has_mojibake(v), "formula": N.is_formula_like(v), "emails": X.is_email(v), "cards": X.is_card(v), "ibans": X.is_iban(v), "phones_international": X.is_international_phone(v), "phones_any": X.is_international_phone(v) | X.is_local_phone(v)}
    plain = own.agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(k) for k, c in counted.items()]).first()
    assert {k: found[0][k] for k in counted} == plain.asDict() and min(plain) > 0
    assert found[1]["en_mean"] == 3499.5 and found[2]["en_flag_currency"] == found[2]["en_n"] == 5000 and found[2]["eu_n"] == 5000
    assert classes(words.where("col > 0")).count() <= 4


def test_examples_are_gathered_in_one_pass(spark, monkeypatch):
    rows = [(f"{k}" if k % 4 else "later", f"${k}", " x" if k % 2 else "N/A", "=1+1" if k % 3 else "-a") for k in range(40)]
    done = profile(table(spark, ["n", "money", "word", "run"], *rows), NOW)
    alone = {(f.code, f.column): f.examples for fn in checks.CHECKS for f in fn(done, Config())}
    passes, real = [], checks.samples
    monkeypatch.setattr(checks, "samples", lambda *a: passes.append(len(a[1])) or real(*a))
    found = {(f.code, f.column): f.examples for f in checks.run_checks(done, Config())}
    done.close()
    assert len(passes) == 1 and passes[0] >= 5 and done.requests is None
    assert found == alone
    assert found["mixed-types", "n"] == ["later"] and found["whitespace", "word"] == ["' x'"] and found["formula-injection", "run"] == ["-a", "=1+1"] and found["number-as-text", "money"] == ["$0", "$1", "$2"]


def test_rows_stay_where_few_repeat(spark):
    df = table(spark, ["a", "b"], *[(f"{k % 37}", f"{k}" if k % 10 else "") for k in range(370)], ("1", "1"), ("0", "")).df
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = repeated_rows(df, ["c0", "c1"])
        join = found._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["row_no"], r["kept_row"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    seen, want = {}, set()
    for r in sorted(df.collect(), key=lambda r: r["row_no"]):
        first = seen.setdefault((r["c0"], r["c1"]), r["row_no"])
        want |= {(r["row_no"], first)} if first != r["row_no"] else set()
    assert got == want and len(want) == 2
    assert "strategy=broadcast" in join
