"""Registered queries against the SQL that states their result, and the command line."""

import duckdb
import pytest

import lodestrata.plans.evidence  # noqa: F401
import lodestrata.plans.files  # noqa: F401
import lodestrata.plans.planted  # noqa: F401
import lodestrata.plans.quality  # noqa: F401
from tests.typed_cases import CASES
from lodestrata.cli import main
from lodestrata.plans import catalog
from lodestrata.plans.files import TABLES

SF = "/root/testdata/sf0.01"
NAMES = ("kind_decisions", "planted_damage", "findings_orders_dirty", "drift_findings", "reference_findings", "policy_findings", "redacted_findings", "text_predicates", "name_predicates", "number_evidence_kinds", "date_formats", "file_bytes", "quote_states", "ragged_lines", "repair_refusals", "repair_preview", "write_gates", "sink_round_trip", "configurations", "report_formats", "stream_watermark", "header_checks", "no_rows", "collapsed_findings", "silenced_findings", "discovered_tables", "baseline_store", "init_config")


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    found = catalog.queries()[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in found.columns)
    expected = con.execute(f"SELECT {columns} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))


@pytest.mark.parametrize("name", CASES)
def test_typed_case(spark, con, name):
    case, sql = CASES[name]
    found = case(spark, SF)
    columns = ", ".join(f'"{c}"' for c in found.columns)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, con.execute(f"SELECT {columns} FROM ({sql})").fetchall()))


def test_command_line(spark, tmp_path, capsys):
    good = tmp_path / "a.csv"
    good.write_text("id,word\n1, x\n2,y\n3,y\n")
    assert main(["check", str(good), "--key", "id"]) == 0 and "whitespace" in capsys.readouterr().out
    assert main(["profile", str(good)]) == 0 and "3 rows" in capsys.readouterr().out
    assert main(["fix", str(good), "--dry-run", "--explain"]) == 0
    out = capsys.readouterr().out
    assert "word: trim-whitespace (high)  1 cell" in out and "trim-whitespace: cuts blanks" in out
    assert main(["fix", str(good)]) == 0 and main(["diff", str(good), str(good)]) == 0
    named = tmp_path / "b.csv"
    named.write_text("id,=A1\n1, x\n2,y\n")
    assert main(["fix", str(named)]) == 2 and "header-hazard" in capsys.readouterr().err
    assert main(["check", str(tmp_path / "none.csv")]) == 2
