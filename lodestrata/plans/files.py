"""Files written from a given table, with planted faults, and what readers, stores and reports must say of them."""

from __future__ import annotations

import html
import json
import re

from pyspark.sql import functions as F

from ..operators import baselines, report
from ..operators import checks as C
from ..operators.config import Config
from ..operators.profile import profile
from ..sources import store
from ..sources.tables import LoadError, TextTable, _pinned, discover, read_csv, read_parquet, scan_file, sniff_delimiter
from .catalog import register
from .dirt import dirty
from .evidence import _FOUND
from .planted import _AMOUNT, _REGION
from .quality import NOW

_HEAD = 64 * 1024
_CELLS = ("CAST(id AS STRING)", _REGION, _AMOUNT)


def _joined(sep: str, cells: tuple = _CELLS) -> str:
    return f" || '{sep}' || ".join(f"({c})" for c in cells)


#: Lines of a part file, which one task sorts and writes.
PART_LINES = 250_000


def written(spark, sf_dir, head: str, line: str, end: str = "\n", coding: str = "UTF-8") -> str:
    """The path of one text, in part files, with a line for each order in order of its key behind a header."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit(1).alias("at"), F.col("o_orderkey").alias("id"))
    parts = -(-(orders.count() + 1) // PART_LINES)
    every = orders.unionByName(spark.createDataFrame([(0, None)], "at int, id long"))
    sorted_ = every.repartitionByRange(parts, "at", "id").sortWithinPartitions("at", "id")
    lines = sorted_.select(F.when(F.col("at") == 0, F.lit(head)).otherwise(F.expr(line)).alias("line"))
    folder = store.shared_path(spark, "lines")
    lines.select(F.encode("line", coding).cast("string").alias("line")).write.option("lineSep", end).text(folder)
    return folder


def damaged_files(spark, sf_dir) -> dict[str, TextTable]:
    head, line = "id,region,amount", _joined(",")
    ragged = f"CASE WHEN id % 10 = 7 THEN {_joined(',', _CELLS[:2])} ELSE {line} END"
    made = {"ragged row": (head, ragged), "byte-order mark": ("﻿" + head, line), "two line ends": (head, f"CASE WHEN id % 2 = 0 THEN {line} || chr(13) ELSE {line} END")}
    return {k: read_csv(spark, written(spark, sf_dir, *v)) for k, v in made.items()}


# --- bytes, quotes and rows of files ---------------------------------------------------------------------

#: file: (separator, before the header, what lines end with beside their end, line end, coding)
FILES = {
    "plain": (",", "", "''", "\n", "UTF-8"),
    "semicolons": (";", "", "''", "\r\n", "UTF-8"),
    "tabs": ("\t", "", "CASE WHEN id % 2 = 0 THEN chr(13) ELSE '' END", "\n", "UTF-8"),
    "bars": ("|", "", "''", "\n", "UTF-8"),
    "marked": (",", "﻿", "''", "\n", "UTF-8"),
    "nuls": (",", "", "CASE WHEN id % 97 = 0 THEN chr(0) ELSE '' END", "\n", "UTF-8"),
    "latin": (",", "", "CASE WHEN id % 50 = 49 THEN chr(233) ELSE '' END", "\n", "ISO-8859-1"),
}


def _file_row(name: str, sep: str, before: str, more: str, end: str, coding: str) -> str:
    line = f"({_joined(sep)} || {more})"
    crlf = "count(*) + 1" if end == "\r\n" else f"count(*) FILTER ({more} = chr(13))"
    lf = "0" if end == "\r\n" else f"count(*) + 1 - count(*) FILTER ({more} = chr(13))"
    bad = f"{len('id,region,amount') + 1} + sum(len({line}) + 1) FILTER (id < 49) + max(len({line}) - 1) FILTER (id = 49)" if coding != "UTF-8" else "NULL"
    shown = "chr(9)" if sep == "\t" else f"'{sep}'"
    return f"SELECT '{name}' AS name, {shown} AS delimiter, {'true' if before else 'false'} AS bom, {crlf} AS crlf, {lf} AS lf, count(*) FILTER ({more} = chr(0)) AS nuls, CAST({bad} AS BIGINT) AS invalid_at, true AS in_ranges, false AS ends_open FROM t"


#: Least bytes of a range, and most of a piece that a range's summary is composed of.
_PIECE = 16 * 1024
#: Ranges of a larger text, as a task has to be worth its start, and most bytes of one.
_RANGES, _RANGE = 64, 128 * 1024 * 1024


@register("file_bytes", "WITH t AS (SELECT o_orderkey AS id FROM orders) " + " UNION ALL ".join(_file_row(k, *v) for k, v in FILES.items()))
def file_bytes(spark, sf_dir):
    """Bytes of files read in several ranges, of 16 kB where they are small, and composed from pieces of about 16 kB whatever their size."""
    session, rows = _pinned(spark), []
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_PIECE))
    for name, (sep, before, more, end, coding) in FILES.items():
        path = written(spark, sf_dir, before + sep.join(("id", "region", "amount")), f"{_joined(sep)} || {more}", end, coding)
        session.conf.set("spark.sql.files.maxPartitionBytes", str(min(_RANGE, max(_PIECE, store.size(spark, path) // _RANGES))))
        head = store.head(spark, path, _HEAD)
        found = scan_file(session, path, head, sep.encode())
        held = found.held
        rows.append((name, sniff_delimiter(head.decode("utf-8-sig", "ignore")), held.head.startswith(b"\xef\xbb\xbf"), held.crlf, held.lf - held.crlf, held.nuls, held.invalid_at, len(found.entries) > 1, held.last not in (b"\n", b"\r")))
    return spark.createDataFrame(rows, "name string, delimiter string, bom boolean, crlf long, lf long, nuls long, invalid_at long, in_ranges boolean, ends_open boolean")


_QUOTED = "CAST(id AS STRING) || ',\"' || CASE WHEN id % 7 = 0 THEN 'two' || chr(10) || 'lines' ELSE 'say \"\"x\"\"' END || '\",z'"
#: fault: (what the faulty line is, what is said of it)
FAULTS = {
    "none": (None, None),
    "inside": ("CAST(id AS STRING) || ',x\"y\",z'", "a quote stands inside an unquoted field"),
    "after": ("CAST(id AS STRING) || ',\"x\"y,z'", "text follows a closing quote"),
    "never": ("CAST(id AS STRING) || ',\"never,z'", "a quoted field never ends"),
}


def _fault_row(name: str, line: str | None, said: str | None) -> str:
    at = "m" if name == "never" else "h"
    if line is None:
        return f"SELECT '{name}' AS fault, CAST(NULL AS VARCHAR) AS said, count(*) AS n, count(*) FILTER (id % 7 = 0) AS over_lines FROM t"
    return f"SELECT '{name}', 'line ' || (2 + {at} + (SELECT count(*) FROM t WHERE id % 7 = 0 AND id < {at})) || ': {said}', NULL, NULL FROM k"


@register("quote_states", "WITH t AS (SELECT o_orderkey AS id FROM orders), k AS (SELECT max(id) AS m, max(id) // 2 AS h FROM t) " + " UNION ALL ".join(_fault_row(k, *v) for k, v in FAULTS.items()))
def quote_states(spark, sf_dir):
    """The first fault of a file's quoting, and its records where there is none; quoted cells hold quotes and line ends."""
    last = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.max("o_orderkey")).first()[0]
    rows = []
    for name, (line, _) in FAULTS.items():
        at = last if name == "never" else last // 2
        path = written(spark, sf_dir, "id,text,z", _QUOTED if line is None else f"CASE WHEN id = {at} THEN {line} ELSE {_QUOTED} END")
        try:
            table = read_csv(spark, path)
            n = table.df.agg(F.count("*").alias("n"), F.count_if(F.col("c1").contains("\n")).alias("lines")).first()
            rows.append((name, None, n["n"], n["lines"]))
        except LoadError as error:
            rows.append((name, str(error).removeprefix(f"{path}: "), None, None))
    return spark.createDataFrame(rows, "fault string, said string, n long, over_lines long")


@register("ragged_lines", f"""WITH t AS (SELECT o_orderkey AS id, {_AMOUNT} AS amount FROM (SELECT *, o_orderkey AS id FROM orders))
SELECT count(*) FILTER (id % 50 IN (7, 9)) AS rows, (SELECT string_agg(CAST(id + 2 AS VARCHAR), ',' ORDER BY id) FROM (SELECT id FROM t WHERE id % 50 IN (7, 9) ORDER BY id LIMIT 5)) AS lines,
CAST(3 AS BIGINT) AS expected, count(*) FILTER (id % 50 <> 7) AS with_amount, max(amount) FILTER (id = 9) AS cut, least(count(*), 100) AS capped FROM t""")
def ragged_lines(spark, sf_dir):
    """Short rows are padded and long ones cut; the first hundred rows of the file are what a cap leaves."""
    line = f"CASE WHEN id % 50 = 7 THEN {_joined(',', _CELLS[:2])} WHEN id % 50 = 9 THEN {_joined(',')} || ',more' ELSE {_joined(',')} END"
    path = written(spark, sf_dir, "id,region,amount", line)
    table = read_csv(spark, path)
    found = next(f for f in table.findings if f.code == "ragged-rows")
    whole = table.df.agg(F.count_if(F.col("c2") != "").alias("with_amount"), F.max(F.when(F.col("row_no") == 9, F.col("c2"))).alias("cut"))
    capped = read_csv(spark, path, max_rows=100).df.agg(F.count("*").alias("capped"))
    detail = spark.createDataFrame([(found.detail["count"], ",".join(map(str, found.detail["lines"])), found.detail["expected"])], "rows long, lines string, expected long")
    return detail.join(whole).join(capped)


# --- stores ------------------------------------------------------------------------------------------------

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@register("discovered_tables", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def discovered_tables(spark, sf_dir):
    """The tables found under the given folder, each with its rows."""
    found = [p for p in discover(spark, [sf_dir]) if p.rstrip("/").rsplit("/", 1)[-1].split(".")[0] in TABLES]
    counts = [spark.read.parquet(p).agg(F.lit(p.rstrip("/").rsplit("/", 1)[-1].split(".")[0]).alias("name"), F.count("*").alias("n")) for p in found]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@register("baseline_store", "SELECT 'orders' AS name, count(*) AS n, true AS verified, true AS same_rows, true AS refused_twice, true AS refused_locked, true AS refused_changed, true AS gone FROM orders")
def baseline_store(spark, sf_dir):
    """A snapshot of a given table: saved, verified, and refused where it must be."""
    root, path = store.shared_path(spark, "baselines"), f"{sf_dir}/orders.parquet"
    table = read_parquet(spark, path)

    def refused(act) -> bool:
        try:
            act()
        except baselines.BaselineError:
            return True
        return False

    n = table.df.count()
    baselines.save(spark, root, "orders", path, n, table.header)
    kept = baselines.verify(spark, root, "orders")
    same = spark.read.parquet(kept).exceptAll(spark.read.parquet(path)).isEmpty()
    twice = refused(lambda: baselines.save(spark, root, "orders", path, n, table.header))
    store.create(spark, f"{root}/.lock", b"")
    locked = refused(lambda: baselines.save(spark, root, "other", path, n, table.header))
    store.remove(spark, f"{root}/.lock")
    store.put(spark, f"{kept}/more" if store.is_folder(spark, kept) else kept, b"changed")
    changed = refused(lambda: baselines.verify(spark, root, "orders"))
    baselines.delete(spark, root, "orders")
    rows = [("orders", n, True, same, twice, locked, changed, baselines.names(spark, root) == [])]
    return spark.createDataFrame(rows, "name string, n long, verified boolean, same_rows boolean, refused_twice boolean, refused_locked boolean, refused_changed boolean, gone boolean")


# --- reports -----------------------------------------------------------------------------------------------

_COUNTS = "count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos"


@register("report_formats", f"{_FOUND}, f AS (SELECT * FROM t WHERE n > 0) " + " UNION ALL ".join(f"SELECT '{k}' AS format, {_COUNTS}, (SELECT string_agg(code, ',' ORDER BY code) FROM (SELECT DISTINCT code FROM f)) AS codes, (SELECT count(*) FROM d) AS n_rows, true AS safe FROM f" for k in ("text", "json", "html", "ci", "batch")))
def report_formats(spark, sf_dir):
    """The findings of the dirty table, read back from a report in every format; names with marks in them do no harm."""
    done = profile(dirty(spark, sf_dir, "orders"), NOW)
    found = C.run_checks(done, Config(key=["order_id"]))
    name, size = "a\x1b<b>,50%.csv", (done.n_rows, len(done.columns))
    text, js, page, ci = report.text(name, *size, found), json.loads(report.as_json(name, *size, found)), report.as_html(name, *size, found), report.annotations(name, found)
    both = report.rollup([(name, found), ("other", found)])
    kinds = ("error", "warning", "info")

    def row(kind: str, counts: list[int], codes, n: int, safe: bool) -> tuple:
        return (kind, *counts, ",".join(sorted(set(codes))), n, safe)

    said = re.findall(r"^(ERROR|WARNING|INFO) +([a-z-]+)", text, re.MULTILINE)
    cells = re.findall(r"<tr><td class=(\w+)>\w+</td><td>([a-z-]+)</td>", page)
    notes = re.findall(r"^::(\w+) file=.*?,title=([a-z-]+)::", ci, re.MULTILINE)
    rows = [
        row("text", [sum(s == k.upper() for s, _ in said) for k in kinds], [c for _, c in said], int(re.search(r": ([\d,]+) rows?,", text)[1].replace(",", "")), "\x1b" not in text),
        row("json", [js["summary"][k] for k in kinds], [f["code"] for f in js["findings"]], js["rows"], js["file"] == name),
        row("html", [sum(s == k for s, _ in cells) for k in kinds], [c for _, c in cells], int(re.search(r"<p>([\d,]+) rows", page)[1].replace(",", "")), "<b>" not in page and html.escape("<b>") in page),
        row("ci", [sum(s == k for s, _ in notes) for k in ("error", "warning", "notice")], [c for _, c in notes], done.n_rows, "50%25" in ci and "%2C" in ci),
        row("batch", [both["files"]["other"][k] for k in kinds], [f.code for f in found], done.n_rows, all(x["files"] == 2 for x in both["shared"]) and {x["code"] for x in both["shared"]} <= {f.code for f in found}),
    ]
    return spark.createDataFrame(rows, "format string, errors long, warnings long, infos long, codes string, n_rows long, safe boolean")
