"""Workbooks, read on the driver with openpyxl where it is installed."""

from __future__ import annotations

import datetime

from ..operators.findings import Finding
from .tables import LoadError, TextTable


def _openpyxl():
    try:
        import openpyxl
    except ImportError as error:
        raise LoadError("reading workbooks needs openpyxl") from error
    return openpyxl


def sheet_names(path: str) -> list[str]:
    """Every sheet, hidden ones too."""
    book = _openpyxl().load_workbook(path, read_only=True)
    try:
        return list(book.sheetnames)
    finally:
        book.close()


def cell_text(value) -> str:
    """A workbook cell as text."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, datetime.datetime):
        return value.strftime("%Y-%m-%d" if not (value.hour or value.minute or value.second) else "%Y-%m-%d %H:%M:%S")
    if isinstance(value, float):
        return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)
    return str(value)


def read(spark, path: str, sheet: str | None = None) -> TextTable:
    openpyxl = _openpyxl()
    book = openpyxl.load_workbook(path, data_only=True)
    if sheet is not None and sheet not in book.sheetnames:
        raise LoadError(f"{path} has no sheet {sheet!r}")
    name = sheet or book.sheetnames[0]
    rows = [r for r in book[name].iter_rows(values_only=True)]
    return from_rows(spark, path, rows, [s for s in book.sheetnames if s != name], _formulas(openpyxl, path, name))


def _formulas(openpyxl, path: str, name: str) -> int:
    return sum(c.data_type == "f" for r in openpyxl.load_workbook(path)[name].iter_rows() for c in r)


def from_rows(spark, path: str, rows: list[tuple], others: list[str] = (), formulas: int = 0) -> TextTable:
    """A table from a sheet's rows: preamble skipped, blank names filled in, empty rows dropped."""
    found: list[Finding] = []
    width = max((sum(v is not None for v in r) for r in rows), default=0)
    start = 0
    while start < len(rows) and width > 1 and sum(v is not None and str(v).strip() != "" for v in rows[start]) <= 1:
        start += 1
    if start >= len(rows):
        raise LoadError(f"{path}: the sheet has no header")
    header = [cell_text(v) if v is not None and cell_text(v).strip() else f"column_{i + 1}" for i, v in enumerate(rows[start])]
    body = [r for r in rows[start + 1 :] if any(v is not None for v in r)]
    if others:
        found.append(Finding("unread-sheets", "info", f"{len(others)} other sheets were not read.", None, {"count": len(others)}))
    if formulas:
        found.append(Finding("excel-formulas", "warning", f"{formulas} cells are formulas, read as their last value.", None, {"count": formulas}))
    if start:
        found.append(Finding("preamble-rows", "warning", f"{start} rows stand above the header.", None, {"count": start}))
    for i, name in enumerate(header):
        dates = sum(isinstance(r[i], (datetime.datetime, datetime.date)) for r in body if i < len(r))
        if 0 < dates < len(body):
            found.append(Finding("partial-excel-dates", "error", f"{name!r} holds typed dates in {dates} of {len(body)} rows.", name, {"column_index": i, "count": dates}))
    schema = "row_no long, " + ", ".join(f"c{i} string" for i in range(len(header)))
    data = [(k, *[cell_text(r[i]) if i < len(r) else "" for i in range(len(header))]) for k, r in enumerate(body)]
    return TextTable(spark.createDataFrame(data, schema), header, path, findings=found)
