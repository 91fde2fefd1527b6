"""Findings, repairs and impacts as text, JSON, HTML and CI annotations."""

from __future__ import annotations

import html
import json
import textwrap

from .findings import RANK, Finding, ordered, summary


def safe(text: str) -> str:
    """Without characters that a terminal would act on."""
    return "".join(c if c.isprintable() or c == "\n" else f"\\u{ord(c):04x}" for c in text)


def plural(n: int, word: str) -> str:
    return f"{n:,} {word}{'' if n == 1 else 's'}"


def number(value: float) -> str:
    return f"{value:,.0f}" if value == int(value) else f"{value:,.4f}".rstrip("0").rstrip(".")


def percent(part: float, whole: float) -> str:
    share = part / whole if whole else 0.0
    return "<0.1%" if 0 < share < 0.001 else f"{share:.1%}"


def tally(found: list[Finding]) -> str:
    counts = summary(found)
    if not found:
        return "no findings"
    return f"{plural(len(found), 'finding')}: " + ", ".join(f"{counts[s]} {s}" for s in RANK if counts[s])


def text(path: str, rows: int, columns: int, found: list[Finding]) -> str:
    out = [f"{safe(path)}: {plural(rows, 'row')}, {plural(columns, 'column')}", ""]
    for f in ordered(found):
        out.append(f"{f.severity.upper():8}{f.code}" + (f"  [{safe(f.column)}]" if f.column else ""))
        out += textwrap.wrap(safe(f.message), 96, initial_indent="        ", subsequent_indent="        ")
        if f.examples:
            out.append("        e.g. " + "; ".join(safe(x) for x in f.examples))
    return "\n".join([*out, "", tally(found)]) + "\n"


def as_json(path: str, rows: int, columns: int, found: list[Finding]) -> str:
    items = [{"code": f.code, "severity": f.severity, "column": f.column, "message": f.message, "detail": f.detail, "examples": f.examples} for f in ordered(found)]
    return json.dumps({"file": path, "rows": rows, "columns": columns, "summary": summary(found), "findings": items}, ensure_ascii=False, indent=1, default=str) + "\n"


_STYLE = "body{font:14px sans-serif;margin:2em;max-width:60em}.error{color:#a00}.warning{color:#960}.info{color:#06a}td{padding:.2em .8em;vertical-align:top}"


def as_html(path: str, rows: int, columns: int, found: list[Finding]) -> str:
    e = html.escape
    body = "".join(f"<tr><td class={f.severity}>{f.severity}</td><td>{e(f.code)}</td><td>{e(f.column or '')}</td><td>{e(f.message)}<br><small>{e('; '.join(f.examples))}</small></td></tr>" for f in ordered(found))
    return f"<!doctype html><meta charset=utf-8><title>{e(path)}</title><style>{_STYLE}</style><h1>{e(path)}</h1><p>{rows:,} rows, {columns} columns; {e(tally(found))}</p><table>{body}</table>\n"


def batch_html(reports: list[tuple[str, int, int, list[Finding]]]) -> str:
    return "<hr>".join(as_html(*r) for r in reports)


def annotations(path: str, found: list[Finding]) -> str:
    """Workflow commands of a CI run; no cell values."""
    level = {"error": "error", "warning": "warning", "info": "notice"}
    clean = lambda t: t.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    prop = lambda t: clean(t).replace(":", "%3A").replace(",", "%2C")
    return "".join(f"::{level[f.severity]} file={prop(path)},title={prop(f.code)}::{clean(f.message)}\n" for f in ordered(found))


def rollup(reports: list[tuple[str, list[Finding]]], top: int = 8) -> dict:
    """Severities by file, and the codes that most files share."""
    shared: dict[str, set] = {}
    for path, found in reports:
        for f in found:
            shared.setdefault(f.code, set()).add(path)
    common = sorted(((len(v), k) for k, v in shared.items() if len(v) > 1), key=lambda x: (-x[0], x[1]))[:top]
    return {"files": {path: summary(found) for path, found in reports}, "shared": [{"code": k, "files": n} for n, k in common]}


def plan_text(repair, explain: bool = False) -> str:
    """A repair preview for a reader: counts by column and rule, what is refused and why; no cell values."""
    from pyspark.sql import functions as F

    from .repair import EXPLAINED

    counts = repair.counts().orderBy("column_index", "rule").collect()
    out = [plural(sum(r["n"] for r in counts), "change") + f" in {plural(len({r['column_index'] for r in counts}), 'column')}"]
    out += [f"  {safe(r['column'])}: {r['rule']} ({r['confidence']})  {plural(r['n'], 'cell')}" for r in counts]
    if repair.dropped is not None:
        out.append("  rows: drop-duplicates (high)  " + plural(repair.dropped.count(), "row"))
    if repair.refusals:
        out += ["", f"{plural(len(repair.refusals), 'refusal')}:", *[f"  {safe(r.column)}: {r.rule}: {r.reason}" for r in repair.refusals]]
    if explain:
        used = list(dict.fromkeys(r["rule"] for r in counts)) + (["drop-duplicates"] if repair.dropped is not None else [])
        out += ["", "What the rules do:", *[f"  {rule}: {EXPLAINED[rule]}" for rule in used]]
    return "\n".join(out) + "\n"


def plan_json(repair, show_values: bool = False, limit: int = 20) -> str:
    """A repair preview: counts by column and rule; values only when asked for, and never private ones."""
    from pyspark.sql import functions as F

    changes = repair.changes
    counts = repair.counts().orderBy("column_index", "rule").collect()
    out = {"schema_version": 1, "changes": [r.asDict() for r in counts], "refusals": [vars(r) for r in repair.refusals]}
    if show_values:
        rows = changes.where(~F.col("column").isin(*repair.private)) if repair.private else changes
        out["values"] = [{"line": r["row_no"] + 2, "column": r["column"], "rule": r["rule"], "before": r["before"], "after": r["after"]} for r in rows.orderBy("row_no", "column_index").limit(limit).collect()]
    return json.dumps(out, ensure_ascii=False, indent=1) + "\n"
