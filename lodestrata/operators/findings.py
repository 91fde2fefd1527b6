"""Findings: what an analysis reports about a table."""

from __future__ import annotations

import dataclasses
import json

RANK = {"error": 3, "warning": 2, "info": 1}
#: Columns of one code beyond which findings that are no errors become one line.
COLLAPSE_AFTER = 8
SENSITIVE_CODES = ("sensitive-data", "sensitive-column-name")

@dataclasses.dataclass
class Finding:
    code: str
    severity: str
    message: str
    column: str | None = None
    detail: dict = dataclasses.field(default_factory=dict)
    examples: list[str] = dataclasses.field(default_factory=list)

    def withheld(self) -> Finding:
        """The finding without anything that a cell could be read from: whole numbers and shares stay."""
        plain = {k: v for k, v in self.detail.items() if isinstance(v, int) or k == "null_rate" or k == "rows"}
        message = self.message if self.column is None else f"{self.code} in {self.column!r}; what it looks like is not shown, since the column holds private data."
        return dataclasses.replace(self, message=message, detail=plain, examples=[])

    def as_row(self) -> tuple:
        return (self.code, self.severity, self.column, self.detail.get("column_index"), self.message, json.dumps(self.detail, sort_keys=True, default=str), self.examples)


SCHEMA = "code string, severity string, column string, column_index long, message string, detail string, examples array<string>"


def ordered(findings: list[Finding]) -> list[Finding]:
    """Worst first, then by column and code; what ties keeps its order."""
    return sorted(findings, key=lambda f: (-RANK[f.severity], f.detail.get("column_index", 1_000_000), f.code))


def redact(findings: list[Finding], sensitive: set[str]) -> list[Finding]:
    """Nothing of a private column's cells; findings about rows show cells of every column, so they lose theirs too."""
    named = {f.column for f in findings if f.code in SENSITIVE_CODES} | sensitive
    named.discard(None)
    shows_rows = {"duplicate-rows"} if named else set()
    return [f.withheld() if f.code in shows_rows or (f.column in named and f.code not in SENSITIVE_CODES) else f for f in findings]


def collapse(findings: list[Finding]) -> list[Finding]:
    """One line for a code that many columns have; errors stay one by one."""
    groups: dict[str, list[Finding]] = {}
    for f in findings:
        if f.column and f.severity != "error":
            groups.setdefault(f.code, []).append(f)
    crowded = {code: g for code, g in groups.items() if len(g) > COLLAPSE_AFTER}
    out, done = [], set()
    for f in findings:
        group = crowded.get(f.code) if f.column else None
        if group is None:
            out.append(f)
        elif f.code not in done:
            done.add(f.code)
            names = [x.column for x in group]
            out.append(Finding(f.code, f.severity, f"{len(group)} columns: {', '.join(names[:6])} and {len(names) - 6} more.", detail={"columns": names, "collapsed": len(group)}))
    return out


def summary(findings: list[Finding]) -> dict[str, int]:
    return {s: sum(f.severity == s for f in findings) for s in RANK}


def exit_code(findings: list[Finding], fail_on: str = "error") -> int:
    """1 if a finding is at ``fail_on`` or worse."""
    if fail_on in ("never", "none"):
        return 0
    return int(any(RANK[f.severity] >= RANK[fail_on] for f in findings))
