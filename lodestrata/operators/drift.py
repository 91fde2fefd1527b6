"""What changed between a baseline table and a current one."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from ..functions.text import names_identifier, plain_name
from .checks import sensitive_columns
from .config import Config
from .findings import Finding, redact
from .profile import Profiled

# How far a rate, a median and a row count may move.
NULL_JUMP, MEDIAN_SHIFT, ROW_SHIFT = 0.10, 0.25, 0.5
_POSTAL = ("zip", "zip code", "zipcode", "postal", "postal code", "postcode")


class DriftError(Exception):
    """A baseline that nothing can be compared with."""


def _occurrences(names: list[str]) -> list[tuple[str, int]]:
    seen: Counter = Counter()
    out = []
    for n in names:
        out.append((n, seen[n]))
        seen[n] += 1
    return out


def compare(old: Profiled, new: Profiled, config: Config | None = None) -> list[Finding]:
    config = config or Config()
    if not old.n_rows:
        raise DriftError("the baseline has no rows")
    out = []
    before, after = Counter(old.table.header), Counter(new.table.header)
    for name in dict.fromkeys(old.table.header):
        if after[name] < before[name]:
            out.append(Finding("column-removed", "error", f"{name!r} is gone.", name, {"from": before[name], "to": after[name]}))
    for name in dict.fromkeys(new.table.header):
        if after[name] > before[name]:
            out.append(Finding("column-added", "info", f"{name!r} is new.", name, {"from": before[name], "to": after[name]}))
    left, right = _occurrences(old.table.header), _occurrences(new.table.header)
    shared = set(left) & set(right)
    if [x for x in left if x in shared] != [x for x in right if x in shared]:
        out.append(Finding("column-order-changed", "warning", "Columns that both have stand in another order."))
    at = {x: k for k, x in enumerate(right)}
    for k, x in enumerate(left):
        if x in shared:
            out += _column(old, k, new, at[x], config)
    if abs(new.n_rows - old.n_rows) / old.n_rows >= ROW_SHIFT:
        out.append(Finding("row-count-shift", "warning", f"{old.n_rows} rows became {new.n_rows}.", None, {"from": old.n_rows, "to": new.n_rows}))
    found = redact(out, sensitive_columns(old, config) | sensitive_columns(new, config))
    return [f for f in found if not config.silenced(f.code, f.column)]


def _column(old: Profiled, i: int, new: Profiled, j: int, config: Config) -> list[Finding]:
    a, b, out = old.columns[i], new.columns[j], []
    at = {"column_index": j}
    if a.kind != b.kind and "empty" not in (a.kind, b.kind):
        out.append(Finding("type-changed", "error", f"{b.name!r} was {a.kind} and is {b.kind}.", b.name, at | {"from": a.kind, "to": b.kind}))
    if b.null_rate - a.null_rate >= NULL_JUMP:
        out.append(Finding("null-rate-jump", "warning", f"{b.name!r} lacks more values than before.", b.name, at | {"from": round(a.null_rate, 4), "to": round(b.null_rate, 4)}))
    role = config.policy(a.name, a.key).role
    named = role != "measure" if role is not None else names_identifier(a.name) or plain_name(a.name) in _POSTAL
    if a.kind == b.kind == "numeric" and not named and a.median and b.median is not None and abs(b.median - a.median) / abs(a.median) >= MEDIAN_SHIFT:
        out.append(Finding("distribution-shift", "warning", f"The median of {b.name!r} moved from {a.median:g} to {b.median:g}.", b.name, at | {"from": a.median, "to": b.median}))
    if a.kind == b.kind == "categorical":
        for code, severity, p, q, x, y in (("new-category", "warning", new, old, j, i), ("missing-category", "info", old, new, i, j)):
            gone = categories(p, x).join(categories(q, y), "value", "left_anti")
            n = gone.count()
            if n:
                out.append(Finding(code, severity, f"{b.name!r}: {n} categories on one side only.", b.name, at | {"count": n}, [r["value"] for r in gone.orderBy("value").limit(max(1, config.max_examples)).collect()]))
    return out


def categories(done: Profiled, i: int):
    return done.words.where((F.col("col") == i) & ~F.col("null_token")).select("value")
