"""The library's entry points: lint, diff, profile, fix and impact on files."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

from .operators import checks, drift, repair
from .operators import profile as profiling
from .operators.config import Config
from .operators.findings import Finding
from .operators.references import Reference, check_reference
from .sources.tables import TextTable, read_any


def session() -> SparkSession:
    """The active session, or a local one."""
    found = SparkSession.getActiveSession()
    if found:
        return found
    made = SparkSession.builder.appName("lodestrata").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    return made


def open_table(path: str, **how) -> TextTable:
    return read_any(session(), path, **how)


def lint(path: str, config: Config | None = None, references: list[str] = (), now: datetime.datetime | None = None, **how) -> list[Finding]:
    """Findings of one file; ``references`` are FILE:LOCAL=FOREIGN."""
    config = config or Config()
    table = open_table(path, **how)
    done = profiling.profile(table, now)
    try:
        found = checks.run_checks(done, config)
        cache: dict[str, TextTable] = {}

        def load(other: str) -> TextTable:
            return cache.setdefault(other, open_table(other))

        more = [f for spec in references for f in check_reference(table, Reference.parse(spec), config, load)]
        if more:
            more = [f for f in checks.redact(more, checks.sensitive_columns(done, config)) if not config.silenced(f.code, f.column)]
        return found + more
    finally:
        done.close()


def diff(baseline: str, current: str, config: Config | None = None, now: datetime.datetime | None = None, **how) -> list[Finding]:
    """What changed from one file to another."""
    old, new = (profiling.profile(open_table(p, **how), now) for p in (baseline, current))
    try:
        return drift.compare(old, new, config)
    finally:
        old.close()
        new.close()


def profile(path: str, now: datetime.datetime | None = None, **how) -> DataFrame:
    """One row a column."""
    return profiling.profile_frame(profiling.profile(open_table(path, **how), now))


def fix(path: str, config: Config | None = None, min_confidence: str = "high", drop_duplicates: bool = False, now: datetime.datetime | None = None, **how) -> repair.Repair:
    """The repair of a file: its rows, its audit and what it refuses."""
    return repair.plan(profiling.profile(open_table(path, **how), now), config, min_confidence, drop_duplicates)
