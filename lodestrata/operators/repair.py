"""Repairs that lose nothing silently: every change recorded, the rest refused.

A rule maps a value to a value. It sees what the rules before it made of the value and the profile of the
original column, and applies to a whole column or not at all. So rules run over the dictionary, once a distinct value
of all columns, and what an analysis of one column needs is there with its counts. Rows are looked at only where rows
are asked for: then a column's changed values, where they are few, are sent to every task, and where they are nearly
as many as rows the rules run along them, since a shuffle of whole rows would cost more than it saves.
"""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as X
from ..sources.tables import pinned
from .checks import sensitive_columns
from .config import Config
from .profile import ColumnProfile, Profiled
from .rows import repeated_rows

RANK = {"high": 2, "medium": 1}
STEP = "array<struct<rule: string, confidence: string, before: string, after: string>>"


@dataclasses.dataclass
class Refusal:
    column: str
    rule: str
    reason: str


#: Changed values of a column that are sent to every task.
FEW_CHANGED = 200_000
#: (rule, confidence) of a column, in order.
Rules = list[tuple[str, str]]


@dataclasses.dataclass
class Repair:
    """The repair of a table by its dictionary; ``rows`` and what follows from it are made when first asked for."""

    done: Profiled
    rules: dict[int, Rules]
    refusals: list[Refusal]
    private: set[str]
    drop_duplicates: bool = False

    @functools.cached_property
    def values(self) -> DataFrame:
        """col, value, n, the repaired value ``fixed`` and the ``steps`` taken, of every distinct value.

        Kept until ``close``: a filter on what rules made would else run along them once for each rule that it sees.
        """
        words = self.done.words.select("col", "value", "n", "first_row")
        return _repaired(words, self.rules, self.done.columns).drop("first_row").persist()

    def values_of(self, i: int) -> DataFrame:
        own = {i: self.rules.get(i, [])}
        return _repaired(self.done.words.where(F.col("col") == i).select("col", "value", "n", "first_row"), own, self.done.columns)

    @functools.cached_property
    def changed(self) -> DataFrame:
        """The dictionary's changed values."""
        return self.values.where(F.size("steps") > 0)

    @functools.cached_property
    def source(self) -> DataFrame:
        """The table's rows, with numbers that stay the same when they are read again."""
        return pinned(self.done.table).df

    @functools.cached_property
    def every_row(self) -> DataFrame:
        """row_no, the raw cells c0 ... cN, the repaired cells r0 ... rN and the steps s0 ... sN, duplicates too."""
        df = self.source
        counts = {r["col"]: r["count"] for r in self.changed.groupBy("col").count().collect()} if any(self.rules.values()) else {}
        for p in self.done.columns:
            source, to, steps = f"c{p.index}", f"r{p.index}", f"s{p.index}"
            n = counts.get(p.index, 0)
            if not n:
                df = df.withColumns({to: F.col(source), steps: F.array().cast(STEP)})
            elif n <= FEW_CHANGED:
                own = self.changed.where(F.col("col") == p.index).select(F.col("value").alias(source), F.col("fixed").alias(to), F.col("steps").alias(steps))
                df = df.join(F.broadcast(own), source, "left").withColumns({to: F.coalesce(to, source), steps: F.coalesce(steps, F.array().cast(STEP))})
            else:
                df = self._along(df, p, source, to, steps)
        return df

    def _along(self, df: DataFrame, p: ColumnProfile, source: str, to: str, steps: str) -> DataFrame:
        rules, labels = self.rules[p.index], None
        if any(rule == LABELS for rule, _ in rules):
            own = self.done.words.where(F.col("col") == p.index).select("col", "value", "n", "first_row")
            labels = _labels(_until_labels(own, {p.index: rules}, self.done.columns))
        made = _steps(df.withColumns({"__col": F.lit(p.index), "__v": F.col(source), "__steps": F.array().cast(STEP)}), {p.index: rules}, self.done.columns, labels, "__col", "__v", "__steps")
        return made.withColumnsRenamed({"__v": to, "__steps": steps}).drop("__col")

    @functools.cached_property
    def repeats(self) -> DataFrame:
        """row_no and kept_row of rows that repeat an earlier one once repaired."""
        return repeated_rows(self.every_row, [f"r{p.index}" for p in self.done.columns])

    @property
    def rows(self) -> DataFrame:
        """``every_row`` without the duplicates that are dropped."""
        return self.every_row.join(self.repeats.select("row_no"), "row_no", "left_anti") if self.drop_duplicates else self.every_row

    @property
    def dropped(self) -> DataFrame | None:
        """row_no, kept_row, cells and matched_after_normalization of the dropped duplicates."""
        if not self.drop_duplicates:
            return None
        raw = F.struct(*[F.col(f"c{p.index}") for p in self.done.columns])
        cells = self.source.select("row_no", raw.alias("raw"))
        kept = cells.select(F.col("row_no").alias("kept_row"), F.col("raw").alias("kept"))
        gone = cells.join(self.repeats, "row_no").join(kept, "kept_row")
        return gone.select("row_no", "kept_row", F.to_json("raw").alias("cells"), (F.col("raw") != F.col("kept")).alias("matched_after_normalization"))

    @property
    def table(self) -> DataFrame:
        """row_no and the repaired cells as c0 ... cN."""
        return self.rows.select("row_no", *[F.col(f"r{i}").alias(f"c{i}") for i in range(len(self.done.columns))])

    @property
    def changes(self) -> DataFrame:
        """row_no, column_index, column, rule, confidence, before, after of every step taken."""
        every = F.array(*[F.struct(F.lit(p.index).alias("column_index"), F.lit(p.name).alias("column"), F.col(f"s{p.index}").alias("steps")) for p in self.done.columns])
        return self.rows.select("row_no", F.explode(every).alias("x")).select("row_no", "x.column_index", "x.column", F.explode("x.steps").alias("s")).select("row_no", "column_index", "column", "s.*")

    def close(self) -> None:
        if "values" in self.__dict__:
            self.values.unpersist()

    def counts(self) -> DataFrame:
        """column_index, column, rule, confidence and n, the cells that a step changes; by the dictionary unless rows are dropped."""
        keys = ["column_index", "column", "rule", "confidence"]
        if self.drop_duplicates:
            return self.changes.groupBy(*keys).agg(F.count("*").alias("n"))
        names = F.array(*[F.lit(p.name) for p in self.done.columns])
        steps = self.changed.select(F.col("col").alias("column_index"), F.get(names, F.col("col")).alias("column"), "n", F.explode("steps").alias("s"))
        return steps.groupBy("column_index", "column", F.col("s.rule").alias("rule"), F.col("s.confidence").alias("confidence")).agg(F.sum("n").alias("n"))


def _trim(v: Column) -> Column:
    return X.py_strip(F.translate(v, " ", " "))


def _blank_null(v: Column) -> Column:
    return F.when(X.is_disguised_null(v), "").otherwise(v)


def _number(v: Column, p: ColumnProfile) -> Column:
    return F.when(X.is_blank(v), v).otherwise(F.coalesce(N.plain_number(v, p.convention), v))


def _date(v: Column, p: ColumnProfile) -> Column:
    return F.when(X.is_blank(v), v).otherwise(F.coalesce(D.iso_date(D.parse_dates(v), p.date_reading.value), v))


def sentinel_targets(p: ColumnProfile) -> list[float]:
    if p.kind != "numeric" or not p.n_numbers:
        return []
    return [s for k, s in enumerate(X.NUMERIC_SENTINELS) if p.facts[f"{p.convention}_sentinel_{k}"] >= max(2, 0.01 * p.n_numbers)]


def _sentinel(v: Column, targets: list[float]) -> Column:
    return F.when(F.coalesce(N.parse_number(v)["value"].isin(*targets), F.lit(False)), "").otherwise(v)


LABELS = "canonical-label"


def _labels(words: DataFrame) -> DataFrame:
    """(col, value, best) of spellings whose label has a better one, from (col, value, n, first_row)."""
    parts = F.filter(F.split(X.collapse_spaces(F.col("value")), " "), lambda w: w.rlike("\\A\\p{L}"))
    upper = F.size(F.filter(parts, lambda w: w.rlike("\\A\\p{Lu}")))
    own = words.where(~X.is_blank(F.col("value"))).groupBy("col", "value").agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"))
    rated = own.withColumns({"label": X.normalize_label(F.col("value")), "share": F.when(F.size(parts) > 0, upper / F.size(parts)).otherwise(0.0)})
    best = rated.groupBy("col", "label").agg(F.min_by("value", F.struct(-F.col("share"), -F.col("n"), F.length("value"), "first_row")).alias("best"))
    return rated.join(best, ["col", "label"]).where(F.col("value") != F.col("best")).select("col", "value", "best")


def _step(rule: str, columns: list[ColumnProfile], v: Column) -> Column:
    """What a rule makes of a value, whichever of these columns it stands in."""
    if rule == "trim-whitespace":
        return _trim(v)
    if rule == "collapse-spaces":
        return X.collapse_spaces(v)
    if rule == "blank-null":
        return _blank_null(v)
    out, groups = v, {}
    for p in columns:
        kind = p.convention if rule == "plain-number" else p.date_reading.value if rule == "iso-date" else tuple(sentinel_targets(p))
        groups.setdefault(kind, []).append(p)
    for kind, own in groups.items():
        made = _number(v, own[0]) if rule == "plain-number" else _date(v, own[0]) if rule == "iso-date" else _sentinel(v, list(kind))
        out = F.when(F.col("__col").isin(*[p.index for p in own]), made).otherwise(out) if len(groups) > 1 else made
    return out


ORDER = ("trim-whitespace", "collapse-spaces", "blank-null", "plain-number", "iso-date", LABELS, "sentinel-null")


def _steps(df: DataFrame, rules: dict[int, Rules], profiles: list[ColumnProfile], labels: DataFrame | None, col: str, v: str, steps: str, until: str | None = None) -> DataFrame:
    """``df`` with the rules applied to its values ``v``, in order, and the steps that changed one added to ``steps``."""
    used = {i: dict(own) for i, own in rules.items()}
    for rule in ORDER:
        if rule == until:
            break
        own = {i: r[rule] for i, r in used.items() if rule in r}
        if not own:
            continue
        here = F.col(col).isin(*own) if len(own) < len(rules) else F.lit(True)
        if rule == LABELS:
            better = labels.select(F.col("col").alias("__lc"), F.col("value").alias("__lv"), "best")
            df = df.join(better, (F.col(col) == F.col("__lc")) & (F.col(v) == F.col("__lv")), "left").withColumn("__after", F.coalesce("best", v)).drop("__lc", "__lv", "best")
        else:
            made = _step(rule, [profiles[i] for i in own], F.col(v))
            df = df.withColumn("__after", F.when(here, made).otherwise(F.col(v)) if len(own) < len(rules) else made)
        high = [i for i, c in own.items() if c == "high"]
        confidence = F.lit("high") if len(high) == len(own) else F.lit("medium") if not high else F.when(F.col(col).isin(*high), "high").otherwise("medium")
        step = F.struct(F.lit(rule).alias("rule"), confidence.alias("confidence"), F.col(v).alias("before"), F.col("__after").alias("after"))
        df = df.withColumn(steps, F.when(F.col(v) != F.col("__after"), F.array_append(steps, step)).otherwise(F.col(steps))).drop(v).withColumnRenamed("__after", v)
    return df


def _until_labels(words: DataFrame, rules: dict[int, Rules], profiles: list[ColumnProfile]) -> DataFrame:
    """The dictionary of columns whose labels are to be made one, as the rules before leave it."""
    own = {i: r for i, r in rules.items() if any(rule == LABELS for rule, _ in r)}
    rows = words.where(F.col("col").isin(*own)).withColumns({"__col": F.col("col"), "__steps": F.array().cast(STEP)})
    return _steps(rows, own, profiles, None, "__col", "value", "__steps", LABELS).select("col", "value", "n", "first_row")


def _repaired(words: DataFrame, rules: dict[int, Rules], profiles: list[ColumnProfile]) -> DataFrame:
    active = {i: r for i, r in rules.items() if r}
    rows = words.withColumns({"__col": F.col("col"), "fixed": F.col("value"), "steps": F.array().cast(STEP)})
    if not active:
        return rows.drop("__col")
    labels = _labels(_until_labels(words, active, profiles)) if any(rule == LABELS for r in active.values() for rule, _ in r) else None
    idle = rows.where(~F.col("col").isin(*active)).drop("__col")
    made = _steps(rows.where(F.col("col").isin(*active)), active, profiles, labels, "__col", "fixed", "steps")
    return made.drop("__col").unionByName(idle)


def _rules(p: ColumnProfile) -> tuple[Rules, list[Refusal]]:
    """(rule, confidence) of a column, in order, and what is refused."""
    rules: Rules = [("trim-whitespace", "high"), ("collapse-spaces", "medium"), ("blank-null", "high")]
    refused = []
    if p.kind == "numeric":
        r = p.number_reading
        if not r.usable:
            refused.append(Refusal(p.name, "plain-number", f"the number convention is {r.label}"))
        elif p.number_flags or p.convention != "en":
            if "percent" in p.number_flags:
                refused.append(Refusal(p.name, "plain-number", "whether 12% is 12 or 0.12 is for the reader to say"))
            else:
                rules.append(("plain-number", "high"))
    if p.kind == "date":
        r = p.date_reading
        if not r.usable:
            refused.append(Refusal(p.name, "iso-date", f"the date order is {r.label}"))
        elif r.value != "ymd" or p.facts["dev_either"]:
            rules.append(("iso-date", "high" if r.label == "certain" else "medium"))
    if p.kind in ("categorical", "text"):
        rules.append((LABELS, "medium"))
    if sentinel_targets(p):
        rules.append(("sentinel-null", "medium"))
    return rules, refused


def _unfixable(p: ColumnProfile) -> list[Refusal]:
    out = []
    if p.mojibake:
        out.append(Refusal(p.name, "mojibake", "the bytes that were lost cannot be guessed; export again as UTF-8"))
    if p.offending and p.kind in ("numeric", "date", "mixed"):
        out.append(Refusal(p.name, "mixed-types", f"values that are no {p.dominant_kind} may be typos, notes or another unit"))
    return out


#: What each rule does, for a reader.
EXPLAINED = {
    "trim-whitespace": "cuts blanks at both ends; nothing between them changes",
    "collapse-spaces": "makes several blanks in a row one; names that differ in spacing alone become equal",
    "blank-null": "empties cells that say in words that there is no value",
    "plain-number": "writes numbers without currency signs, grouping or brackets, with a point; only where the convention is proven",
    "iso-date": "writes days as year-month-day; only where the order of day and month is proven",
    "canonical-label": "writes labels that differ in case or spacing in the best capitalised, most frequent spelling",
    "sentinel-null": "empties numbers that stand for no value, such as -999",
    "drop-duplicates": "keeps the first of rows that are equal once repaired",
}


def hazards(repair: Repair) -> list[str]:
    """Why the repaired table should not be written: cells that only the repair made formulas, or a name that is one."""
    out = []
    made = N.is_formula_like(F.col("fixed")) & ~N.is_formula_like(F.col("value"))
    if any(repair.rules.values()) and not repair.changed.where(made).isEmpty():
        out.append("introduced-formula")
    names = repair.done.table.header
    spark = repair.done.table.df.sparkSession
    if any(n.strip()[:1] in tuple("=+-@") for n in names) and not spark.createDataFrame([(n,) for n in names], "v string").where(N.is_formula_like(F.col("v"))).isEmpty():
        out.append("header-hazard")
    return out


def plan(done: Profiled, config: Config | None = None, min_confidence: str = "high", drop_duplicates: bool = False) -> Repair:
    """The repair of a table: which rules each column gets, and what is refused."""
    config = config or Config()
    floor = RANK[min_confidence]
    private = sensitive_columns(done, config)
    refusals: dict[int, list[Refusal]] = {}
    rules: dict[int, Rules] = {}
    spared: dict[int, Rules] = {}
    for p in done.columns:
        own, refused = _rules(p)
        own = [r for r in own if RANK[r[1]] >= floor]
        refusals[p.index] = _unfixable(p)
        if p.formula:
            refusals[p.index].append(Refusal(p.name, "formula-injection", "a value would run as a formula, and rewriting it could make that easier"))
        elif p.name in private or config.policy(p.name, p.key).role == "identifier":
            spared[p.index] = own
        else:
            rules[p.index] = own
            refusals[p.index] += refused
    if any(spared.values()):  # untouched; what would have changed is only looked for, in the dictionary
        would = _repaired(done.words.where(F.col("col").isin(*spared)).select("col", "value", "n", "first_row"), spared, done.columns)
        for r in would.groupBy("col").agg(F.max(F.col("fixed") != F.col("value")).alias("changes")).where("changes").collect():
            refusals[r["col"]].append(Refusal(done.columns[r["col"]].name, "sensitive-value-preserved", "values of sensitive and identifier columns stay as they are"))
    return Repair(done, rules, [x for own in refusals.values() for x in own], private, drop_duplicates)
