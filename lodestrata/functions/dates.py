"""Dates written as text: every reading of a value, in a fixed order of formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, py_strip

_D, _Y, _TIME = "[0-9]{1,2}", "[0-9]{4}", "[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}"
_MONTH = "[A-Za-z]{3,}"
# Fixed values: (pattern, order of its parts, shape of the text), in the order in which readings count.
FORMATS = (
    ("yyyy-M-d", "ymd", f"{_Y}-{_D}-{_D}"),
    ("yyyy/M/d", "ymd", f"{_Y}/{_D}/{_D}"),
    ("yyyy-M-d'T'H:m:s", "ymd", f"{_Y}-{_D}-{_D}T{_TIME}"),
    ("yyyy-M-d'T'H:m:s'Z'", "ymd", f"{_Y}-{_D}-{_D}T{_TIME}Z"),
    ("yyyy-M-d H:m:s", "ymd", f"{_Y}-{_D}-{_D} {_TIME}"),
    ("yyyyMMdd", "ymd", "[0-9]{8}"),
    ("d/M/yyyy", "dmy", f"{_D}/{_D}/{_Y}"),
    ("M/d/yyyy", "mdy", f"{_D}/{_D}/{_Y}"),
    ("d-M-yyyy", "dmy", f"{_D}-{_D}-{_Y}"),
    ("M-d-yyyy", "mdy", f"{_D}-{_D}-{_Y}"),
    ("d.M.yyyy", "dmy", f"{_D}\\.{_D}\\.{_Y}"),
    ("d/M/yy", "dmy", f"{_D}/{_D}/[0-9]{{2}}"),
    ("M/d/yy", "mdy", f"{_D}/{_D}/[0-9]{{2}}"),
    ("d MMM yyyy", "dmy", f"{_D} {_MONTH} {_Y}"),
    ("d-MMM-yyyy", "dmy", f"{_D}-{_MONTH}-{_Y}"),
    ("MMM d, yyyy", "mdy", f"{_MONTH} {_D}, {_Y}"),
    ("MMMM d, yyyy", "mdy", f"{_MONTH} {_D}, {_Y}"),
    ("MMM d yyyy", "mdy", f"{_MONTH} {_D} {_Y}"),
    ("MMMM d yyyy", "mdy", f"{_MONTH} {_D} {_Y}"),
    ("d MMMM yyyy", "dmy", f"{_D} {_MONTH} {_Y}"),
)


def _outline(pattern: str) -> str:
    """What is left of a text in this format when runs of digits are 9 and runs of letters are a."""
    return re.sub("MMMM?|'.'", "a", pattern.replace("yyyyMMdd", "9")).translate(str.maketrans("yMdHms", "999999")).replace("9999", "9").replace("99", "9")


def could_be_date(v: Column) -> Column:
    """A cheap gate before any format is tried."""
    return bound(py_strip(v), _could)


def _could(text: Column) -> Column:
    return F.length(text).between(6, 30) & F.when(text.rlike("\\A[0-9]+\\z"), F.length(text) == 8).otherwise(text.rlike("[0-9]") & text.rlike("[/\\-., ]"))


def _reading(text: Column, outline: Column, pattern: str, order: str, shape: str) -> Column:
    """The reading of one format, or NULL; only a text of the format's outline is parsed."""

    def checked(ts: Column) -> Column:
        if pattern.endswith("/yy"):
            ts = F.when(F.year(ts) >= 2069, ts - F.expr("INTERVAL '100' YEAR")).otherwise(ts)
        return F.when(F.year(ts).between(1900, 2100) if pattern == "yyyyMMdd" else F.year(ts) >= 1, F.struct(ts.alias("ts"), F.lit(order).alias("ord")))

    parsed = bound(F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz"), checked)
    return F.when((outline == _outline(pattern)) & text.rlike(f"\\A{shape}\\z"), parsed)


def parse_dates(v: Column) -> Column:
    """ARRAY<STRUCT<ts TIMESTAMP_NTZ, ord STRING>>: every reading, in the order of FORMATS."""

    def read(text: Column) -> Column:
        outline = F.regexp_replace(F.regexp_replace(text, "[0-9]+", "9"), "[A-Za-z]+", "a")
        every = bound(outline, lambda o: F.array_compact(F.array(*[_reading(text, o, *f) for f in FORMATS])))
        return F.when(_could(text), every).otherwise(F.array().cast("array<struct<ts: timestamp_ntz, ord: string>>"))

    return F.when(v.isNotNull(), bound(py_strip(v), read)).otherwise(F.array().cast("array<struct<ts: timestamp_ntz, ord: string>>"))


def iso_date(readings: Column, order: str) -> Column:
    """The day of the reading in ``order``, or of the only order there is; NULL if neither settles it."""

    def chosen(every: Column) -> Column:
        own = F.filter(every, lambda r: r["ord"] == order)
        orders = F.array_distinct(F.transform(every, lambda r: r["ord"]))
        return F.when(F.size(own) > 0, F.get(own, 0)["ts"]).when(F.size(orders) == 1, F.get(every, 0)["ts"])

    return F.date_format(bound(readings, chosen), "yyyy-MM-dd")
