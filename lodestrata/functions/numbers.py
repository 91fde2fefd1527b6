"""Numbers written as text: two conventions, their evidence, and plain rewrites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, bound, py_strip

#: convention -> (thousands separator, decimal mark)
CONVENTIONS = {"en": (",", "."), "eu": (".", ",")}
FLAGS = ("thousands", "currency", "percent", "parens")
CURRENCY = "$€£¥"


def _pattern(convention: str) -> str:
    thousands, decimal = (f"\\{x}" for x in CONVENTIONS[convention])
    # grouped digits never start with a zero, so 0.247 is not a grouped number
    body = f"[1-9][0-9]{{0,2}}(?:{thousands}[0-9]{{3}})+(?:{decimal}[0-9]+)?|[0-9]+(?:{decimal}[0-9]+)?|{decimal}[0-9]+"
    gap = f"[{WS}]*"
    return f"\\A(\\()?{gap}([+\\-])?{gap}([{CURRENCY}])?{gap}({body}){gap}(%)?{gap}([{CURRENCY}])?(\\))?\\z"


def parse_number(v: Column, convention: str = "en") -> Column:
    """STRUCT<value, thousands, currency, percent, parens>, or NULL where the text is no number."""
    thousands, decimal = CONVENTIONS[convention]
    pattern = _pattern(convention)
    # the groups of one match, told apart by a sign that no number has
    parts = lambda text: F.split(F.regexp_replace(text, pattern, "\x01".join(f"${k}" for k in range(1, 8))), "\x01")

    def read(g: Column) -> Column:
        digits = F.get(g, 3)
        value = F.replace(F.replace(digits, F.lit(thousands), F.lit("")), F.lit(decimal), F.lit(".")).try_cast("double")
        parens = F.get(g, 0) == "("

        def signed(x: Column) -> Column:
            own = F.when(parens, -F.abs(x)).when(F.get(g, 1) == "-", -x).otherwise(x)
            flags = (digits.contains(thousands).alias("thousands"), ((F.get(g, 2) != "") | (F.get(g, 5) != "")).alias("currency"), (F.get(g, 4) == "%").alias("percent"), parens.alias("parens"))
            return F.when((parens == (F.get(g, 6) == ")")) & x.isNotNull() & (F.abs(x) < float("inf")), F.struct(own.alias("value"), *flags))

        return bound(value, signed)

    return bound(py_strip(v), lambda text: F.when(text.rlike(pattern), bound(parts(text), read)))


def evidence(en: Column, eu: Column) -> Column:
    """What one value says about the column's convention, from its two readings."""
    return (
        F.when(en.isNull() & eu.isNull(), F.lit(None).cast("string"))
        .when(eu.isNull(), "en")
        .when(en.isNull(), "eu")
        .when(en["value"] == eu["value"], "neutral")
        .when(en["thousands"] & ~eu["thousands"], "group-en")
        .when(eu["thousands"] & ~en["thousands"], "group-eu")
        .otherwise("ambiguous")
    )


def plain_number(v: Column, convention: str = "en") -> Column:
    """The number without presentation, edited as text; NULL if it is none, or is plain already."""
    thousands, decimal = CONVENTIONS[convention]

    def edited(text: Column) -> Column:
        body = py_strip(F.translate(F.regexp_replace(text, "\\A[()]+|[()]+\\z", ""), CURRENCY + " " + thousands, ""))
        if decimal != ".":
            body = F.replace(body, F.lit(decimal), F.lit("."))
        return F.when(text.startswith("(") & text.endswith(")"), F.concat(F.lit("-"), F.regexp_replace(body, "\\A[+\\-]+", ""))).otherwise(body)

    def kept(value: Column) -> Column:
        # an edit that would change the number is none
        return bound(bound(py_strip(v), edited), lambda body: F.when((strict_double(body) == value) & (body != v), body))

    return bound(parse_number(v, convention)["value"], lambda value: F.when(value.isNotNull(), kept(value)))


def strict_double(v: Column) -> Column:
    """A double where a strict reader takes the text for one; the cast alone takes 1d and 1f too."""
    return bound(py_strip(v), _strict)


def _strict(text: Column) -> Column:
    return F.when(text.rlike("\\A[+\\-]?(?:[0-9]+(?:_[0-9]+)*\\.?(?:[0-9]+(?:_[0-9]+)*)?|\\.[0-9]+(?:_[0-9]+)*)(?:[eE][+\\-]?[0-9]+)?\\z"), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def is_formula_like(v: Column) -> Column:
    """Text that a spreadsheet would run: =, @, or a + or - that no number explains."""
    text = F.regexp_replace(v, f"\\A[{WS}]+", "")
    first = F.substring(text, 1, 1)
    number = parse_number(text, "en").isNotNull() | parse_number(text, "eu").isNotNull()
    return first.isin("=", "@") | (first.isin("+", "-") & ~number)
