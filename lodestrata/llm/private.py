"""Personal data in texts: an Aho-Corasick automaton finds anchors, local parsers expand them to spans.

The automaton runs over the bytes of a text with A-Z lowered and finds at-signs, digits, a plus before a digit, scheme
separators and words that announce an identifier. From each anchor a parser walks left and right over the bytes that
its kind allows, once: what a parser has walked over is not walked again by that kind, so long runs cost their length.

Kinds, in the order of the result, each leftmost and without overlap:

* email, ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip, ``[0-9]+(\\.[0-9]+){3}`` with parts of at most 255
* card, ``[0-9]([\\x20-]?[0-9])+`` with 16 to 19 digits that pass Luhn
* phone, ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 8 to 15 digits
* spelled, an email with ``[at]`` or ``(at)`` for the sign, and dots or ``[dot]`` or ``(dot)`` in its domain
* login, a URL with user and password before its host
* iban, 15 to 34 letters and digits after the word, in groups or not, whose remainder by 97 is 1
* secret, the value after token, secret, password, passwd, api_key, api-key or apikey and ``=`` or ``:``: 16 or more of
  ``[A-Za-z0-9_/+.-]``, with a letter and a digit among them

What a pattern matches and its check refuses is dropped without another try, so spans are those of the patterns.
Offsets count code points. Null and empty texts have no spans, repeated rows have theirs each, and an empty table gives
no rows. The column ``findings`` replaces one so named; other columns stay.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import slices, utf8
from .workers import lean

KINDS = ("email", "ip", "card", "phone", "spelled", "login", "iban", "secret")
#: Kinds whose patterns are the contract's; the others are added.
BASE = KINDS[:4]
SECRET_WORDS = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey")
LEAST_SECRET = 16

_DIGIT = b"0123456789"
_ALNUM = _DIGIT + b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LABEL, _LOCAL, _SCHEME, _USER = _ALNUM + b"-", _ALNUM + b"._%+-", _ALNUM + b"+.-", _ALNUM + b"._~%-"
_PHONE, _VALUE = _DIGIT + b" ().-", _ALNUM + b"_/+.-"
_PASSWORD = bytes(c for c in range(33, 127) if c not in b"@/\"<>")


def _run(allowed: bytes) -> Callable[[bytes, int], int]:
    """The end of the run of allowed bytes that begins at a place."""
    match = re.compile(b"[" + re.escape(allowed) + b"]*").match
    return lambda text, at: match(text, at).end()


_digits, _labels, _phone, _value, _user, _password = map(_run, (_DIGIT, _LABEL, _PHONE, _VALUE, _USER, _PASSWORD))


def _back(text: bytes, at: int, least: int, allowed: bytes) -> int:
    """The start of the run of allowed bytes that ends before ``at``, not before ``least``."""
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def _domain(text: bytes, at: int) -> int:
    """The end of two or more labels joined by dots; 0 if there are none."""
    end, labels = _labels(text, at), 1
    if end == at:
        return 0
    while text[end : end + 1] == b"." and (to := _labels(text, end + 1)) > end + 1:
        end, labels = to, labels + 1
    return end if labels > 1 else 0


def luhn(digits: bytes) -> bool:
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(twice[c - 48] if k % 2 else c - 48 for k, c in enumerate(reversed(digits))) % 10 == 0


class Finder:
    """Spans of one text. ``done`` holds, by kind, where that kind may begin again."""

    def __init__(self, text: bytes):
        self.text, self.done, self.spans = text, dict.fromkeys(KINDS, 0), {k: [] for k in KINDS}

    def _took(self, kind: str, start: int, end: int, good: bool, shown: int | None = None) -> None:
        self.done[kind] = end
        if good:
            self.spans[kind].append((start if shown is None else shown, end))

    def email(self, first: int, end: int) -> None:
        start = _back(self.text, first, self.done["email"], _LOCAL)
        if start < first and (to := _domain(self.text, end)):
            self._took("email", start, to, True)

    def digit(self, first: int, end: int) -> None:
        if first >= self.done["ip"]:
            self._dotted(first)
        if first >= self.done["card"]:
            self._account(first)

    def _dotted(self, first: int) -> None:
        """Groups of digits joined by dots, four at a time."""
        text, groups, at = self.text, [], first
        while (to := _digits(text, at)) > at:
            groups.append((at, to))
            at = to + 1
            if text[to : to + 1] != b".":
                break
        self.done["ip"] = groups[-1][1]
        for k in range(0, len(groups) - 3, 4):
            parts = [text[a:b].lstrip(b"0") for a, b in groups[k : k + 4]]
            if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
                self.spans["ip"].append((groups[k][0], groups[k + 3][1]))

    def _account(self, first: int) -> None:
        """Digits with at most one blank or hyphen between two of them."""
        text, digits, end = self.text, 0, first
        at = first
        while (to := _digits(text, at)) > at:
            digits, end = digits + to - at, to
            at = to + (text[to : to + 1] in (b" ", b"-"))
            if at == to:
                break
        self._took("card", first, end, 16 <= digits <= 19 and luhn(text[first:end].replace(b" ", b"").replace(b"-", b"")))

    def phone(self, first: int, end: int) -> None:
        if first < self.done["phone"]:
            return
        to = _phone(self.text, end)
        while to > end + 1 and self.text[to - 1] not in _DIGIT:
            to -= 1
        if to > end + 1:
            digits = sum(c in _DIGIT for c in self.text[first:to])
            self._took("phone", first, to, 8 <= digits <= 15)

    def spelled(self, first: int, end: int) -> None:
        text, least = self.text, self.done["spelled"]
        gap = first > least and text[first - 1 : first] == b" "
        start = _back(text, first - gap, least, _LOCAL)
        at = end + (text[end : end + 1] == b" ")
        if start == first - gap or (to := _labels(text, at)) == at:
            return
        labels = 1
        while True:
            dot = _DOT.match(text, to)
            if not dot or (next_ := _labels(text, dot.end())) == dot.end():
                break
            to, labels = next_, labels + 1
        if labels > 1:
            self._took("spelled", start, to, True)

    def login(self, first: int, end: int) -> None:
        text = self.text
        start = _back(text, first, self.done["login"], _SCHEME)
        while start < first and text[start : start + 1] in b"0123456789+.-":
            start += 1
        if start == first or (colon := _user(text, end)) == end or text[colon : colon + 1] != b":":
            return
        sign = _password(text, colon + 1)
        if sign == colon + 1 or text[sign : sign + 1] != b"@" or (to := _labels(text, sign + 1)) == sign + 1:
            return
        while text[to : to + 1] == b"." and (next_ := _labels(text, to + 1)) > to + 1:
            to = next_
        self._took("login", start, to, True)

    def iban(self, first: int, end: int) -> None:
        if first < self.done["iban"] or not (found := _IBAN.match(self.text, end)):
            return
        whole, short = found.span(1), found.span(2)
        to = whole[1] if self._valid(*whole) else short[0] if short[0] > 0 and self._valid(whole[0], short[0]) else 0
        self.done["iban"] = whole[1]
        if to:
            self.spans["iban"].append((whole[0], to))

    def _valid(self, start: int, end: int) -> bool:
        own = self.text[start:end].replace(b" ", b"").decode()
        return 15 <= len(own) <= 34 and int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1

    def secret(self, first: int, end: int) -> None:
        if first < self.done["secret"] or not (found := _ASSIGNED.match(self.text, end)):
            return
        to = _value(self.text, found.end())
        if to - found.end() < LEAST_SECRET:
            return
        own = self.text[found.end() : to]
        self._took("secret", first, to, any(c in _DIGIT for c in own) and any(c in _ALNUM[10:] for c in own), found.end())


_DOT = re.compile(rb"\.|\x20?(?:\[dot\]|\(dot\))\x20?", re.IGNORECASE)
_IBAN = re.compile(rb"[\x20:#]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?)")
_ASSIGNED = re.compile(rb"[\"']?\x20{0,2}[=:]\x20{0,2}[\"']?")


@functools.lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """Every anchor with its parser and length."""
    found = {"@": Finder.email, "://": Finder.login, "iban": Finder.iban, "[at]": Finder.spelled, "(at)": Finder.spelled}
    found |= {f"+{k}": Finder.phone for k in range(10)} | {str(k): Finder.digit for k in range(10)} | dict.fromkeys(SECRET_WORDS, Finder.secret)
    automaton = ahocorasick.Automaton()
    for word, parser in found.items():
        automaton.add_word(word, (parser, len(word)))
    automaton.make_automaton()
    return automaton


def find_bytes(text: bytes) -> dict[str, list[tuple[int, int]]]:
    """Byte spans by kind of a UTF-8 text; one character of the scanned string is one byte."""
    finder = Finder(text)
    for last, (parser, length) in anchors().iter(text.lower().decode("latin-1")):
        parser(finder, last + 1 - length, last + 1)
    return finder.spans


def _points(raw: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans as spans of code points."""
    ends = np.unique(np.array(spans, np.int64).reshape(-1))
    begins = (raw & 0xC0) != 0x80
    counts, at, total = {}, 0, 0
    for e in ends.tolist():
        total, at = total + int(np.count_nonzero(begins[at:e])), e
        counts[e] = total
    return [(counts[a], counts[b]) for a, b in spans]


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text's findings, by kind, then start."""
    raw = text.encode("utf-8", "surrogatepass")
    found = [(k, *s) for k, spans in find_bytes(raw).items() for s in spans]
    return [(k, *s) for (k, _, _), s in zip(found, _points(np.frombuffer(raw, np.uint8), [x[1:] for x in found]), strict=True)]


_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(kept))
            for i, j in slices(at):
                data, out = raw[at[i] : at[j]].tobytes(), []
                for a, b in zip((at[i:j] - at[i]).tolist(), (at[i + 1 : j + 1] - at[i]).tolist(), strict=True):
                    found = [(k, *s) for k, spans in find_bytes(data[a:b]).items() for s in spans] if b > a else []
                    spots = _points(np.frombuffer(data, np.uint8, b - a, a), [x[1:] for x in found]) if found else []
                    out.append([{"kind": k, "start": s, "end": e} for (k, _, _), (s, e) in zip(found, spots, strict=True)])
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[:kept]], pa.array(out, _FINDINGS)], names=[str(k) for k in range(kept + 1)])

    return run


def find_private(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``findings``: array of (kind, start, end), by kind as listed, then start."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "findings")]
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`"))
    named = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInArrow(lean(_scan(len(kept))), f"{named}findings array<struct<kind: string, start: long, end: long>>")


def count(kind: str) -> Column:
    """Findings of one kind in a row of ``find_private``."""
    return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")


def joined(kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of a row's findings of these kinds, comma-joined."""
    own = F.filter("findings", lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: str, findings: list[tuple[str, int, int]], mask: str = "<{}>") -> str:
    """The text with each stretch of findings replaced by the mark of the kind that begins it."""
    out, at = [], 0
    for kind, start, end in sorted(findings, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], mask.format(kind.upper())]
        at = max(at, end)
    return "".join([*out, text[at:]])
