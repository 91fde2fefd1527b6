"""What ranges of a delimited file do to a reader, so that ranges can be read apart and put together.

A range ends where a line ends. Whatever came before it, a reader enters it either outside quotes or inside, so a
range is an effect on these two: the state it leaves, the records it ends, and the first fault that it meets. Effects
compose, and so do summaries of bytes, which may be cut anywhere. A prefix over a file's ranges then gives each the
state that it is truly entered in and the number of its first record, and every range is parsed on its own.

Within a range nothing is done a character at a time: quotes alternate until the first fault, so the number of quotes
before a byte says whether it is quoted, and fields are cut by masks over the bytes.
"""

from __future__ import annotations

import codecs
import dataclasses
import functools

import numpy as np
import pyarrow as pa

QUOTE, CR, LF = 34, 13, 10
INSIDE, AFTER = "a quote stands inside an unquoted field", "text follows a closing quote"
NEVER = "a quoted field never ends"
_SKIPS = range(4)


def _utf8(content: bytes) -> tuple:
    """(where the bytes are first no UTF-8, what is begun of a character at their end)."""
    try:
        return None, content[codecs.utf_8_decode(content, "strict", False)[1] :]
    except UnicodeDecodeError as error:
        return error.start, b""


@dataclasses.dataclass(frozen=True)
class Bytes:
    """Size, NULs and line ends of some bytes, and where they are no UTF-8.

    ``invalid`` and ``tails`` have an entry for each number of bytes at the start that belong to a character begun
    before: where the rest is first invalid, or else what is left of a character at its end.
    """

    size: int = 0
    nuls: int = 0
    crlf: int = 0
    lf: int = 0
    head: bytes = b""
    last: bytes = b""
    invalid: tuple = (None,) * 4
    tails: tuple = (b"",) * 4

    @classmethod
    def of(cls, content: bytes) -> Bytes:
        found = [_utf8(content)]
        for k in _SKIPS[1:]:
            if found[0][0] is not None:
                bad, tail = _utf8(content[k:])
                found.append((None if bad is None else k + bad, tail))
            else:  # the bytes are whole characters, so they are still whole from the start of one
                inside = content[k : k + 1] and 0x80 <= content[k] < 0xC0
                found.append((k, b"") if inside else (None, found[0][1] if k < len(content) else b""))
        invalid, tails = zip(*found, strict=True)
        return cls(len(content), content.count(b"\0"), content.count(b"\r\n"), content.count(b"\n"), content[:4], content[-1:], invalid, tails)

    def then(self, other: Bytes) -> Bytes:
        if not self.size or not other.size:
            return other if not self.size else self
        both = [self._joined(other, k) for k in _SKIPS]
        crlf = self.crlf + other.crlf + (self.last == b"\r" and other.head[:1] == b"\n")
        return Bytes(self.size + other.size, self.nuls + other.nuls, crlf, self.lf + other.lf, (self.head + other.head)[:4], other.last, tuple(b for b, _ in both), tuple(t for _, t in both))

    def _joined(self, other: Bytes, skip: int) -> tuple:
        at = None
        if skip >= self.size:
            at, tail = skip - self.size, b""
        elif self.invalid[skip] is not None:
            return self.invalid[skip], b""
        else:
            tail = self.tails[skip]
            need = (2 if tail[0] < 0xE0 else 3 if tail[0] < 0xF0 else 4) - len(tail) if tail else 0
            bad, rest = _utf8(tail + other.head[:need])
            if bad is not None:
                return self.size - len(tail), b""
            if rest:
                return None, rest
            at = need
        bad = other.invalid[at]
        return (None, other.tails[at]) if bad is None else (self.size + bad, b"")

    @property
    def invalid_at(self) -> int | None:
        """The first byte that is no UTF-8, these bytes being a whole file."""
        if self.invalid[0] is None and self.tails[0]:
            return self.size - len(self.tails[0])
        return self.invalid[0]


@dataclasses.dataclass(frozen=True)
class Effect:
    """What whole lines do to a reader that is outside quotes (entry 0) or inside (entry 1)."""

    lines: int = 0
    #: Whether the state is turned.
    turns: int = 0
    #: (line, what) of the first fault; lines count from 0.
    fault: tuple = (None, None)
    #: Line of the last quote that opened a field.
    opened: tuple = (None, None)
    #: Records with a cell that end here, and whether any end, of a blank line too, is here.
    records: tuple = (0, 0)
    ends: tuple = (False, False)

    @classmethod
    def of(cls, raw: np.ndarray, sep: bytes) -> Effect:
        marks = Marks(raw, sep)
        faults, opened, records, ends = zip(*[marks.effect(e) for e in (0, 1)], strict=True)
        return cls(len(marks.lf), len(marks.quotes) & 1, faults, opened, records, ends)

    def then(self, other: Effect) -> Effect:
        out: dict = {"fault": [], "opened": [], "records": [], "ends": []}
        for e in (0, 1):
            to = e ^ self.turns
            fault, opened = other.fault[to], other.opened[to]
            out["fault"].append(self.fault[e] or fault and (fault[0] + self.lines, fault[1]))
            out["opened"].append(self.opened[e] if opened is None else opened + self.lines)
            out["records"].append(self.records[e] + other.records[to])
            out["ends"].append(self.ends[e] or other.ends[to])
        return Effect(self.lines + other.lines, self.turns ^ other.turns, *map(tuple, out.values()))

    def message(self) -> str | None:
        """Why these lines, being a whole file, cannot be read without guessing."""
        if self.fault[0]:
            return f"line {self.fault[0][0] + 1}: {self.fault[0][1]}"
        return f"line {self.opened[0] + 1}: {NEVER}" if self.turns else None


def _at(raw: np.ndarray, sep: bytes) -> np.ndarray:
    """Where the separator begins."""
    if len(sep) == 1:
        return np.flatnonzero(raw == sep[0])
    hit = raw[: len(raw) - len(sep) + 1] == sep[0]
    for k in range(1, len(sep)):
        hit = hit & (raw[k : len(raw) - len(sep) + 1 + k] == sep[k])
    return np.flatnonzero(hit)


class Marks:
    """Quotes, separators and line ends of lines; what they mean depends on the state of entry."""

    def __init__(self, raw: np.ndarray, sep: bytes):
        self.raw, self.sep = raw, sep
        self.quotes = np.flatnonzero(raw == QUOTE)
        self.ends = np.flatnonzero((raw == LF) | (raw == CR))
        self.lf = self.ends[raw[self.ends] == LF]

    def _beside(self, at: np.ndarray, before: bool) -> tuple[np.ndarray, np.ndarray]:
        """(the neighbouring byte, whether a field may begin or end there); beyond the lines is a line end."""
        i = at - 1 if before else at + 1
        byte = np.where((i < 0) | (i >= len(self.raw)), LF, self.raw[np.clip(i, 0, len(self.raw) - 1)])
        fits = (byte == LF) | (byte == CR) | (byte == QUOTE)
        if len(self.sep) == 1:
            return byte, fits | (byte == self.sep[0])
        return byte, fits | np.isin(i - (len(self.sep) - 1 if before else 0), _at(self.raw, self.sep))

    @functools.cached_property
    def _around(self) -> tuple:
        return *self._beside(self.quotes, True), self._beside(self.quotes, False)[1]

    def effect(self, entry: int) -> tuple:
        """(first fault, line of the last opened field, records ended, whether one ended)."""
        before, begins, ends = self._around
        opening = (np.arange(len(self.quotes)) + entry) & 1 == 0
        wrong = np.flatnonzero(np.where(opening, ~begins, ~ends))
        fault = None
        if len(wrong):
            k = wrong[0]  # a closing quote's fault is the byte after it, which no other fault can precede
            fault = (int(np.searchsorted(self.lf, self.quotes[k])), INSIDE if opening[k] else AFTER)
        first = np.flatnonzero(opening & (before != QUOTE))
        opened = int(np.searchsorted(self.lf, self.quotes[first[-1]])) if len(first) else None
        ends, filled = self.outside(entry)
        return fault, opened, int(filled.sum()), bool(len(ends))

    def outside(self, entry: int) -> tuple[np.ndarray, np.ndarray]:
        """(ends of records, whether each ends one that has a cell)."""
        free = self.ends[(np.searchsorted(self.quotes, self.ends) + entry) & 1 == 0]
        before = self.raw[np.maximum(free - 1, 0)]
        return free, (free > 0) & (before != LF) & (before != CR)

    def fields(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(all cells of whole records, each record's first cell, its number of cells), from outside quotes."""
        ends, filled = self.outside(0)
        cuts = _at(self.raw, self.sep)
        cuts = cuts[np.searchsorted(self.quotes, cuts) & 1 == 0]
        keep = np.ones(len(self.raw), bool)
        keep[ends] = False
        for k in range(len(self.sep)):
            keep[cuts + k] = False
        opening = np.arange(len(self.quotes)) & 1 == 0
        keep[self.quotes[~opening | (self._around[0] != QUOTE)]] = False  # the second of two quotes stays
        filled = ends[filled]
        stops = np.sort(np.concatenate([cuts, filled]))
        offsets = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)[stops]]).astype(np.int32)
        last = np.searchsorted(stops, filled)
        first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
        cells = pa.StringArray.from_buffers(len(stops), pa.py_buffer(offsets), pa.py_buffer(self.raw[keep]))
        return cells, first.astype(np.int64), (last - first + 1).astype(np.int64)


def columns(cells: pa.Array, first: np.ndarray, count: np.ndarray, width: int) -> list[pa.Array]:
    """``width`` columns of the records' cells; short records have empty ones, and what is beyond is left out."""
    out = []
    for j in range(width):
        lacks = count <= j
        column = cells.take(pa.array(first + j, mask=lacks) if lacks.any() else pa.array(first + j))
        out.append(column.fill_null("") if lacks.any() else column)
    return out
