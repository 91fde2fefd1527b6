"""Fill-in-the-middle: texts cut at two code points and put in an order that shows the middle last.

The bytes of a stretch of texts give one bitvector, a one where a code point begins. Its ranks at a text's ends give
the text's length in code points, and select on two ranks gives the byte cuts, so no text is decoded. Cuts, form
and order come from the SHA-256 of a seed and the doc_id alone: a document has the same result wherever it is read.

A null text is empty and stays plain, as does a text that contains a marker. A null doc_id is hashed as no digits,
repeated rows give repeated results, and an empty table gives no rows. Columns that the result adds replace those of
the same name; other columns stay. Texts are valid UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buffers import slices, utf8
from .rankselect import Bits
from .scratch import apart
from .workers import lean

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, those that are cut; of 100 cut ones, those in which the suffix comes first.
CUT, SUFFIX_FIRST = 90, 20
_MARKER = re.compile(b"|".join(x.encode() for x in (PREFIX, SUFFIX, MIDDLE)))
_ADDED = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
_FORMS = np.array(["plain", "psm", "spm"], dtype=object)


def _draws(seed: int) -> list[Column]:
    """Four 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _order(raw: np.ndarray, at: np.ndarray, h: list[np.ndarray], cut: int, suffix_first: int) -> tuple[list, ...]:
    """(n, form, prefix code points, middle code points, output) of the texts between the offsets ``at``."""
    marks = Bits((raw & 0xC0) != 0x80)
    before = marks.rank(at)
    n, base = np.diff(before), before[:-1]
    x, y = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(x, y), np.maximum(x, y)
    ends = [np.where(k < n, marks.select(base + k), at[1:]) for k in (low, high)]
    form = np.where((n == 0) | (h[2] % 100 >= cut), 0, np.where(h[3] % 100 < suffix_first, 2, 1))
    data = raw.tobytes()
    for m in _MARKER.finditer(data):
        i = int(np.searchsorted(at, m.start(), "right")) - 1
        if m.end() <= at[i + 1]:  # else one text ends and the next begins like a marker
            form[i] = 0
    out = []
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for kind, a, b, c, d in zip(form.tolist(), at[:-1].tolist(), ends[0].tolist(), ends[1].tolist(), at[1:].tolist(), strict=True):
        first, middle, last = data[a:b], data[b:c], data[c:d]
        out.append(data[a:d] if kind == 0 else b"".join((p, first, s, last, m, middle) if kind == 1 else (s, last, p, first, m, middle)))
    plain = form == 0
    return n, _FORMS[form], low, high - low, plain, out


def _run(kept: list[str], cut: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, *draws = batch.columns[len(kept) :]
            raw, at = utf8(text)
            h = [x.to_numpy(zero_copy_only=False) for x in draws]
            for i, j in slices(at):
                n, form, first, middle, plain, out = _order(raw[at[i] : at[j]], at[i : j + 1] - at[i], [x[i:j] for x in h], cut, suffix_first)
                added = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[: len(kept)]], *added], names=[*kept, *_ADDED])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``docs`` (doc_id, text) without text, plus n, form (plain, psm or spm), prefix_chars, middle_chars and output."""
    kept = [c for c in docs.columns if c != "text" and c not in _ADDED]
    own = apart(docs.columns)
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce("text", F.lit("")).alias(f"{own}text"), *[x.alias(f"{own}{k}") for k, x in enumerate(_draws(seed))])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept], *[f"{k} {v}" for k, v in _ADDED.items()]])
    return rows.mapInArrow(lean(_run(kept, cut, suffix_first)), schema)


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form: each marker stands in a cut output once."""

    def body(x: Column, mark: str) -> Column:
        return F.substring(x, len(mark) + 1, 2**31 - 1)

    def between(mark: str, following: str) -> Column:
        return F.substring_index(F.substring_index(output, following, 1), mark, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(body(F.substring_index(output, SUFFIX, 1), PREFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, body(F.substring_index(output, PREFIX, 1), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
