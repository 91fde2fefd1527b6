"""Files as text-typed tables.

Every cell is text, never NULL: types are evidence to be weighed, not a schema to be trusted. Columns are
named c0, c1, ... by position, since headers may repeat or differ only in case; ``row_no`` orders rows.
"""

from __future__ import annotations

import csv
import dataclasses
import io
import itertools
import os
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.findings import Finding
from . import store
from .lexer import Bytes, Effect, Marks, columns

CSV_SUFFIXES = (".csv", ".tsv")
NAMED_ONLY_SUFFIXES = (".txt", ".tab")
EXCEL_SUFFIXES = (".xlsx", ".xlsm")
PARQUET_SUFFIXES = (".parquet", ".pq")
#: Most bytes of one cell.
CELL_CHARS = 16 * 1024 * 1024
SNIFF_BYTES = 64 * 1024
#: Bytes of a file's lines that a worker holds at once.
BATCH_BYTES = 8 * 1024 * 1024
_BOM = b"\xef\xbb\xbf"


class LoadError(Exception):
    """A file that cannot be read as a table."""


@dataclasses.dataclass
class TextTable:
    """A text-typed DataFrame (row_no, c0 ... cN) with what the driver knows about it."""

    df: DataFrame
    header: list[str]
    path: str = ""
    delimiter: str = ","
    findings: list[Finding] = dataclasses.field(default_factory=list)
    declared: dict[int, str] = dataclasses.field(default_factory=dict)
    #: Whether a row has the same number whenever the table is read.
    stable: bool = True

    def __post_init__(self):
        self.keys = column_keys(self.header)

    @property
    def columns(self) -> list[str]:
        return [f"c{i}" for i in range(len(self.header))]

    def find(self, selector: str) -> int | None:
        """Index of the first column whose key or name is ``selector``, case kept."""
        return next((i for i, (k, n) in enumerate(zip(self.keys, self.header, strict=True)) if selector in (k, n)), None)


def column_keys(header: list[str]) -> list[str]:
    """A unique key for each column: repeated names get #1, #2 ..., past any that the header has itself."""
    taken, out, repeated = set(header), [], {n for n in header if header.count(n) > 1}
    counts: dict[str, int] = {}
    for name in header:
        if name not in repeated:
            out.append(name)
            continue
        while True:
            counts[name] = counts.get(name, 0) + 1
            key = f"{name}#{counts[name]}"
            if key not in taken:
                break
        taken.add(key)
        out.append(key)
    return out


def text_of(column: Column, kind: T.DataType) -> Column:
    """A typed cell as the text that a person would have typed; NULL is empty."""
    if isinstance(kind, T.StringType):
        text = column
    elif isinstance(kind, T.BooleanType):
        text = F.when(column, "TRUE").otherwise("FALSE")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        day = F.date_format(column, "yyyy-MM-dd")
        text = F.when(F.date_format(column, "HHmmss") == "000000", day).otherwise(F.date_format(column, "yyyy-MM-dd HH:mm:ss"))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        wide = column.cast("double")
        whole = (wide == F.floor(wide)) & (F.abs(wide) < 1e15)
        # between 1e-3 and 1e7 the engine writes plain decimals; outside, a decimal cast avoids exponents
        plain = F.when((F.abs(wide) >= 1e-3) & (F.abs(wide) < 1e7), column.cast("string")).otherwise(F.regexp_replace(F.regexp_replace(wide.try_cast("decimal(38,12)").cast("string"), "0+\\z", ""), "\\.\\z", ""))
        text = F.when(F.isnan(wide), "nan").when(whole, F.floor(wide).cast("long").cast("string")).otherwise(F.coalesce(plain, column.cast("string")))
    elif isinstance(kind, T.DecimalType):
        trimmed = F.regexp_replace(F.regexp_replace(column.cast("string"), "(\\.[0-9]*?)0+\\z", "$1"), "\\.\\z", "")
        text = F.when(column.cast("string").contains("."), trimmed).otherwise(column.cast("string"))
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(column)
    elif isinstance(kind, T.BinaryType):
        text = F.decode(column, "UTF-8")
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit(""))


def from_dataframe(df: DataFrame, path: str = "", names: list[str] | None = None, order: str | None = None) -> TextTable:
    """Any DataFrame as a text table, in the order of its rows as read, or of a column of unique numbers that is then no cell."""
    fields = [f for f in df.schema.fields if f.name != order]
    cells = [text_of(F.col(f"`{f.name.replace('`', '``')}`"), f.dataType).alias(f"c{i}") for i, f in enumerate(fields)]
    own = df.select((F.monotonically_increasing_id() if order is None else F.col(order).cast("long")).alias("row_no"), *cells)
    return TextTable(own, names or [f.name for f in fields], path, declared={i: f.dataType.simpleString() for i, f in enumerate(fields)}, stable=order is not None)


def pinned(table: TextTable) -> TextTable:
    """The table with row numbers that stay; one numbered as it is read is written to the shared folder once."""
    if table.stable:
        return table
    spark, path = table.df.sparkSession, store.shared_path(table.df.sparkSession, "rows")
    table.df.write.parquet(path)
    return dataclasses.replace(table, df=spark.read.schema(table.df.schema).parquet(path), stable=True)


def _bounded(table: TextTable, max_rows: int | None) -> TextTable:
    if max_rows is None:
        return table
    if max_rows <= 0:
        raise LoadError("max_rows must be positive")
    return dataclasses.replace(table, df=table.df.orderBy("row_no").limit(max_rows))


#: Files whose first row numbers are sent to every task; more are joined as Spark sees fit.
FEW_FILES = 100_000


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """A Parquet scan with its rows numbered as they stand in the files, by file name: the same in every run."""
    placed = df.withColumns({f"{name}_file": F.col("_metadata.file_path"), f"{name}_at": F.col("_metadata.row_index")})
    sizes = df.groupBy(F.col("_metadata.file_path").alias(f"{name}_file")).agg(F.count("*").alias("n"))
    files = sizes.count()
    if files <= 1:
        return placed.withColumnRenamed(f"{name}_at", name).drop(f"{name}_file")
    before = Window.orderBy(f"{name}_file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    first = sizes.select(f"{name}_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{name}_first"))
    joined = placed.join(F.broadcast(first) if files <= FEW_FILES else first, f"{name}_file")
    return joined.withColumn(name, F.col(f"{name}_at") + F.col(f"{name}_first")).drop(f"{name}_file", f"{name}_at", f"{name}_first")


def read_parquet(spark: SparkSession, path: str, max_rows: int | None = None) -> TextTable:
    df = spark.read.parquet(path)
    name = "_" * max(map(len, df.columns), default=0) + "_row"
    return _bounded(from_dataframe(number_rows(df, name), path, order=name), max_rows)


def sniff_delimiter(sample: str, override: str | None = None) -> str:
    """The delimiter of a text sample; a comma if nothing settles it."""
    if override is not None:
        if len(override) != 1 or override in '\r\n\0"':
            raise LoadError(f"not a delimiter: {override!r}")
        return override
    try:
        return csv.Sniffer().sniff(sample, delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def scan_bytes(content: bytes) -> dict:
    """What a file's bytes say before any parsing: BOM, encoding, NULs and line ends."""
    return _byte_facts(Bytes.of(content))


def _byte_facts(found: Bytes) -> dict:
    return {"bom": found.head.startswith(_BOM), "invalid_at": found.invalid_at, "nuls": found.nuls, "crlf": found.crlf, "lf": found.lf - found.crlf, "ends_open": bool(found.size) and found.last not in (b"\n", b"\r")}


def quote_fault(text: str, delimiter: str) -> str | None:
    """Why a file's quoting cannot be read without guessing, or None."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return Effect.of(raw, delimiter.encode()).message()


def _byte_findings(facts: dict) -> list[Finding]:
    out = []
    if facts["bom"]:
        out.append(Finding("bom", "warning", "The file starts with a byte-order mark, which many readers take for part of the first name."))
    if facts["invalid_at"] is not None:
        out.append(Finding("encoding", "error", f"Byte {int(facts['invalid_at'])} is not UTF-8; the file was read as Latin-1.", detail={"offset": int(facts["invalid_at"])}))
    if facts["nuls"]:
        out.append(Finding("null-bytes", "error", f"{facts['nuls']} NUL bytes stand in the file.", detail={"count": int(facts["nuls"])}))
    if facts["crlf"] and facts["lf"]:
        out.append(Finding("mixed-line-endings", "warning", "Lines end in two ways.", detail={"crlf": int(facts["crlf"]), "lf": int(facts["lf"])}))
    if facts["ends_open"]:
        out.append(Finding("no-trailing-newline", "info", "The last line has no end, so a line added later joins it."))
    return out


def _contents(batches, end: bytes):
    """((hashed name of the file, start of the range), its next bytes) of a task's lines; every line is given its end again."""
    for batch in batches:
        names, starts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist(), len(starts)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i < j:
                yield (int(names[i]), int(starts[i])), end.join([*batch.column(2).slice(i, j - i).to_pylist(), b""])


def _bits(content: bytes) -> np.ndarray:
    return np.frombuffer(content, np.uint8)


def _effects(end: bytes, sep: bytes):
    """One row a range of the file: what its bytes are, and what they do to a reader."""

    def run(batches):
        for at, group in itertools.groupby(_contents(batches, end), key=lambda x: x[0]):
            held, does = Bytes(), Effect()
            for _, content in group:
                held, does = held.then(Bytes.of(content)), does.then(Effect.of(_bits(content), sep))
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([pickle.dumps((held, does))], pa.binary())], names=["file", "start", "summary"])

    return run


class _Cutter:
    """Batches of records, and of parts of records whose rest is in another range."""

    def __init__(self, sep: bytes, width: int):
        self.sep, self.width = sep, width
        self.schema = pa.schema([("row_no", pa.int64()), ("width", pa.int64()), *[(f"c{i}", pa.string()) for i in range(width)], ("seam", pa.int64()), ("part_at", pa.int64()), ("part", pa.binary())])

    def ddl(self) -> str:
        return ", ".join(["row_no long, width long", *[f"c{i} string" for i in range(self.width)], "seam long, part_at long, part binary"])

    def part(self, seam: int, at: int, content: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"seam": seam, "part_at": at, "part": content}], self.schema)

    def records(self, content: bytes, row: int) -> tuple[pa.RecordBatch, bytes]:
        """(the whole records, numbered from ``row``; what begins a record without its end), from outside quotes."""
        ends, _ = Marks(_bits(content), self.sep).outside(0)
        whole = int(ends[-1]) + 1 if len(ends) else 0
        cells, first, count = Marks(_bits(content[:whole]), self.sep).fields()
        if len(cells) and pc.max(pc.binary_length(cells)).as_py() > CELL_CHARS:
            raise ValueError(f"a cell is longer than {CELL_CHARS} bytes")
        n = len(first)
        empty = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), pa.array(count), *columns(cells, first, count, self.width), *empty], schema=self.schema), content[whole:]


def _cut(end: bytes, encoding: str, cutter: _Cutter, entries: dict[tuple[int, int], tuple[int, int, int, int]]):
    """The records of each range, from the state that it is truly entered in.

    ``entries``: file and start of a range -> (1 if it begins inside quotes, number of the first record that ends in it,
    number of the record that its last line may leave open, the range's place among all).
    """

    def run(batches):
        for at, group in itertools.groupby(_contents(batches, end), key=lambda x: x[0]):
            if at not in entries:
                raise RuntimeError("the file's ranges are not those that were scanned; did it change?")
            (inside, row, seam, place), carry = entries[at], b""
            for _, content in group:
                if encoding != "utf-8":
                    content = content.decode(encoding).encode()
                if inside:  # up to the end of the record that an earlier range began
                    ends, _ = Marks(_bits(content), cutter.sep).outside(1)
                    if not len(ends):
                        carry += content
                        continue
                    cut = int(ends[0]) + 1
                    yield cutter.part(row, place, carry + content[:cut])
                    carry, content, inside, row = b"", content[cut:], 0, row + 1
                batch, carry = cutter.records(carry + content, row)
                row += batch.num_rows
                if batch.num_rows:
                    yield batch
            if carry:
                yield cutter.part(seam, place, carry)

    return run


def _mended(cutter: _Cutter):
    """Records from their parts, in order."""

    def run(batches):
        for batch in batches:
            for seam, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield cutter.records(b"".join(x["part"] for x in parts), seam)[0]

    return run


def _pinned(spark: SparkSession) -> SparkSession:
    """A session whose files are cut into the same ranges again, whatever executors come and go."""
    own = spark.newSession()
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000000")
    return own


@dataclasses.dataclass
class Scanned:
    """A delimited file after one pass: its bytes, the effect of its ranges, and how each is to be entered."""

    held: Bytes
    effect: Effect
    entries: dict[tuple[int, int], tuple[int, int, int, int]]
    end: bytes
    open_seams: bool


def _lines(session: SparkSession, path: str, end: bytes) -> DataFrame:
    lines = session.read.option("lineSep", end.decode()).text(store.text_files(session, path))
    return lines.select(F.xxhash64("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start"), F.col("value").cast("binary"))


def _places(session: SparkSession, files: list[str]) -> dict[int, int]:
    """A file's hashed name -> its place among the files."""
    names = session.createDataFrame([(k, at.rstrip("/").rsplit("/", 1)[-1]) for k, at in enumerate(files)], "place int, name string")
    return {r["h"]: r["place"] for r in names.select("place", F.xxhash64("name").alias("h")).collect()}


def scan_file(session: SparkSession, path: str, head: bytes, sep: bytes) -> Scanned:
    """One pass over a file or a text in part files, in ranges; the driver holds one summary a range, as it holds the ranges themselves."""
    end, files = b"\r" if b"\r" in head and b"\n" not in head else b"\n", store.text_files(session, path)
    rows = _lines(session, path, end).mapInArrow(_effects(end, sep), "file long, start long, summary binary").collect()
    placed = _places(session, files) if len(files) > 1 else {r["file"]: 0 for r in rows}
    ranges = sorted((placed[r["file"]], r["start"], r["file"], pickle.loads(r["summary"])) for r in rows)
    held, effect, entered = Bytes.of(head[:3]) if head.startswith(_BOM) else Bytes(), Effect(), []
    for _, at, file, (own, does) in ranges:
        entered.append(((file, at), effect.turns, effect.records[0], does.ends[effect.turns]))
        held, effect = held.then(own), effect.then(does)
    entries, seam = {}, effect.records[0]
    for k, (at, state, row, ends) in reversed(list(enumerate(entered))):
        entries[at] = (state, row, seam, k)
        seam = row if ends else seam
    full = next(((f, n) for f in reversed(files) if (n := store.size(session, f))), None)
    last = store.read_range(session, full[0], full[1] - 1, 1) if full else b""
    if last and last != end:  # the last line had no end
        held = dataclasses.replace(held, size=held.size - 1, lf=held.lf - (end == b"\n"), crlf=held.crlf - (last == b"\r" and end == b"\n"))
    return Scanned(dataclasses.replace(held, last=last), effect, entries, end, any(state for _, state, _, _ in entered))


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, max_rows: int | None = None) -> TextTable:
    """A delimited file of any size: strict quoting, ragged rows padded or cut and reported, blank lines skipped.

    A folder of part files is one text with one header, in the order of their names, a part's last line ending with it.
    Ranges of the file are scanned, then cut into cells from the state that the ranges before leave them in; a record
    over the end of a range is put together from its parts. The table is written to the shared folder once, with rows
    numbered as they stand in the file, and read from there whenever it is used.
    """
    if not store.text_files(spark, path):
        raise LoadError(f"{path}: expected one file or part files, found {'a folder without' if store.exists(spark, path) else 'none'}")
    head, session = store.head(spark, path, SNIFF_BYTES), _pinned(spark)
    scanned, encoding, sep = None, "utf-8", sniff_delimiter(head.decode("utf-8-sig", "ignore"), delimiter)
    while scanned is None:
        scanned = scan_file(session, path, head, sep.encode(encoding))
        if encoding == "utf-8" and scanned.held.invalid_at is not None:
            encoding, before = "latin-1", sep.encode()
            sep = sniff_delimiter(head.decode(encoding), delimiter)
            if sep.encode(encoding) != before:  # it was looked for in another form, or is another
                scanned = None
    if fault := scanned.effect.message():
        raise LoadError(f"{path}: {fault}")
    text = head.decode("utf-8-sig" if encoding == "utf-8" else encoding, "ignore")
    csv.field_size_limit(CELL_CHARS)
    header = next(filter(None, csv.reader(io.StringIO(text, newline=""), delimiter=sep)), None)
    if header is None or not text.strip():
        raise LoadError(f"{path}: the file has no header")
    cutter = _Cutter(sep.encode(), len(header))
    paths = [store.shared_path(spark, "csv")]
    _lines(session, path, scanned.end).mapInArrow(_cut(scanned.end, encoding, cutter, scanned.entries), cutter.ddl()).write.parquet(paths[0])
    if scanned.open_seams:
        parts = session.read.parquet(paths[0]).where("seam IS NOT NULL").groupBy("seam").agg(F.array_sort(F.collect_list(F.struct("part_at", "part"))).alias("parts"))
        paths.append(store.shared_path(spark, "csv"))
        parts.mapInArrow(_mended(cutter), cutter.ddl()).write.parquet(paths[1])
    numbered = spark.read.schema(cutter.ddl()).parquet(*paths).where("row_no > 0").withColumn("row_no", F.col("row_no") - 1)
    names = [f"c{i}" for i in range(len(header))]
    table = TextTable(numbered.select("row_no", *names), header, path, sep, _byte_findings(_byte_facts(scanned.held)))
    ragged = numbered.where(F.col("width") != len(header)).select("row_no")
    first = [r["row_no"] + 2 for r in ragged.orderBy("row_no").limit(5).collect()]
    if first:
        count = ragged.count()
        table.findings.insert(0, Finding("ragged-rows", "error", f"{count} rows do not have {len(header)} fields.", detail={"count": count, "lines": first, "expected": len(header)}))
    return _bounded(table, max_rows)


def read_excel(spark: SparkSession, path: str, sheet: str | None = None, max_rows: int | None = None) -> TextTable:
    """The first or the named sheet of a workbook; needs openpyxl on the driver, which reads one workbook at a time."""
    from . import excel

    return _bounded(excel.read(spark, path, sheet), max_rows)


def read_any(spark: SparkSession, path: str, delimiter: str | None = None, sheet: str | None = None, max_rows: int | None = None) -> TextTable:
    """A table in whichever format the path's suffix names; other suffixes are read as delimited text."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".xls":
        raise LoadError("the old .xls format is not read; save the workbook as .xlsx")
    if suffix in PARQUET_SUFFIXES:
        return read_parquet(spark, path, max_rows)
    if suffix in EXCEL_SUFFIXES:
        return read_excel(spark, path, sheet, max_rows)
    return read_csv(spark, path, delimiter, max_rows)


def discover(spark: SparkSession, paths: list[str], recursive: bool = True) -> list[str]:
    """Files named, those that patterns match, and the table files under folders named, sorted; on any store.

    A folder whose name is that of a Parquet table is a table.
    """
    suffixes = CSV_SUFFIXES + EXCEL_SUFFIXES + PARQUET_SUFFIXES

    def under(folder: str) -> list[str]:
        out = []
        for path, inner in store.listing(spark, folder):
            if path.lower().endswith(PARQUET_SUFFIXES) or not inner and path.lower().endswith(suffixes):
                out.append(path)
            elif inner and recursive:
                out += under(path)
        return out

    found: list[str] = []
    for path in paths:
        own = [path] if store.exists(spark, path) else [p for p, _ in store.listing(spark, path)]
        if not own:
            raise LoadError(f"{path}: no such file")
        for p in own:
            found += under(p) if store.is_folder(spark, p) and not p.rstrip("/").lower().endswith(PARQUET_SUFFIXES) else [p]
    return list(dict.fromkeys(found))
