"""Ranges of a file against the whole file, read a character or a record at a time."""

import csv
import io

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.sources.lexer import Bytes, Effect, Marks, columns
from lodestrata.sources.tables import LoadError, _pinned, quote_fault, read_csv, scan_bytes, scan_file


def fault_by_character(text, delimiter):
    state, line, opened = "start", 1, 0
    for c in text:
        line += c == "\n"
        if state == "quoted":
            state = "closed" if c == '"' else state
        elif state == "closed":
            if c == '"':
                state = "quoted"
            elif c == delimiter or c in "\r\n":
                state = "start"
            else:
                return f"line {line}: text follows a closing quote"
        elif c == '"':
            if state == "plain":
                return f"line {line}: a quote stands inside an unquoted field"
            state, opened = "quoted", line
        else:
            state = "start" if c == delimiter or c in "\r\n" else "plain"
    return f"line {opened}: a quoted field never ends" if state == "quoted" else None


SMALL = st.text(alphabet='",\r\na§é', max_size=40)
SEPS = st.sampled_from([",", "§", "é", ";"])


def ranges(data, cuts):
    """The bytes cut behind some of their line ends."""
    ends = [k + 1 for k, c in enumerate(data) if c in b"\n\r"]
    at = [0, *sorted({ends[c % len(ends)] for c in cuts}), len(data)] if ends else [0, len(data)]
    return [data[i:j] for i, j in zip(at, at[1:]) if i < j]


def effect(parts, sep):
    out = Effect()
    for part in parts:
        out = out.then(Effect.of(np.frombuffer(part, np.uint8), sep.encode()))
    return out


@settings(max_examples=1_500, deadline=None)
@given(SMALL, SEPS, st.lists(st.integers(0, 50), max_size=4))
def test_effects_of_ranges_give_the_first_fault(text, sep, cuts):
    assert quote_fault(text, sep) == fault_by_character(text, sep)
    assert effect(ranges(text.encode(), cuts), sep).message() == fault_by_character(text, sep)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from([b"", b"a", b"\r", b"\n", b"\0", "é".encode(), "漢".encode(), "𝔘".encode(), b"\xf0\x9f", b"\x80", b"\xe2\x28", b"\xff", b"\xed\xa0\x80"]), max_size=9).map(b"".join))
def test_bytes_of_parts_at_every_cut(content):
    whole = scan_bytes(content)
    try:
        content.decode()
        bad = None
    except UnicodeDecodeError as error:
        bad = error.start
    assert (whole["invalid_at"], whole["crlf"], whole["nuls"]) == (bad, content.count(b"\r\n"), content.count(b"\0"))
    of = Bytes.of
    for i in range(len(content) + 1):
        assert of(content[:i]).then(of(content[i:])) == of(content)
        for j in range(i, len(content) + 1):
            a, b, c = of(content[:i]), of(content[i:j]), of(content[j:])
            assert a.then(b).then(c) == a.then(b.then(c)) and a.then(b).then(c).invalid_at == bad


CELLS = st.lists(st.lists(st.text(alphabet='",\r\na é', max_size=6), min_size=1, max_size=4), min_size=1, max_size=8)


@settings(max_examples=500, deadline=None)
@given(CELLS, st.sampled_from(["\n", "\r\n", "\r"]), st.sampled_from([",", "§"]), st.lists(st.integers(0, 50), max_size=3), st.booleans())
def test_cells_are_those_of_a_reader(rows, end, sep, blank, every):
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=sep, lineterminator=end, quoting=csv.QUOTE_ALL if every else csv.QUOTE_MINIMAL).writerows(rows)
    text = out.getvalue()
    lines = text.split(end)
    if blank and '"' not in text:  # blank lines between records
        text = end.join(x + (end if k in blank else "") for k, x in enumerate(lines))
    want = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
    cells, first, count = Marks(np.frombuffer(text.encode(), np.uint8), sep.encode()).fields()
    own = cells.to_pylist()
    assert [own[a : a + n] for a, n in zip(first, count)] == want
    assert [c.to_pylist() for c in columns(cells, first, count, 3)] == [[r[j] if j < len(r) else "" for r in want] for j in range(3)]


def written(tmp_path, content):
    path = f"{tmp_path}/t.csv"
    with open(path, "wb") as f:
        f.write(content)
    return path


@pytest.fixture
def tiny_ranges(spark):
    """Files are cut every 512 bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "512")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cells_of(table):
    return [tuple(r)[1:] for r in table.df.orderBy("row_no").collect()], [r["row_no"] for r in table.df.select("row_no").orderBy("row_no").collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r", "mixed"])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "latin-1"])
def test_file_in_many_ranges(spark, tmp_path, tiny_ranges, end, encoding):
    rows = [["id", "note", "é"]]
    for k in range(300):
        note = "x" * (k % 40) + ("line\nbreak, \"quoted\"\r\n" * (k % 7 == 0)) + ("é" * (k % 3))
        rows.append([str(k), note if k != 150 else "over many ranges\n" * 200, ""][: 2 if k % 50 == 9 else 3] + (["more"] if k % 60 == 11 else []))
    text = ""
    for k, r in enumerate(rows):
        one = io.StringIO(newline="")
        csv.writer(one, lineterminator=("\r\n" if k % 2 else "\n") if end == "mixed" else end).writerow(r)
        text += one.getvalue() + ("\n" if k % 90 == 7 else "")
    text = text[:-1]
    table = read_csv(spark, written(tmp_path, text.encode(encoding)))
    found, numbers = cells_of(table)
    assert table.header == rows[0] and numbers == list(range(300))
    assert found == [tuple((r + ["", ""])[:3]) for r in rows[1:]]
    whole = scan_bytes(text.encode(encoding))
    by_code = {f.code: f for f in table.findings}
    assert ("bom" in by_code) == (encoding == "utf-8-sig") and ("encoding" in by_code) == (encoding == "latin-1")
    assert "no-trailing-newline" in by_code or text[-1] == "\r"
    if encoding == "latin-1":
        assert by_code["encoding"].detail["offset"] == whole["invalid_at"]
    if whole["crlf"] and whole["lf"]:
        assert by_code["mixed-line-endings"].detail == {"crlf": whole["crlf"], "lf": whole["lf"]}
    assert by_code["ragged-rows"].detail == {"count": 11, "lines": [11, 13, 61, 73, 111], "expected": 3}


def test_faults_are_those_of_the_whole_file(spark, tmp_path, tiny_ranges):
    good = "".join(f'{k},"a ""b""\nc",{k}\n' for k in range(400))
    for bad in ('1,"x"y,2\n', '1,x"y",2\n', '1,"never\n'):
        text = "i,j,k\n" + good + bad + (good if bad != '1,"never\n' else "")
        with pytest.raises(LoadError) as raised:
            read_csv(spark, written(tmp_path, text.encode()))
        assert str(raised.value).endswith(fault_by_character(text, ","))


def test_odd_files(spark, tmp_path, tiny_ranges):
    for content in (b"", b"\n\n", b"\xef\xbb\xbf"):
        with pytest.raises(LoadError):
            read_csv(spark, written(tmp_path, content))
    with pytest.raises(LoadError):
        read_csv(spark, f"{tmp_path}/none.csv")
    with pytest.raises(LoadError):
        read_csv(spark, str(tmp_path))
    table = read_csv(spark, written(tmp_path, "a§b\n1§2\n\n\"x§y\"§".encode("latin-1")), "§")
    assert cells_of(table)[0] == [("1", "2"), ("x§y", "")] and table.delimiter == "§"
    table = read_csv(spark, written(tmp_path, b"a,b"))
    assert table.header == ["a", "b"] and table.df.count() == 0
    table = read_csv(spark, written(tmp_path, b"\n\na\tb\n1\t\0\n"), max_rows=1)
    assert cells_of(table) == ([("1", "\0")], [0]) and {f.code for f in table.findings} == {"null-bytes"}


def test_many_tasks_read_one_file(spark, tmp_path, tiny_ranges):
    path = written(tmp_path, b"a,b\n" + b'1,"x\ny"\n' * 4_000)
    scanned = scan_file(_pinned(spark), path, b"a,b\n", b",")
    assert len(scanned.entries) > 50 and scanned.open_seams
    table = read_csv(spark, path)
    assert table.df.count() == 4_000 and table.df.where("c1 = 'x\ny'").count() == 4_000
    assert table.df.select("row_no").distinct().count() == 4_000


def test_part_files_are_one_text(spark, tmp_path, tiny_ranges):
    parts = [b"id,note\n", b"", b'1,"a\nb"\n2,"over\n', "é\n".encode() * 600, b'parts"\n3,c\n', b"4,d", b"5,e\n"]
    for k, content in enumerate(parts):
        (tmp_path / f"part-{k:05d}-x.csv").write_bytes(content)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    table = read_csv(spark, str(tmp_path))
    found, numbers = cells_of(table)
    assert table.header == ["id", "note"] and numbers == list(range(5)) and table.findings == []
    assert found == [("1", "a\nb"), ("2", "over\n" + "é\n" * 600 + "parts"), ("3", "c"), ("4", "d"), ("5", "e")]
    (tmp_path / "part-00007-x.csv").write_bytes(b'6,x"y"\n')
    with pytest.raises(LoadError, match="line 609: a quote stands inside"):
        read_csv(spark, str(tmp_path))


def test_csv_round_trip_of_odd_names(spark, tmp_path):
    from lodestrata.plans.quality import csv_round_trip

    rows = [(0, ' say "x", y ', 1), (1, "two\nlines", 2), (2, "back\\", 3)]
    spark.createDataFrame(rows, "n_nationkey int, n_name string, n_regionkey int").repartition(2).write.parquet(f"{tmp_path}/nation.parquet")
    assert sorted(map(tuple, csv_round_trip(spark, str(tmp_path)).collect())) == [(str(a), b, str(c)) for a, b, c in rows]


def test_large_texts_are_written_in_parts_and_read_in_few_ranges(spark, monkeypatch):
    from lodestrata.plans import files
    from lodestrata.sources import store

    sizes, scan = [], files.scan_file
    monkeypatch.setattr(files, "PART_LINES", 400)
    monkeypatch.setattr(files, "_PIECE", 256)
    monkeypatch.setattr(files, "_RANGES", 8)
    monkeypatch.setattr(files, "scan_file", lambda *a: sizes.append(scan(*a)) or sizes[-1])
    got = {r["name"]: r for r in files.file_bytes(spark, "/root/testdata/sf0.001").collect()}
    path = files.written(spark, "/root/testdata/sf0.001", "id", "CAST(id AS STRING)")
    assert len(store.text_files(spark, path)) > 2
    keys = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey").orderBy("o_orderkey").collect()]
    assert b"".join(store.read_small(spark, f) for f in store.text_files(spark, path)).split() == [b"id", *[str(k).encode() for k in keys]]
    assert got["plain"]["lf"] == len(keys) + 1 and got["tabs"]["crlf"] == sum(k % 2 == 0 for k in keys)
    # 256 bytes a range would be more than a hundred
    assert all(1 < len(s.entries) < 40 for s in sizes)
