"""CSV cells with line breaks: equal to Spark's own multi-line reader, wherever the file is cut into splits."""

import csv as plain_csv
import io
import random

import pytest

from dataheal.config import QualityConfig
from dataheal.sources import csv, quoted

CFG = QualityConfig()


def some_file(seed: int, rows: int, end: str) -> bytes:
    r = random.Random(seed)
    cell = lambda: r.choice(["", "a", "b c", 'say "x"', "two\nlines", "three\n\nlines,with \"q\"\n", ",", "é漢", '"', "tail\r\nbreak", " pad "])
    out = io.StringIO()
    writer = plain_csv.writer(out, lineterminator=end)
    writer.writerow(["id", "first", "sec\nond", "third"])
    for i in range(rows):
        writer.writerow([f"r{i}", cell(), cell(), cell()])
        if r.random() < 0.1:
            out.write(end)  # a blank line
    return out.getvalue().encode()


def cells(df) -> list[tuple]:
    return [tuple(r) for r in df.orderBy(df.columns[0]).collect()]


@pytest.fixture
def cut(spark):
    """Sets the size of splits for a test."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def by(size: int) -> None:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield by
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_reader_of_whole_files(spark, tmp_path, cut, end):
    """Also with ``\\r\\n``, which Spark's multi-line reader leaves in the last cell."""
    expected = []
    for k in range(2):
        data = some_file(k + len(end), 25, end)
        (tmp_path / f"part{k}.csv").write_bytes(data)
        expected += [r for r in plain_csv.reader(io.StringIO(data.decode(), newline="")) if r][1:]
    path = str(tmp_path)
    expected = [(i, *(c or None for c in r)) for i, r in enumerate(expected)]
    whole = csv.scan_raw_strings(spark, path, multiline=True)
    if end == "\n":
        assert cells(whole) == expected
    for size in (1 << 20, 190, 61, 17):
        cut(size)
        got = csv.scan_raw_strings(spark, path)
        assert got.columns == ["row_index", "id", "first", "sec\nond", "third"]
        assert cells(got) == expected, size


def test_cut_at_every_byte(spark, tmp_path, cut):
    """Splits of one byte and more; the state must carry over wherever a border falls."""
    text = b'id,x\nr0,"a\n""b"\n\nr1,5" pipe\nr2,"c,""\n,"\nr3,"d"\n'
    path = tmp_path / "t.csv"
    path.write_bytes(text)
    cut(1 << 20)
    expected = [("r0", 'a\n"b'), ("r1", '5" pipe'), ("r2", 'c,"\n,'), ("r3", "d")]
    assert [r[1:] for r in cells(csv.scan_raw_strings(spark, str(path), multiline=True))] == expected
    names = quoted.header(spark, str(path))
    for size in (1, 2, 3, 5, 8, 13, 21, 34):
        cut(size)
        found = quoted.records(spark, str(path)).orderBy(quoted.BLOCK, quoted.AT).collect()
        assert [r["record"] for r in found] == ["id,x", 'r0,"a\n""b"', 'r1,5" pipe', 'r2,"c,""\n,"', 'r3,"d"'], size
    cut(9)
    assert [tuple(r) for r in csv.scan_raw_strings(spark, str(path)).orderBy("row_index").collect()] == [(i, *r) for i, r in enumerate(expected)]
    assert names == ["id", "x"]


def test_no_task_reads_a_whole_file(spark, tmp_path, cut):
    (tmp_path / "big.csv").write_bytes(some_file(5, 4_000, "\n"))
    cut(16_000)
    lines = quoted._lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 5
    blocks = quoted._blocks(lines).collect()
    assert len(blocks) > 5 and {r[quoted.STATE] for r in blocks} == {0, 1}
    typed = csv.scan_csv(spark, str(tmp_path), CFG)
    cut(1 << 30)
    assert cells(typed) == cells(csv.scan_csv(spark, str(tmp_path), CFG, multiline=True))


def test_files_without_breaks_stay_line_by_line(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,x\n1,"a, ""b"""\n2,5" pipe\n')
    assert not quoted.holds_breaks(spark, str(tmp_path))
    assert cells(csv.scan_raw_strings(spark, str(tmp_path))) == [(0, "1", 'a, "b"'), (1, "2", '5" pipe')]
    (tmp_path / "t.csv").write_text("id,x\n")
    assert csv.scan_raw_strings(spark, str(tmp_path)).count() == 0


def test_an_unclosed_cell_takes_the_rest_of_its_file_only(spark, tmp_path, cut):
    (tmp_path / "a.csv").write_text('id,x\n1,"open\n2,b\n')
    (tmp_path / "b.csv").write_text("id,x\n3,c\n")
    cut(6)
    got = [tuple(r) for r in csv.scan_raw_strings(spark, str(tmp_path)).orderBy("row_index").collect()]
    assert [r[0] for r in got] == [0, 1] and got[1] == (1, "3", "c") and got[0][1] == "1" and "2,b" in got[0][2]
