"""CSV in many tasks against the reader that takes a file whole, with edges of splits everywhere."""

import csv
import io
import random

import pytest

from harborline.sources import csv_split, readers


def whole(spark, path):
    """The rows as Spark's reader gives them that reads a file in one task."""
    df = spark.read.options(header=True, multiLine=True, escape='"', quote='"', nullValue="\u0000", emptyValue="", enforceSchema=False).csv(str(path))
    return df.columns, [tuple(r) for r in df.collect()]


def rows_of(spark, path):
    s = readers.read_csv(spark, str(path))
    got = sorted((r[readers.ROW], tuple(r[n] for n in s.names)) for r in s.df.collect())
    assert [k for k, _ in got] == list(range(1, len(got) + 1))
    return s.names, [r for _, r in got]


def cells(rng):
    return rng.choice(["", "a", "plain text", 'a "quoted" word', "two\nlines", "\n\n", ',",', '"', "é, ü", "x" * 30, " padded ", 'end"\n"', "1\n2\n3\n4"])


@pytest.fixture
def splits(spark):
    """Files are split every so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def every(n):
        spark.conf.set(keys[0], n)
        spark.conf.set(keys[1], 1)
        spark.conf.set(keys[2], 1)

    yield every
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(3))
def test_splits_at_any_byte(spark, tmp_path, splits, seed):
    rng = random.Random(seed)
    rows = [["k", "first name", "c"], *([str(i), cells(rng), cells(rng)] for i in range(25))]
    out = io.StringIO()
    csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"]), quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL])).writerows(rows)
    (tmp_path / "a.csv").write_text(out.getvalue(), newline="")
    want = whole(spark, tmp_path / "a.csv")
    assert len(want[1]) == 25
    for n in (7, 23, 64, 300):
        splits(n)
        assert rows_of(spark, tmp_path / "a.csv") == want


def test_every_edge_of_one_record(spark, tmp_path, splits):
    text = 'a,b\n1,"x\n""y"",\nz"\n2,w\n'
    (tmp_path / "a.csv").write_text(text)
    want = whole(spark, tmp_path / "a.csv")
    for n in range(2, len(text), 3):
        splits(n)
        assert rows_of(spark, tmp_path / "a.csv") == want


@pytest.mark.parametrize(
    "text",
    [
        "a,b\n1,2\n3\n4,5,6\n\n\n7,8", "a,b\r\n1,\r\n,2\r\n", 'a\n""\n" "\nx', 'a,b\n5" pipe,2\nx"y"z,"q"\n', 'a,b\n"closed"more,1\n2,3\n',
        "﻿a,b\n1,2\n", 'a,b\n1,"never closed\n2,3\n', "a,b\n", '"a\nb",c\n1,2\n', "a,b\n \n\t,\n",
    ],
)
def test_odd_files(spark, tmp_path, splits, text):
    (tmp_path / "a.csv").write_text(text, newline="")
    want = whole(spark, tmp_path / "a.csv")
    for n in (4, 1000):
        splits(n)
        names, got = rows_of(spark, tmp_path / "a.csv")
        trimmed = [tuple(None if c is None else c.rstrip("\n") for c in r) for r in want[1]]
        assert names == want[0] and [tuple(None if c is None else c.rstrip("\n") for c in r) for r in got] == trimmed


def test_lines_that_end_in_carriage_returns_alone(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a,b\r1,2\r3,4\r")
    (tmp_path / "a 50%25 é.csv").write_text("a,b\n1,2\n3,4\n")
    assert rows_of(spark, tmp_path / "a 50%25 é.csv") == rows_of(spark, tmp_path / "a.csv") == (["a", "b"], [("1", "2"), ("3", "4")])


def test_one_file_is_many_tasks(spark, tmp_path, splits):
    (tmp_path / "a.csv").write_text("k,v\n" + "".join(f'{i},"text\nof {i}"\n' for i in range(3000)))
    splits(4096)
    assert csv_split.records(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() >= 10
    names, got = rows_of(spark, tmp_path / "a.csv")
    assert got == [(str(i), f"text\nof {i}") for i in range(3000)]


def test_states_of_lines():
    for line, zero, one in [("a,b", False, True), ('"', True, False), ('a"', False, False), ('x","y', True, True), ('""', False, True), ('","', False, True), ('"a""', True, False), ('a,"b""c",d', False, False)]:
        assert csv_split.ends_inside(line, False) == zero, line
        if "," not in line or line == "a,b":
            assert csv_split.ends_inside(line, True) == one, line
