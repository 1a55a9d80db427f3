"""Files in encodings that Spark's text reader does not take: the same lines and cells for every way to cut them."""

import random

import pytest

from harborline.sources import encoded, readers

TEXTS = {
    "cp500": "Ärger über\nzwei\r\n\nvier\x85fünf, \r\n" * 9 + "ohne Ende",
    "latin-1": "é\r\nß \n\n\nx" * 20,
    "utf-16-le": "a\u2028 b \x0b\r\n\u2029ä" * 15,
    "shift_jis": "表ソ\n能\r\n十\n" * 15,
    "gb18030": "你好\n𠀀\r\nabc\n\n" * 15,
    "utf-16": "ਊ਀\nä\r\n𝄞 z\n" * 15,
    "utf-16-be": "ਊ਀\nä\r\n𝄞\n" * 15,
    "utf-32": "ਊ\nä\r\n𝄞\n" * 15,
    "utf-8-sig": "ä\n﻿b\n" * 15,
    "iso2022_jp": "表\nソ\n能 abc\n" * 15,
}


def read(frame):
    return [r["value"] for r in frame.collect()]


@pytest.mark.parametrize("encoding", TEXTS)
def test_lines_equal_those_of_the_whole_file(spark, tmp_path, encoding):
    p, text = tmp_path / "a.txt", TEXTS[encoding]
    p.write_bytes(text.encode(encoding))
    for split in (7, 64, 1 << 20):
        got = encoded.lines(spark, str(p), encoding, split_bytes=split)
        assert read(got) == text.splitlines(), split
        many = encoding != "iso2022_jp" and split < 1 << 20
        assert (got.rdd.getNumPartitions() > 1) == many


def test_every_place_to_cut(tmp_path):
    """Ranges of every size, cut where the tasks cut, give the lines of the file."""
    for encoding, text in TEXTS.items():
        raw = text.encode(encoding)
        p = tmp_path / "a.txt"
        p.write_bytes(raw)
        for ends, feeds_only in (("\n\x85", False), ("\n", True)):
            c = encoded.cuts(encoding, raw[:4], ends)
            want = text.splitlines() if not feeds_only else text.split("\n")[: -1 if text.endswith("\n") else None]
            if c is None:
                assert encoding == "iso2022_jp"
                continue
            for step in range(c.width, 50 * c.width, c.width):
                with open(p, "rb") as f:
                    n = -(-(len(raw) - c.origin) // step)
                    at = [c.origin, *(encoded._end_of_line(f, c.origin + k * step, len(raw), c) for k in range(1, n)), len(raw)]
                got = [x for a, b in zip(at, at[1:]) for out in encoded.split_lines(iter([raw[a:b]]), c.codec, feeds_only) for x in out]
                assert got == want, (encoding, step, feeds_only)


def test_blocks_of_any_size():
    rng = random.Random(3)
    for encoding, text in TEXTS.items():
        raw = text.encode(encoding)
        for _ in range(40):
            at = sorted({0, len(raw), *(rng.randrange(len(raw)) for _ in range(rng.randint(0, 30)))})
            blocks = [raw[a:b] for a, b in zip(at, at[1:])]
            assert [x for out in encoded.split_lines(iter(blocks), encoding, False) for x in out] == text.splitlines()
    assert list(encoded.split_lines(iter([]), "cp500", False)) == []


def test_fixed_width_in_many_ranges(spark, tmp_path, monkeypatch):
    """Rows are numbered through all ranges; lines may end in NEL, as on mainframes, and no line feed need be there."""
    p = tmp_path / "a.txt"
    p.write_bytes("".join(f"{i:06d} Größe {i % 7}\x85" + ("\x85" if i % 5 == 0 else "") for i in range(3000)).encode("cp500"))
    monkeypatch.setattr(readers.encoded, "lines", lambda *a, f=encoded.lines, **k: f(*a, **k, split_bytes=1000))
    s = readers.read_fixed_width(spark, str(p), [("n", 1, 6), ("word", 8, 7)], "cp500")
    got = s.df.orderBy("_row").select("_row", s.values["n"].text, s.values["word"].text).collect()
    assert s.df.rdd.getNumPartitions() > 20
    assert [tuple(r) for r in got] == [(i + 1, f"{i:06d}", f"Größe {i % 7}") for i in range(3000)]


@pytest.mark.parametrize("encoding", ["cp500", "cp1252", "shift_jis", "gbk"])
def test_csv_in_many_ranges(spark, tmp_path, monkeypatch, encoding):
    import csv
    import gzip
    import io

    rng = random.Random(4)
    word = "表" if encoding in ("shift_jis", "gbk") else "ä"
    rows = [[str(i), rng.choice([word, f'say "{word}"', f"{word},{word}", f"two\nlines {word}", "a\n\nb"]), rng.choice(["x", f"{word} y"])] for i in range(400)]
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator="\r\n").writerows([["id", word, "note"], *rows])
    p = tmp_path / "a.csv"
    p.write_bytes(out.getvalue().encode(encoding))
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(p.read_bytes()))
    for split, name in ((50, "a.csv"), (333, "a.csv"), (1 << 20, "a.csv"), (333, "b.csv.gz")):
        with monkeypatch.context() as m:
            m.setattr(readers.encoded, "lines", lambda *a, f=encoded.lines, **k: f(*a, **k, split_bytes=split))
            s = readers.read_csv(spark, str(tmp_path / name), encoding)
        assert s.names == ["id", word, "note"]
        got = [list(r)[1:] for r in s.df.select("_row", *(v.text for v in s.values.values())).orderBy("_row").collect()]
        assert got == rows, (split, name)


def test_files_of_a_folder_follow_each_other(spark, tmp_path):
    """Long ones are cut, short ones share a task, rows are numbered through all of them in order of path."""
    want = []
    for k in range(12):
        text = TEXTS["utf-16"] * (1 if k % 4 else 20)
        (tmp_path / f"part-{k:02d}.txt").write_bytes(text.encode("utf-16" if k % 2 else "utf-16-be") if k % 2 else b"\xfe\xff" + text.encode("utf-16-be"))
        want += text.splitlines()
    (tmp_path / "_SUCCESS").touch()
    (tmp_path / "part-99.txt").touch()
    got = encoded.lines(spark, str(tmp_path), "utf-16", split_bytes=900)
    assert read(got) == want
    assert 3 * 5 < got.rdd.getNumPartitions() < sum(-(-p.stat().st_size // 900) for p in tmp_path.iterdir())
    assert encoded.lines(spark, str(tmp_path), "utf-16", feeds_only=True) is None
    (tmp_path / "none").mkdir()
    assert read(encoded.lines(spark, str(tmp_path / "none"), "utf-16")) == []


@pytest.mark.parametrize("encoding", ["utf-16-le", "utf-16", "cp500", "iso2022_jp"])
def test_empty_files_come_first(spark, tmp_path, encoding):
    """An empty file has no lines, alone or before others, and so have several."""
    (tmp_path / "part-00.txt").touch()
    alone = encoded.lines(spark, str(tmp_path / "part-00.txt"), encoding)
    assert read(alone) == [] and alone.rdd.getNumPartitions() == 1
    assert read(encoded.lines(spark, str(tmp_path), encoding)) == []
    (tmp_path / "part-01.txt").touch()
    (tmp_path / "part-02.txt").write_bytes(TEXTS[encoding].encode(encoding))
    (tmp_path / "part-03.txt").touch()
    for split in (7, 64, 1 << 20):
        assert read(encoded.lines(spark, str(tmp_path), encoding, split_bytes=split)) == TEXTS[encoding].splitlines(), split


def test_a_first_split_without_rows(spark, tmp_path):
    """Of a table in one row group the first task may get no rows; the file that it writes is empty."""
    from harborline.queries import QUERIES

    orders = spark.range(3000).selectExpr("id AS o_orderkey", "'F' AS o_orderstatus", "sha2(string(id), 256) AS o_orderpriority", "double(id) AS o_totalprice")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    small = {"spark.sql.files.maxPartitionBytes": "20k", "spark.sql.files.openCostInBytes": "1k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        splits = spark.read.parquet(str(tmp_path / "orders.parquet")).rdd.glom().map(len).collect()
        got = QUERIES["encoded_scan"](spark, str(tmp_path)).collect()
    finally:
        for k in small:
            spark.conf.unset(k)
    assert splits[0] == 0 and sum(splits) == 3000
    assert {r["key"]: r["price"] for r in got} == {k: float(k) if k % 3 else None for k in range(3000)} and len(got) == 3000
    assert {r["text"][:7] for r in got} == {'\u0a0a "F",\n'}
