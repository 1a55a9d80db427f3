"""The file store and compaction lose nothing: appends and merges in turn, two runs at one moment, crashes."""

import datetime as dt
import os
import time

import pytest

from harborline.operators import compact, schema
from harborline.operators.cdc import OPERATION
from harborline.operators.store import CommitConflict, Table, with_provenance
from harborline.plans.config import Column


@pytest.fixture
def table(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), buckets=8)
    t.ensure(schema.declared((Column("k", "k", "integer"), Column("v", "v", "string"))))
    return t


def rows_of(table):
    return sorted((r["k"], r["v"]) for r in table.read().collect())


def put(spark, table, name, rows):
    return table.append(with_provenance(spark.createDataFrame(rows, "k long, v string"), name, "2024-01-01"), name)


def change(spark, table, name, rows):
    df = spark.createDataFrame(rows, f"k long, v string, {OPERATION} string")
    return table.apply(with_provenance(df, name, "2024-01-01"), ["k"], name)


def test_merges_and_appends_in_turn(spark, table):
    change(spark, table, "c1", [(1, "a", "insert"), (2, "b", "insert")])
    put(spark, table, "f1", [(3, "c")])
    assert rows_of(table) == [(1, "a"), (2, "b"), (3, "c")]
    change(spark, table, "c2", [(3, "C", "update"), (1, None, "delete")])
    assert rows_of(table) == [(2, "b"), (3, "C")]
    put(spark, table, "f2", [(4, "d"), (5, "e")])
    assert not change(spark, table, "c2", [(2, "x", "update")])
    change(spark, table, "c3", [(9, "z", "insert")])
    put(spark, table, "f2", [(4, "D")])  # once more, after its rows went into buckets: they are replaced
    assert rows_of(table) == [(2, "b"), (3, "C"), (4, "D"), (9, "z")]
    assert [tuple(r)[:2] for r in table.read("f2").collect()] == [(4, "D")] and [r["k"] for r in table.read("c3").collect()] == [9]
    table.truncate(with_provenance(spark.createDataFrame([(7, "g")], "k long, v string"), "f3", "2024-01-01"), "f3")
    assert rows_of(table) == [(7, "g")]
    assert not change(spark, table, "c3", [(9, "z", "insert")])


def test_a_merge_rewrites_its_buckets_alone(spark, table):
    change(spark, table, "c1", [(i, str(i), "insert") for i in range(200)])
    before = table.state().buckets
    assert len(before) == 8
    change(spark, table, "c2", [(5, "five", "update")])
    after = table.state().buckets
    assert sum(before[k] != after[k] for k in before) == 1 and ("five" in dict(rows_of(table)).values())
    change(spark, table, "c3", [(i, None, "delete") for i in range(200)])
    assert rows_of(table) == [] and table.state().buckets == {}
    change(spark, table, "c4", [(1, "again", "insert")])
    assert rows_of(table) == [(1, "again")]


def test_other_keys_deal_all_rows_anew(spark, table):
    change(spark, table, "c1", [(i, "x", "insert") for i in range(20)])
    df = spark.createDataFrame([(77, "x", "update")], f"k long, v string, {OPERATION} string")
    table.apply(with_provenance(df, "c2", "2024-01-01"), ["v"], "c2")
    assert rows_of(table) == [(77, "x")] and table.state().keys == ["v"]


def test_rows_with_null_keys_and_tables_without_buckets(spark, table):
    put(spark, table, "f", [(None, "n"), (1, "a")])
    state = table.state()
    table._commit(state, state.copy(parts={}, base=state.parts["f"]))  # as tables were before they had buckets
    change(spark, table, "c", [(1, "b", "update")])
    assert sorted(map(tuple, table.read().select("k", "v").collect()), key=repr) == [(1, "b"), (None, "n")] and table.state().base == ""


def test_vacuum_keeps_what_is_read(spark, table):
    for i in range(3):
        change(spark, table, f"c{i}", [(j, f"{i}{j}", "update") for j in range(0, 40, i + 1)])
        put(spark, table, "f", [(100, str(i))])
    want = rows_of(table)
    assert table.vacuum() == 0 and table.vacuum(0) > 0 and rows_of(table) == want and table.vacuum(0) == 0


def test_lock_is_renewed_and_its_loss_noticed(spark, tmp_path, table):
    slow = Table(spark, table.path, stale_lock_s=0.4)
    with slow.lock():
        time.sleep(1.2)
        assert time.time() - os.path.getmtime(tmp_path / "t" / "_lock") < 0.4
        state = slow.state()
        (tmp_path / "t" / "_lock").write_text("another")
        (tmp_path / "t" / "._lock.crc").unlink(missing_ok=True)
        with pytest.raises(CommitConflict, match="lost"):
            slow._commit(state, state.copy())
    assert (tmp_path / "t" / "_lock").read_text() == "another"


def lines_of(folder):
    return sorted(x for p in folder.glob("*.ndjson") for x in p.read_text().splitlines())


@pytest.mark.parametrize("delete", [False, True])
def test_two_compactions_at_one_moment(spark, tmp_path, delete):
    src, out, now = tmp_path / "src", tmp_path / "out", dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    src.mkdir()
    for part in (0, 1):
        for i in range(3):
            (src / f"p{part}{i}.ndjson").write_text(f'{{"i": {part * 3 + i}}}\n')
        assert compact.compact(spark, str(src), str(out), 2, delete_source=delete, now=now) == {"batches": 2, "files_compacted": 3}
    assert lines_of(out) == [f'{{"i": {i}}}' for i in range(6)] and len(list(out.iterdir())) == 4
    assert len(list(src.glob("*.ndjson"))) == (0 if delete else 6)
    (src / "p00.ndjson").write_text('{"i": "another file of that name"}\n')
    assert compact.compact(spark, str(src), str(out), 2, now=now)["files_compacted"] == 1


def test_crash_between_the_batch_and_deletion(spark, tmp_path, monkeypatch):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    (src / compact.MANIFESTS).mkdir()
    out.mkdir()
    for i in range(3):
        (src / f"{i}.ndjson").write_text(f'{{"i": {i}}}\n')
    # what a task leaves that stops after its batch has its name: the first source gone, the others not
    compact._write_batch([str(src / f"{i}.ndjson") for i in range(3)], str(out / "b.ndjson"), str(src / compact.MANIFESTS / "b.json"), False, True)
    (src / "0.ndjson").unlink()
    (src / "3.ndjson").write_text('{"i": 3}\n')
    assert compact.compact(spark, str(src), str(out), 10, delete_source=True)["files_compacted"] == 1
    assert lines_of(out) == [f'{{"i": {i}}}' for i in range(4)] and not list(src.glob("*.ndjson")) and not list((src / compact.MANIFESTS).iterdir())


def test_a_batch_never_replaces_a_file(tmp_path):
    (tmp_path / "a.ndjson").write_text('{"a": 1}\n')
    (tmp_path / "b.ndjson").write_text("here before\n")
    with pytest.raises(FileExistsError):
        compact._write_batch([str(tmp_path / "a.ndjson")], str(tmp_path / "b.ndjson"), str(tmp_path / "m.json"), False, False)
    assert (tmp_path / "b.ndjson").read_text() == "here before\n" and not (tmp_path / "m.json").exists() and not list(tmp_path.glob("*.tmp"))
