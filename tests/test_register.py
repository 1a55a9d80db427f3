"""Registration as joins: listings, hashes, what is loaded and manifests."""

import hashlib
import json
import os

import pytest

from harborline.plans import manifest
from harborline.plans.audit import Audit
from harborline.plans.config import parse
from harborline.plans.register import found, register
from harborline.sources import files

CONFIG = {"format": "csv", "dest_table": "t", "columns": [{"source": "a", "dest": "a", "type": "string"}]}


def put(folder, name, text, age=100):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    t = os.path.getmtime(folder / name) - age
    os.utime(folder / name, (t, t))


def hashes(spark, index, folder):
    return {r["name"]: r["content_hash"] for r in index.hashes(files.listing(spark, str(folder))).collect()}


def test_listing_is_that_of_the_driver(spark, tmp_path):
    for n in ("a.csv", "b 1%.csv", ".hidden", "_meta", "c.csv.tmp", "a.csv.manifest.json", "d.CSV", "é.csv"):
        put(tmp_path / "in", n, n)
    (tmp_path / "in" / "sub=1").mkdir()
    put(tmp_path / "in" / "sub=1", "x.csv", "x")
    for pattern in (None, "*.csv", "[!a]*.csv", "?.csv"):
        assert sorted((r["path"], r["size"]) for r in files.listing(spark, str(tmp_path / "in"), pattern).collect()) == files.list_files(spark, str(tmp_path / "in"), pattern)
    (tmp_path / "none").mkdir()
    assert files.listing(spark, str(tmp_path / "none")).count() == 0


def test_unchanged_files_are_not_read_again(spark, tmp_path):
    folder, index = tmp_path / "in", files.Index(spark, str(tmp_path / "index"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    put(folder, "a.csv", "one")
    put(folder, "b.csv", "two")
    assert hashes(spark, index, folder) == {"a.csv": sha("one"), "b.csv": sha("two")}
    t = os.path.getmtime(folder / "a.csv")
    (folder / "a.csv").write_text("ONE")  # other bytes under the same size and time: not looked at
    os.utime(folder / "a.csv", (t, t))
    put(folder, "b.csv", "two!", 50)
    put(folder, "c.csv", "young", 0)
    assert hashes(spark, index, folder) == {"a.csv": sha("one"), "b.csv": sha("two!"), "c.csv": sha("young")}
    t = os.path.getmtime(folder / "c.csv")
    (folder / "c.csv").write_text("YOUNG")
    os.utime(folder / "c.csv", (t, t))
    assert hashes(spark, index, folder)["c.csv"] == sha("YOUNG")  # it was too young to be sure of


def test_loaded_content_does_not_come_to_the_driver(spark, tmp_path):
    folder, index, audit = tmp_path / "in", files.Index(spark, str(tmp_path / "index")), Audit(":memory:")
    for n in "abc":
        put(folder, f"{n}.csv", f"a\n{n}\n")
    first = register(spark, audit, str(folder), parse(CONFIG), index)
    assert first.new == 3 and [c.name for c in first.candidates] == ["a.csv", "b.csv", "c.csv"]
    for c in first.candidates[:2]:
        audit.claim(c.content_hash, "w", "r")
        audit.committed(c.content_hash, 1)
    put(folder, "copy of a.csv", "a\na\n")
    assert [c.name for c in register(spark, audit, str(folder), parse(CONFIG), index).candidates] == ["c.csv"]
    assert [r["name"] for r in found(spark, str(folder), parse(CONFIG), index, audit.epoch()).collect()] == ["c.csv"]
    assert [c.name for c in register(spark, audit, str(folder), parse(CONFIG)).candidates] == ["c.csv"]
    audit.db.execute("DELETE FROM etl_file_audit WHERE filename = 'b.csv'")  # by hand: nothing noted before holds any more
    assert [c.name for c in register(spark, audit, str(folder), parse(CONFIG), index).candidates] == ["b.csv", "c.csv"]
    assert len(register(spark, Audit(":memory:"), str(folder), parse(CONFIG), index).candidates) == 4  # another audit store


GOOD = {"job": {"namespace": "n", "name": "m"}, "run": {"runId": "r"}, "producer": "p"}
SIDES = {
    "good": json.dumps(GOOD), "missing": None, "malformed_json": "{", "invalid_shape": "[]", "missing_required_field": '{"job": {}}',
    "unsupported_version": json.dumps(GOOD | {"manifest_version": "9"}), "invalid_source_range": json.dumps(GOOD | {"source_range": 5}),
}


def test_manifests_by_category(spark, tmp_path):
    for n, side in SIDES.items():
        put(tmp_path / "in", f"{n}.csv", n)
        if side is not None:
            put(tmp_path / "in", f"{n}.csv{manifest.SUFFIX}", side)
    (tmp_path / "in" / f"bytes.csv{manifest.SUFFIX}").write_bytes(b"\xff")
    put(tmp_path / "in", "bytes.csv", "b")
    got = {r["name"][:-4]: r for r in found(spark, str(tmp_path / "in"), parse(CONFIG | {"source_manifest": "optional"})).collect()}
    assert {n: r["category"] for n, r in got.items()} == {n: None if n == "good" else n for n in SIDES} | {"bytes": "malformed_json"}
    assert got["good"]["manifest"]["name"] == "m" and got["good"]["manifest"]["payload"]


@pytest.mark.parametrize("policy,candidates", [("disabled", 7), ("optional", 7), ("required", 1)])
def test_policies(spark, tmp_path, policy, candidates):
    for n, side in SIDES.items():
        put(tmp_path / "in", f"{n}.csv", n)
        if side is not None:
            put(tmp_path / "in", f"{n}.csv{manifest.SUFFIX}", side)
    audit = Audit(":memory:")
    got = register(spark, audit, str(tmp_path / "in"), parse(CONFIG | {"source_manifest": policy}))
    assert (len(got.candidates), len(got.refused), got.new) == (candidates, 7 - candidates, 7)
    record = audit.lookup("good.csv")[0]
    assert record["source_name"] == (None if policy == "disabled" else "n/m") and (policy != "required" or "missing" in audit.lookup("missing.csv")[0]["error_message"])
