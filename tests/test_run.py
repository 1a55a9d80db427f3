import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from harborline.operators import quarantine
from harborline.operators.store import CommitConflict, Table
from harborline.plans import export
from harborline.plans.audit import Audit
from harborline.plans.config import parse
from harborline.plans.run import health, run

ORDERS = {"format": "csv", "dest_table": "orders", "columns": [{"source": "id", "dest": "id", "type": "string"}, {"source": "amount", "dest": "amount", "type": "float"}, {"source": "day", "dest": "day", "type": "date", "required": False}]}


@pytest.fixture
def place(tmp_path, spark):
    (tmp_path / "in").mkdir()

    class Place:
        dir, warehouse = str(tmp_path / "in"), str(tmp_path / "wh")
        audit = Audit(str(tmp_path / "audit.db"))
        root = tmp_path

        def put(self, name, text):
            (tmp_path / "in" / name).write_text(text)

        def run(self, **change):
            return run(spark, self.dir, parse(ORDERS | change), self.audit, self.warehouse)

        def rows(self, name="orders"):
            return sorted(tuple(r)[:3] for r in Table(spark, f"{self.warehouse}/{name}").read().collect())

    return Place()


def test_append_is_idempotent_and_atomic(place, spark):
    place.put("a.csv", "id,amount,day\n1,1.5,2024-01-01\n2,2,\n")
    place.put("b.csv", "id,amount,day\n3,3,\n4,oops,\n")
    got = place.run()
    assert (got.committed, got.failed, got.new, got.rows) == (1, 1, 2, 2)
    assert place.rows() == [("1", 1.5, dt.date(2024, 1, 1)), ("2", 2.0, None)]
    assert "row 2: Cannot coerce 'amount'='oops' to float" in [r["error_message"] for r in place.audit.lookup("b.csv")]
    again = place.run()
    assert (again.committed, again.retried, again.failed) == (0, 1, 1) and len(place.rows()) == 2
    place.run()
    assert place.run().skipped == 1  # three attempts are the cap


def test_rename_is_known_and_rerun_after_crash(place):
    place.put("a.csv", "id,amount,day\n1,1,\n")
    place.run()
    place.put("renamed.csv", "id,amount,day\n1,1,\n")
    assert place.run().committed == 0
    # a crash between the commit and its record
    h = place.audit.lookup("a.csv")[0]["content_hash"]
    place.audit._set("content_hash = ?", (h,), state="PROCESSING", claimed_at="2020-01-01T00:00:00+00:00")
    got = place.run()
    assert got.reclaimed == 1 and got.committed == 1 and place.rows() == [("1", 1.0, None)]


def test_two_equal_files_load_once(place):
    place.put("a.csv", "id,amount,day\n1,1,\n")
    place.put("b.csv", "id,amount,day\n1,1,\n")
    got = place.run()
    assert got.committed == 1 and len(place.rows()) == 1


def test_truncate_last_file_wins(place):
    place.put("a.csv", "id,amount,day\n1,1,\n")
    place.put("b.csv", "id,amount,day\n2,2,\n")
    place.run(write_mode="truncate")
    assert place.rows() == [("2", 2.0, None)]


def test_quarantine(place, spark):
    place.put("a.csv", "id,amount,day\n1,1,\n,2,\n3,x,\n4,4,\n")
    q = {"enabled": True, "dir": str(place.root / "q"), "max_invalid_fraction": 0.5}
    got = place.run(quarantine=q)
    assert (got.committed, got.rows, got.quarantined) == (1, 2, 2)
    side = next((place.root / "q").glob("*.quarantine.ndjson"))
    lines = [json.loads(x) for x in side.read_text().splitlines()]
    assert [(x["row_number"], x["column"]) for x in lines] == [(2, "id"), (3, "amount")] and lines[1]["row"] == {"id": "3", "amount": "x", "day": None}
    assert [json.loads(r["value"]) for r in quarantine.redrop(spark, str(side)).collect()][1] == {"id": "3", "amount": "x", "day": None}
    assert quarantine.triage(spark, str(place.root / "q")).groupBy("column").count().count() == 2
    place.put("b.csv", "id,amount,day\n1,1,\n,2,\n3,x,\n")
    assert place.run(quarantine=q).failed == 1


def test_redrop_fails_whole(spark, tmp_path):
    (tmp_path / "s.ndjson").write_text('{"row": {"a": 1}}\n{"row": 5}\n')
    with pytest.raises(Exception, match="not a quarantined row"):
        quarantine.redrop(spark, str(tmp_path / "s.ndjson")).collect()


CDC = {"write_mode": "cdc", "cdc": {"keys": ["id"], "operation_column": "op", "sequence_by": "amount", "operations": {"insert": ["I"], "update": ["U"], "delete": ["D"]}}}


def test_cdc(place):
    place.put("a.csv", "op,id,amount,day\nI,1,1,\nI,2,1,\nU,1,3,2024-01-01\nU,1,2,\n")
    place.put("b.csv", "op,id,amount,day\nD,2,2,\nI,3,1,\n")
    assert place.run(**CDC).committed == 2
    assert place.rows() == [("1", 3.0, dt.date(2024, 1, 1)), ("3", 1.0, None)]


@pytest.mark.parametrize("order,ok", [([1, 2, 1], True), ([2, 1, 1], True), ([1, 1, 2], False), ([1, 2, 2], False)])
def test_cdc_ties(place, order, ok):
    place.put("a.csv", "op,id,amount,day\n" + "".join(f"U,k,{n},\n" for n in order))
    assert place.run(**CDC).committed == int(ok)


@pytest.mark.parametrize("line", ["X,1,1,", "I,,1,", "i,1,1,"])
def test_cdc_bad_rows(place, line):
    place.put("a.csv", f"op,id,amount,day\n{line}\n")
    assert place.run(**CDC).failed == 1


def test_required_manifest(place):
    place.put("a.csv", "id,amount,day\n1,1,\n")
    assert place.run(source_manifest="required").failed == 1
    place.put("a.csv.manifest.json", json.dumps({"job": {"namespace": "n", "name": "m"}, "run": {"runId": "r"}, "producer": "p"}))
    assert place.run(source_manifest="required").committed == 1


def test_crypto(place, spark, monkeypatch):
    import base64
    import hashlib
    import hmac

    from harborline.functions.crypto import decrypt
    from pyspark.sql import functions as F

    key = bytes(range(32))
    place.put("a.csv", "id,amount,day\nsecret,1,\n")
    columns = [{"source": "id", "dest": "cipher", "type": "string", "encrypt": {"algorithm": "aes-256-gcm", "key": "env:K1"}}, {"source": "id", "dest": "token", "type": "string", "hash": {"algorithm": "hmac-sha256", "key": "env:K1"}}]
    assert place.run(columns=columns).failed == 1  # no key, nothing written
    monkeypatch.setenv("K1", base64.b64encode(key).decode())
    assert place.run(columns=columns).committed == 1
    r = Table(spark, f"{place.warehouse}/orders").read().select("token", decrypt(F.col("cipher"), key).alias("plain"), "cipher").first()
    raw = base64.b64decode(r["cipher"])
    assert r["plain"] == "secret" and raw[0] == 1 and len(raw) == 1 + 12 + 16 + 6
    assert r["token"] == base64.b64encode(hmac.new(key, b"secret", hashlib.sha256).digest()).decode()


def test_schema_mismatch_is_refused(place):
    place.put("a.csv", "id,amount,day\n1,1,\n")
    place.run()
    with pytest.raises(ValueError, match="type_mismatch"):
        place.run(columns=[ORDERS["columns"][0], {"source": "amount", "dest": "amount", "type": "string"}, ORDERS["columns"][2]])


def test_empty_file_clears_its_part(place, spark):
    t = Table(spark, f"{place.warehouse}/orders")
    place.put("a.csv", "id,amount,day\n")
    assert place.run().committed == 1 and t.read().count() == 0


def test_stale_commit_is_refused(place, spark):
    place.put("a.csv", "id,amount,day\n1,1,\n")
    place.run()
    t = Table(spark, f"{place.warehouse}/orders")
    old = t.state()
    t._commit(t.state(), t.state())
    with pytest.raises(CommitConflict):
        t._commit(old, old)


def test_read_models_and_requeue(place, spark):
    place.put("a.csv", "id,amount,day\n1,x,\n")
    place.put("b.csv", "id,amount,day\n1,1,\n")
    place.run(retry_cap=1)
    s = export.status(spark, place.audit)
    assert s["by_state"] == {"PENDING": 0, "PROCESSING": 0, "COMMITTED": 1, "FAILED": 1} and len(s["recent_failures"]) == 1
    assert place.audit.lineage("a.csv")[0] == "found" and place.audit.lineage("zz")[0] == "missing"
    assert place.audit.requeue("b.csv", 1)[0] == "not_terminal"
    assert place.audit.requeue("a.csv", 1)[0] == "requeued"
    assert place.audit.get(place.audit.lookup("a.csv")[0]["content_hash"])["attempt_count"] == 0
    assert "a.csv" in export.page(spark, place.audit)
    assert all(x["ok"] for x in health(spark, place.audit).values())
    assert "error" in export.status_all(spark, {"bad": "/nonexistent/x.db"})["bad"]


def test_claim_is_exclusive(place):
    place.audit.insert_pending("f", "h")
    assert place.audit.claim("h", "w1", "r") and not place.audit.claim("h", "w2", "r")
    assert not place.audit.insert_pending("g", "h")


def test_sidecars_of_a_long_file_are_parts(place, spark, monkeypatch):
    monkeypatch.setattr(quarantine.stage_sidecars, "__defaults__", (3,))
    place.put("a.csv", "id,amount,day\n" + "".join(f"{i},{'x' if i % 2 else i},\n" for i in range(8)))
    got = place.run(quarantine={"enabled": True, "dir": str(place.root / "q"), "max_invalid_fraction": 0.5})
    assert (got.committed, got.rows, got.quarantined) == (1, 4, 4)
    sides = sorted((place.root / "q").iterdir())
    assert [x.name.split(".")[2] for x in sides] == ["00000", "00001", "00002"]
    assert [[json.loads(x)["row_number"] for x in s.read_text().splitlines()] for s in sides] == [[2], [4, 6], [8]]
    path = place.audit.lookup("a.csv")[0]["quarantine_path"]
    assert "*" in path and quarantine.redrop(spark, path).count() == 4


def test_a_failed_load_leaves_no_sidecar(place, monkeypatch):
    place.put("a.csv", "id,amount,day\n1,1,\n2,x,\n")

    def fail(*_):
        raise RuntimeError("no room")

    monkeypatch.setattr(Table, "append", fail)
    assert place.run(quarantine={"enabled": True, "dir": str(place.root / "q"), "max_invalid_fraction": 0.5}).failed == 1
    assert not list((place.root / "q").iterdir())


def test_parts_of_a_sidecar_are_triaged_as_one(spark, tmp_path):
    bad = spark.createDataFrame([(n, "id", "no number", '{"id":"x"}') for n in (1, 2, 5, 9)], "row_number long, column string, error string, row string")
    for name, rows in (("a.csv", 9), ("b.12345.csv", 3)):  # three rows a part: the first has parts 0, 1 and 2, the second is one file
        job, named, _ = quarantine.stage_sidecars(bad.where(F.col("row_number") <= rows), str(tmp_path), name, "0123456789ab" + "c" * 52, rows, part_rows=3)
        assert len(job.publish(named)) == (3 if rows == 9 else 1)
    got = quarantine.triage(spark, str(tmp_path)).groupBy("file").agg(F.count("*"), F.min("row_number")).collect()
    assert sorted(map(tuple, got)) == [("a.0123456789ab.quarantine.ndjson", 4, 1), ("b.12345.0123456789ab.quarantine.ndjson", 2, 1)]
