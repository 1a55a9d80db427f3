import io
import json
from datetime import UTC, datetime

import pytest

from harborline.plans import authoring, cli, registry, trace
from harborline.plans.config import ConfigError
from harborline.plans.registry import RegistryError

AT = datetime(2024, 5, 1, 12, tzinfo=UTC)


@pytest.fixture
def sample(tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text("id,name,paid\n1,ann,true\n2,,false\n3,cem,true\n")
    return str(path)


def test_draft_from_a_sample(spark, sample):
    draft = authoring.from_sample(spark, sample, "orders", "csv")
    assert [(c["source"], c["type"], c["required"]) for c in draft.raw["columns"]] == [("id", "integer", True), ("name", "string", True), ("paid", "boolean", True)]
    assert [e.name for e in draft.unsure()] == ["name"]
    assert draft.acknowledge("name").unsure() == []
    with pytest.raises(ConfigError):
        draft.acknowledge("nobody")
    with pytest.raises(ConfigError):
        authoring.from_sample(spark, sample, "orders", "fixed_width")


def test_edits_leave_the_draft_before_as_it_was(spark, sample):
    first = authoring.from_sample(spark, sample, "orders", "csv")
    token = {"algorithm": "hmac-sha256", "key": "env:TOKEN"}
    then = first.edit("name", required=False).repeat("name", "name_token").edit("name_token", hash=token).connect("sqlite", path="x.db", more="")
    assert first.config().columns[1].required and not then.config().columns[1].required
    assert [(c.source, c.dest, c.hash is not None) for c in then.config().columns][1::2] == [("name", "name", False), ("name", "name_token", True)]
    assert then.raw["connector"] == {"type": "sqlite", "path": "x.db"}
    assert then.edit("name_token", hash=None).config().columns[3].hash is None
    assert [c.dest for c in then.drop("name").config().columns] == ["id", "paid", "name_token"]
    cdc = then.write("cdc", ["id"], "id")
    assert cdc.config().cdc.keys == ("id",) and cdc.write("append").config().cdc is None
    for refused in (lambda: first.edit("id", type="money"), lambda: first.edit("id", dest="name"), lambda: first.repeat("id", "paid"), lambda: first.edit("x", required=True), lambda: first.write("merge"), lambda: first.connect("tape"), lambda: first.write("cdc").config()):
        with pytest.raises(ConfigError):
            refused()


def test_layout_drafts_are_checked():
    columns = [{"source": "a", "type": "string", "start": 1, "width": 3}, {"source": "b", "type": "integer", "start": 4, "width": 2}]
    assert [c.dest for c in authoring.from_layout("t", columns).config().columns] == ["a", "b"]
    with pytest.raises(ConfigError):
        authoring.from_layout("t", [columns[0], columns[1] | {"start": 3}])


def test_report_of_all_areas(spark, sample):
    draft = authoring.from_sample(spark, sample, "orders", "csv")
    report = authoring.examine(spark, sample, draft.raw)
    assert {f.area for f in report.findings} == set(authoring.AREAS)
    assert not report.ok and (report.rows, report.failing_cells) == (3, 1)
    assert [(f.row, f.column) for f in report.of("strict")] == [(2, "name")]
    assert [(d["column"], d["kind"], d["rows"], d["first_rows"]) for d in report.drift] == [("name", "required_null", 1, [2])]
    assert authoring.examine(spark, sample, draft.raw, rows=1).ok
    assert authoring.examine(spark, sample, draft.edit("name", required=False).config()).ok


def test_report_says_what_is_wrong_where(spark, sample, tmp_path):
    draft = authoring.from_sample(spark, sample, "orders", "csv")
    broken = authoring.examine(spark, sample, draft.raw | {"format": "tape"})
    assert [(f.area, f.ok) for f in broken.findings] == [("config", False)]
    assert not authoring.examine(spark, sample, {"columns": 3, "format": "csv", "dest_table": "t"}).ok
    absent = authoring.examine(spark, str(tmp_path / "none.csv"), draft.raw)
    assert [f.area for f in absent.findings if not f.ok] == ["parser"]
    lost = authoring.examine(spark, sample, draft.edit("paid", source="settled").raw)
    assert [f.column for f in lost.of("tolerance")] == ["settled"]
    twice = draft.raw | {"columns": [*draft.raw["columns"], draft.raw["columns"][0]]}
    assert not authoring.examine(spark, sample, twice).of("write_mode")[0].ok
    all_bad = authoring.examine(spark, sample, draft.edit("name", type="integer").edit("paid", type="date").raw, shown=2)
    assert all_bad.failing_cells == 6 and len(all_bad.of("strict")) == 3
    cdc = authoring.examine(spark, sample, draft.write("cdc", ["id"], "id").raw)
    assert "operation" in [f.column for f in cdc.of("tolerance")]


def test_json_that_does_not_parse_is_a_finding(spark, tmp_path):
    path = tmp_path / "a.ndjson"
    path.write_text('{"a": 1}\n{"a": \n')
    raw = {"format": "ndjson", "dest_table": "t", "columns": [{"source": "a", "dest": "a", "type": "integer"}]}
    report = authoring.examine(spark, str(path), raw)
    assert [(f.area, f.row) for f in report.findings if not f.ok] == [("parser", 2)]


def test_save_list_and_reopen(spark, sample, tmp_path, monkeypatch):
    space = tmp_path / "space"
    draft = authoring.from_sample(spark, sample, "Daily Orders", "csv")
    with pytest.raises(ConfigError):
        authoring.save(space, draft, sample)
    draft = draft.acknowledge("name").edit("name", required=False)
    folder = authoring.save(space, draft, sample, at=AT)
    assert folder == space / "pipelines" / "daily-orders" and (folder / "incoming").is_dir()
    with pytest.raises(RegistryError):
        authoring.save(space, draft, sample)
    assert [(r.id, r.format, r.authored, r.problem) for r in registry.browse(space / registry.FILE)] == [("daily-orders", "csv", AT.isoformat(timespec="seconds"), None)]
    again = authoring.reopen(folder / "pipeline.yaml")
    assert again.config() == draft.config()
    authoring.save(space, again.edit("paid", required=False), sample, name="daily-orders", overwrite=True, at=AT)
    assert not authoring.reopen(folder / "pipeline.yaml").config().columns[2].required
    monkeypatch.setenv("DAILY_ORDERS_AUDIT_DB", str(tmp_path / "audit.db"))
    assert list(registry.load(space / registry.FILE)) == ["daily-orders"]
    with pytest.raises(RegistryError):
        registry.add(space / registry.FILE, {"id": "other", "dir": "x", "config": "y", "audit_db": "${DAILY_ORDERS_AUDIT_DB}"})


def test_browse_lists_what_is_broken(tmp_path):
    for name, text in (("a", "format: csv\nconnector: {type: sqlite}\n"), ("b", "{"), ("c", "- 1\n"), ("d", "format: csv\n")):
        registry.create(tmp_path / "pipelines", name, text)
        if name != "d":
            registry.add(tmp_path / registry.FILE, {"id": name, "dir": name, "config": f"pipelines/{name}/pipeline.yaml", "audit_db": name})
    registry.add(tmp_path / registry.FILE, {"id": "gone", "dir": "g", "config": "pipelines/gone/pipeline.yaml", "audit_db": "g"})
    rows = registry.browse(tmp_path / registry.FILE)
    assert [(r.id, r.connector, r.problem is None) for r in rows] == [("a", "sqlite", True), ("b", None, False), ("c", None, False), ("gone", None, False)]
    assert registry.discover(tmp_path) == ["pipelines/d/pipeline.yaml"]
    with pytest.raises(RegistryError):
        registry.browse(tmp_path / "none.yaml")


def test_spans_of_a_run():
    out, passed, now = io.StringIO(), [], iter(range(100))
    tell = trace.tracer(out, passed.append, lambda: next(now))
    events = [("load", "start", "a"), ("load", "committed", "a"), ("load", "start", "b"), ("load", "failed", "b"), ("load", "start", "c")]
    for phase, action, path in events:
        tell({"phase": phase, "action": action, "path": path})
    tell({"phase": "run", "action": "done", "failed": 1})
    a, b, run = map(json.loads, out.getvalue().splitlines())
    assert len(passed) == 6 and {a["traceId"], b["traceId"]} == {run["traceId"]}
    assert a["parentSpanId"] == b["parentSpanId"] == run["spanId"] and run["parentSpanId"] is None
    assert [x["status"] for x in (a, b, run)] == ["OK", "ERROR", "ERROR"] and run["attributes"]["unended"] == 1
    assert run["startTimeUnixNano"] < a["startTimeUnixNano"] < a["endTimeUnixNano"] < run["endTimeUnixNano"]


def test_commands(spark, sample, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    space = tmp_path / "space"
    assert cli.main(["draft", "--file", sample, "--table", "orders", "--workspace", str(space), "--acknowledge", "name"]) == 0
    config = space / "pipelines" / "orders" / "pipeline.yaml"
    capsys.readouterr()
    assert cli.main(["report", "--file", sample, "--config", str(config)]) == 1
    assert json.loads(capsys.readouterr().out)["failing_cells"] == 1
    assert cli.main(["browse", "--workspace", str(space)]) == 0
    assert json.loads(capsys.readouterr().out)["pipelines"][0]["id"] == "orders"
    spans = tmp_path / "spans.jsonl"
    (space / "pipelines" / "orders" / "incoming" / "o.csv").write_text("id,name,paid\n1,ann,true\n")
    assert cli.main(["run", "--dir", str(space / "pipelines" / "orders" / "incoming"), "--config", str(config), "--audit-db", str(tmp_path / "a.db"), "--warehouse", str(tmp_path / "wh"), "--trace", str(spans)]) == 0
    assert [json.loads(x)["name"] for x in spans.read_text().splitlines()] == ["load", "run"]
