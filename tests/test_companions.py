import json

import pytest

from harborline.plans import cli, manifest, registry
from harborline.plans.config import ConfigError
from harborline.sources import fetch, promote
from harborline.streaming import materialize


def pages(*bodies):
    calls = []

    def transport(url, params, headers):
        calls.append(params)
        body = bodies[min(len(calls) - 1, len(bodies) - 1)]
        return body if isinstance(body, fetch.Response) else fetch.Response(200, body)

    transport.calls = calls
    return transport


def test_numbered_pages():
    s = fetch.parse_source({"name": "s", "url": "u", "page_size": 2, "cursor_param": "since", "cursor_field": "t"})
    t = pages([{"t": "1"}, {"t": "3"}], [{"t": "2"}])
    assert fetch.fetch(s, t, "0") == ([{"t": "1"}, {"t": "3"}, {"t": "2"}], "3")
    assert t.calls == [{"page": 1, "per_page": 2, "since": "0"}, {"page": 2, "per_page": 2, "since": "0"}]


def test_client_side_cursor_compares_text():
    s = fetch.parse_source({"name": "s", "url": "u", "records_path": "d.x", "cursor_field": "m.t"})
    body = {"d": {"x": [{"m": {"t": 9}}, {"m": {"t": 10}}, {}]}}
    assert fetch.fetch(s, pages(body), "5") == ([{"m": {"t": 9}}], "9")
    assert len(fetch.fetch(s, pages(body))[0]) == 3 and fetch.fetch(s, pages({}))[0] == []


def test_rate_limits():
    slept = []
    s = fetch.parse_source({"name": "s", "url": "u"})
    t = pages(fetch.Response(429, None, {"Retry-After": "7"}), [{"a": 1}])
    assert fetch.fetch(s, t, None, slept.append)[0] == [{"a": 1}] and slept == [7.0]
    with pytest.raises(fetch.FetchError):
        fetch.fetch(s, pages(fetch.Response(500, None)), None, slept.append)
    with pytest.raises(ConfigError):
        fetch.parse_source({"name": "x", "kind": "ftp"})


def test_lock_and_failed_staging(tmp_path):
    with promote.source_lock(tmp_path, "s"), pytest.raises(promote.Locked), promote.source_lock(tmp_path, "s"):
        pass

    def lines():
        yield "a"
        raise RuntimeError

    with pytest.raises(RuntimeError):
        promote.write_staged(tmp_path, "f.ndjson", lines())
    assert not list(tmp_path.glob("f*"))


@pytest.mark.parametrize("text,category", [("{", "malformed_json"), ("[]", "invalid_shape"), ('{"job": {}}', "missing_required_field"), ('{"manifest_version": "9", "job": {"namespace": "n", "name": "m"}}', "unsupported_version")])
def test_manifests_are_refused_by_category(text, category):
    with pytest.raises(manifest.ManifestError) as e:
        manifest.parse(text)
    assert e.value.category == category


def _plan(tmp_path, **more):
    return materialize.parse_plan({"name": "q", "inbox": str(tmp_path / "in"), "staging": str(tmp_path / "st"), "checkpoint": str(tmp_path / "cp")} | more)


def test_drain_cuts_by_partition_and_resumes(spark, tmp_path):
    src = tmp_path / "src"
    msgs = lambda a, b: spark.createDataFrame([("t", i % 2, i // 2, bytearray(json.dumps({"i": i}).encode())) for i in range(a, b)], materialize.SCHEMA)
    msgs(0, 10).coalesce(1).write.mode("append").parquet(str(src))
    stream = lambda: spark.readStream.schema(materialize.SCHEMA).parquet(str(src))
    plan = _plan(tmp_path, batch_size=3)
    assert sorted(p.rsplit("/", 1)[1] for p in materialize.drain(stream(), plan)) == ["q-t-0-0-2.ndjson", "q-t-0-3-4.ndjson", "q-t-1-0-2.ndjson", "q-t-1-3-4.ndjson"]
    assert json.loads(manifest.parse((tmp_path / "in" / ("q-t-0-0-2.ndjson" + manifest.SUFFIX)).read_text()).source_range) == {"topic": "t", "partition": 0, "start_offset": 0, "end_offset": 2}
    msgs(10, 12).coalesce(1).write.mode("append").parquet(str(src))
    assert len(materialize.drain(stream(), plan)) == 2


def test_bad_message_fails_the_query(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("t", 0, 0, bytearray(b"[1]"))], materialize.SCHEMA).write.parquet(src)
    with pytest.raises(Exception, match="not a JSON object"):
        materialize.drain(spark.readStream.schema(materialize.SCHEMA).parquet(src), _plan(tmp_path))
    assert not (tmp_path / "in").exists()


def test_registry(tmp_path, monkeypatch):
    f = tmp_path / "r.yaml"
    f.write_text("pipelines:\n- {id: a, dir: in, config: c.yaml, audit_db: '${DB}'}\n")
    with pytest.raises(registry.RegistryError):
        registry.load(f)
    monkeypatch.setenv("DB", "/x.db")
    got = registry.load(f)
    assert got["a"].audit_db == "/x.db" and got["a"].dir == str(tmp_path / "in")
    with pytest.raises(registry.RegistryError):
        registry.resolve(got, "b")
    f.write_text("pipelines:\n- {id: a, dir: i, config: c, audit_db: d}\n- {id: b, dir: i, config: c, audit_db: d}\n")
    with pytest.raises(registry.RegistryError, match="share"):
        registry.load(f)
    assert (registry.create(tmp_path, "My Pipe!", "x: 1\n") / "pipeline.yaml").read_text() == "x: 1\n"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,amount\n1,2.5\n2,x\n")
    cfg = tmp_path / "p.yaml"
    cfg.write_text("format: csv\ndest_table: t\ncolumns:\n- {source: id, dest: id, type: integer}\n- {source: amount, dest: amount, type: float}\n")
    file, db = str(tmp_path / "in" / "a.csv"), str(tmp_path / "a.db")
    assert cli.main(["inspect", "--file", file]) == 0 and "1 of 2 values are numbers" in capsys.readouterr().out
    assert cli.main(["preview", "--file", file, "--rows", "1"]) == 0 and capsys.readouterr().out.splitlines()[1].split(" | ") == ["1 ", "2.5"]
    assert cli.main(["validate", "--file", file, "--config", str(cfg)]) == 1 and "1 of 2 rows fail" in capsys.readouterr().out
    assert cli.main(["run", "--dir", str(tmp_path / "in"), "--config", str(cfg), "--audit-db", db, "--warehouse", str(tmp_path / "wh")]) == 1
    assert cli.main(["lineage", "--audit-db", db, "a.csv"]) == 0 and cli.main(["lineage", "--audit-db", db, "none"]) == 1
    assert cli.main(["status", "--audit-db", db]) == 0 and cli.main(["requeue", "--audit-db", db, "--all", "--retry-cap", "1"]) == 0
    assert cli.main(["export-audit", "--audit-db", db, "--out", str(tmp_path / "x.html")]) == 0 and cli.main(["healthcheck", "--audit-db", db]) == 0


def test_commands_by_registry(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id\n1\n")
    (tmp_path / "in" / "b.csv").write_text("id\nx\n")
    (tmp_path / "p.yaml").write_text("format: csv\ndest_table: orders\nretry_cap: 1\ncolumns:\n- {source: id, dest: id, type: integer}\n")
    db, file = str(tmp_path / "a.db"), tmp_path / "r.yaml"
    monkeypatch.setenv("DB", db)
    file.write_text(f"pipelines:\n- {{id: p, dir: in, config: p.yaml, audit_db: '${{DB}}', warehouse: {tmp_path}/wh}}\n")
    call = lambda *a: cli.main([*a, "--registry", str(file), "--pipeline", "p"])
    out = lambda: json.loads(capsys.readouterr().out)
    assert call("run") == 1 and out()["committed"] == 1
    assert call("status") == 0 and out()["p"]["by_state"]["FAILED"] == 1
    assert cli.main(["status", "--registry", str(file)]) == 0 and list(out()) == ["p"]
    assert call("lineage", "a.csv") == 0
    got = out()[0]
    assert got["destination"] == {"table": "orders", "query": f"SELECT * FROM orders WHERE _source_file_hash = '{got['content_hash']}'"}
    assert cli.main(["lineage", "a.csv", "--audit-db", db, "--dest-table", "x"]) == 0 and out()[0]["destination"]["table"] == "x"
    assert call("requeue", "--all") == 0 and out() == {"would_requeue": 1}
    assert call("requeue", "--all", "--dry-run") == 0 and out()["files"][0]["filename"] == "b.csv"
    for odd in (["--all", "--dry-run", "--yes"], ["b.csv", "--yes"], ["b.csv", "--all"], []):
        assert call("requeue", *odd) == 1
    assert call("requeue", "--all", "--yes") == 0 and out() == {"requeued": 1}
    assert call("export-audit", "--out", str(tmp_path / "x.html")) == 0 and call("healthcheck") == 0
    capsys.readouterr()
    for bad in (["status"], ["lineage", "a.csv", "--registry", str(file)], ["status", "--audit-db", db, "--registry", str(file), "--pipeline", "p"], ["serve", "--registry", str(file), "--pipeline", "none"], ["export-audit", "--out", "x", "--registry", "/none", "--pipeline", "p"]):
        assert cli.main(bad) == 1 and capsys.readouterr().err
