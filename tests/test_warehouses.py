import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from harborline.operators import warehouses
from harborline.operators.destinations import destination
from harborline.operators.schema import SchemaError, declared
from harborline.plans import cli, log, manifest
from harborline.plans.audit import Audit
from harborline.plans.config import Column, ConfigError
from harborline.sources import fetch
from harborline.streaming import materialize

COLUMNS = (Column("id", "id", "string"), Column("n", "n", "integer"), Column("x", "x", "float", required=False), Column("day", "day", "date", required=False), Column("ok", "ok", "boolean", required=False))


class Fake:
    """A client of either warehouse: keeps the statements, answers from what is set."""

    def __init__(self):
        self.said, self.answers, self.fail = [], {}, None

    def _do(self, sql):
        self.said.append(sql)
        if self.fail and self.fail in sql:
            raise RuntimeError("refused")
        return next((rows for part, rows in self.answers.items() if part in sql), [])

    # BigQuery
    def query(self, sql):
        rows = self._do(sql)
        return type("Job", (), {"result": lambda self: rows})()

    # Databricks
    def cursor(self):
        fake = self

        class Cursor:
            def __enter__(self):
                return self

            def __exit__(self, *a):
                pass

            def execute(self, sql):
                self.rows = fake._do(sql)

            def fetchall(self):
                return self.rows

        return Cursor()


@pytest.fixture(params=["bigquery", "databricks"])
def place(request, spark, tmp_path):
    fake = Fake()
    options = {"type": request.param, "client": fake, "staging": f"file://{tmp_path}/staging"} | ({"project": "p", "dataset": "d"} if request.param == "bigquery" else {"catalog": "c", "schema": "s"})
    table = destination(spark, options, "t", "")
    table.ensure(declared(COLUMNS))
    return request.param, fake, table, tmp_path


def rows(spark, operations=None):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long").withColumns({"x": F.lit(1.5), "day": F.lit("2024-01-02").cast("date"), "ok": F.lit(True), "_source_file_hash": F.lit("h1"), "_ingested_at": F.current_timestamp()})
    return df.withColumn(warehouses.OPERATION, F.lit("update")) if operations else df


def test_create_and_schema_differences(place):
    kind, fake, table, _ = place
    made = next(s for s in fake.said if "CREATE TABLE IF NOT EXISTS" in s)
    assert ("`p.d.t`" if kind == "bigquery" else "`c`.`s`.`t`") in made and ("`n` INT64" if kind == "bigquery" else "`n` BIGINT") in made and "`_source_file_hash` STRING" in made
    have = {"id": "STRING", "n": "INT64" if kind == "bigquery" else "BIGINT", "x": "FLOAT64" if kind == "bigquery" else "DOUBLE", "day": "DATE", "ok": "BOOL", "_source_file_hash": "STRING", "_ingested_at": "TIMESTAMP"}
    fake.answers = {"column_name": list(have.items())}
    table.ensure(declared(COLUMNS))
    fake.answers = {"column_name": list((have | {"n": "STRING"}).items())}
    with pytest.raises(SchemaError, match="n: type_mismatch"):
        table.ensure(declared(COLUMNS))


def test_append_and_truncate_name_the_file(place, spark):
    kind, fake, table, folder = place
    counted = []
    assert table.append(rows(spark), "h1", counted.append) == 2 and counted == [2]
    said = "\n".join(fake.said)
    assert ("LOAD DATA INTO" if kind == "bigquery" else "COPY INTO") in said and "PARQUET" in said.upper() and f"file://{folder}/staging/_staged_" in said
    assert "`_source_file_hash` = 'h1'" in said and said.count("DROP TABLE IF EXISTS") == 1
    assert ("BEGIN TRANSACTION" in said and "COMMIT TRANSACTION" in said) if kind == "bigquery" else "REPLACE WHERE" in said
    assert not list((folder / "staging").iterdir())
    fake.said.clear()
    table.truncate(rows(spark), "h1")
    said = "\n".join(fake.said)
    assert ("DELETE FROM `p.d.t` WHERE true" if kind == "bigquery" else "INSERT OVERWRITE `c`.`s`.`t`") in said


def test_a_refused_load_leaves_nothing(place, spark):
    kind, fake, table, folder = place
    fake.fail = "LOAD DATA" if kind == "bigquery" else "COPY INTO"
    with pytest.raises(RuntimeError, match="refused"):
        table.append(rows(spark), "h1")
    assert not list((folder / "staging").iterdir()) and not any("INSERT INTO `p.d.t`" in s or "REPLACE WHERE" in s for s in fake.said)
    fake.fail = None

    def check(n):
        raise ValueError("too few")

    with pytest.raises(ValueError):
        table.append(rows(spark), "h1", check)
    assert "DROP TABLE IF EXISTS" in fake.said[-1]


def test_changes_are_merged_once(place, spark):
    kind, fake, table, _ = place
    assert table.apply(rows(spark, True), ["id"], "h'1")
    said = "\n".join(fake.said)
    merge = next(s for s in fake.said if "MERGE INTO" in s)
    assert "ON t.`id` = s.`id`" in merge and "WHEN MATCHED AND" in merge and "THEN DELETE" in merge and "WHEN NOT MATCHED AND NOT" in merge and "h\\'1" in said
    assert "applied_at" in said and (("IF NOT EXISTS" in merge and "END IF" in merge) if kind == "bigquery" else True)
    fake.answers = {"SELECT 1 FROM": [(1,)]}
    fake.said.clear()
    assert not table.apply(rows(spark, True), ["id"], "h'1") and not any("MERGE" in s for s in fake.said)


def test_options_are_needed(spark):
    with pytest.raises(ConfigError, match="dataset"):
        destination(spark, {"type": "bigquery", "project": "p", "staging": "x", "client": Fake()}, "t", "")
    with pytest.raises(ConfigError, match="staging"):
        destination(spark, {"type": "databricks", "client": Fake()}, "t", "")
    with pytest.raises(ConfigError, match="databricks-sql-connector"):
        destination(spark, {"type": "databricks", "staging": "x"}, "t", "")


@pytest.mark.parametrize("kind", ["duckdb", "sqlite"])
def test_older_changes_do_not_come_back(spark, tmp_path, kind):
    table = destination(spark, {"type": kind, "path": str(tmp_path / "x.db")}, "t", "")
    table.ensure(declared(COLUMNS))
    old, new = rows(spark, True), rows(spark, True).withColumn("n", F.lit(9).cast("long"))
    assert table.apply(old, ["id"], "h1") and table.apply(new, ["id"], "h2") and not table.apply(old, ["id"], "h1")
    assert table.select('SELECT DISTINCT n FROM "t"') == [(9,)]


def test_manifest_categories():
    good = {"job": {"namespace": "api", "name": "x"}, "inputs": [{"facets": {"_sourceRange": {"from": 1}}}]}
    assert json.loads(manifest.parse(json.dumps(good)).source_range) == {"from": 1}
    cases = {
        "{": "malformed_json", "[]": "invalid_shape", json.dumps({"job": {"namespace": "api"}}): "missing_required_field", json.dumps({}): "missing_required_field",
        json.dumps(good | {"manifest_version": "9"}): "unsupported_version", json.dumps(good | {"inputs": [{"facets": {"_sourceRange": "1-2"}}]}): "invalid_source_range", json.dumps(good | {"source_range": 3}): "invalid_source_range",
    }
    for text, category in cases.items():
        with pytest.raises(manifest.ManifestError) as e:
            manifest.parse(text)
        assert e.value.category == category, text


def test_known_looks_up_only_what_is_asked():
    audit = Audit(":memory:")
    for i in range(1200):
        audit.insert_pending(f"f{i}", f"h{i}")
    assert audit.known(f"h{i}" for i in range(600, 1300)) == {f"h{i}": "PENDING" for i in range(600, 1200)}


def test_log_lines(capsys):
    event = {"phase": "load", "action": "failed", "path": "a.csv", "error": "x"}
    log.reporter("json")(event)
    log.reporter("text")(event)
    first, second = capsys.readouterr().err.splitlines()
    assert json.loads(first)["level"] == "error" and json.loads(first)["path"] == "a.csv" and second.endswith("load failed path=a.csv error=x")


def test_commands_of_companions(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "sources.yaml").write_text(f"sources:\n- name: s\n  url: https://api.example/x\n  cursor_field: id\n  inbox: {tmp_path}/in\n  staging: {tmp_path}/st\n  cursors: {tmp_path}/cursors.json\n- name: q\n  topic: t\n  brokers: b\n  inbox: i\n  staging: s\n  checkpoint: c\n  batch_size: 5\n")
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setattr(fetch, "http", lambda url, params, headers: fetch.Response(200, [{"id": "1"}, {"id": "2"}]))
    call = lambda *a: cli.main([*a, "--config", str(tmp_path / "sources.yaml")])
    assert call("fetch", "--source", "s", "--dry-run") == 0 and "api.example" in capsys.readouterr().out
    assert call("fetch", "--source", "s") == 0 and json.loads(capsys.readouterr().out)["records"] == 2
    assert call("fetch", "--source", "s") == 0 and json.loads(capsys.readouterr().out)["status"] == "skipped"
    assert call("fetch", "--source", "none") == 1
    assert call("materialize", "--source", "q", "--dry-run") == 0 and json.loads(capsys.readouterr().out)["batch_size"] == 5


def test_continuous_stream_flushes_when_stopped(spark, tmp_path):
    source = tmp_path / "queue"
    messages = lambda a, b: spark.range(a, b).select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), F.encode(F.format_string('{"k":%d}', "id"), "UTF-8").alias("value"))
    messages(0, 5).write.parquet(str(source))
    plan = materialize.parse_plan({"name": "q", "inbox": str(tmp_path / "in"), "staging": str(tmp_path / "st"), "checkpoint": str(tmp_path / "ck"), "batch_timeout_seconds": 0.2})
    stream = spark.readStream.schema(materialize.SCHEMA).parquet(str(source))
    stop, paths = threading.Event(), []
    worker = threading.Thread(target=materialize.follow, args=(stream, plan, stop, lambda _, p: paths.extend(p)))
    worker.start()
    for _ in range(300):
        if paths:
            break
        time.sleep(0.1)
    messages(5, 8).write.mode("append").parquet(str(source))
    stop.set()
    worker.join(60)
    assert not worker.is_alive() and sum(len(open(p).readlines()) for p in paths) == 8
