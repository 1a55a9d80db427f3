import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from harborline.operators.destinations import Sql, destination
from harborline.operators.schema import declared
from harborline.plans.audit import Audit
from harborline.plans.config import ConfigError, parse
from harborline.plans.run import run

COLUMNS = [{"source": "id", "dest": "id", "type": "string"}, {"source": "n", "dest": "n", "type": "integer"}, {"source": "day", "dest": "day", "type": "date", "required": False}]


@pytest.fixture(params=["duckdb", "sqlite"])
def place(request, tmp_path, spark):
    (tmp_path / "in").mkdir()
    db = tmp_path / "x.db"

    class Place:
        audit = Audit(str(tmp_path / "audit.db"))

        def put(self, name, text):
            (tmp_path / "in" / name).write_text(text)

        def run(self, **more):
            return run(spark, str(tmp_path / "in"), parse({"format": "csv", "dest_table": "t", "columns": COLUMNS, "connector": {"type": request.param, "path": str(db)}} | more), self.audit)

        def rows(self):
            con = duckdb.connect(str(db)) if request.param == "duckdb" else sqlite3.connect(db)
            try:
                return sorted((a, b, str(c) if c else None) for a, b, c in con.execute("SELECT id, n, day FROM t").fetchall())
            finally:
                con.close()

    return Place()


def test_append_retry_and_rollback(place, tmp_path):
    place.put("a.csv", "id,n,day\n1,1,2024-01-01\n2,2,\n")
    assert place.run().committed == 1
    place.audit._set("1 = 1", (), state="PENDING")  # a crash before the record
    place.put("b.csv", "id,n,day\n3,x,\n")
    got = place.run()
    assert (got.committed, got.failed) == (1, 1) and place.rows() == [("1", 1, "2024-01-01"), ("2", 2, None)]
    assert not list(tmp_path.glob("_staged*"))


def test_truncate(place):
    place.put("a.csv", "id,n,day\n1,1,\n")
    place.put("b.csv", "id,n,day\n2,2,\n")
    place.run(write_mode="truncate")
    assert place.rows() == [("2", 2, None)]


def test_changes(place):
    cdc = {"write_mode": "cdc", "cdc": {"keys": ["id"], "operation_column": "op", "sequence_by": "n", "operations": {"insert": ["I"], "update": ["U"], "delete": ["D"]}}}
    place.put("a.csv", "op,id,n,day\nI,1,1,\nI,2,1,\nU,1,3,2024-01-01\n")
    place.put("b.csv", "op,id,n,day\nD,2,2,\nI,3,1,\nD,9,1,\n")
    assert place.run(**cdc).committed == 2 and place.rows() == [("1", 3, "2024-01-01"), ("3", 1, None)]


def test_mismatch_is_refused(place):
    place.put("a.csv", "id,n,day\n1,1,\n")
    place.run()
    with pytest.raises(ValueError, match="type_mismatch|missing"):
        place.run(columns=[COLUMNS[0], {"source": "n", "dest": "n", "type": "float"}, COLUMNS[2]])


def test_statements_and_registry(spark):
    sql = Sql("postgres", "t", declared(parse({"format": "csv", "dest_table": "t", "columns": COLUMNS}).columns))
    assert "BIGSERIAL" in sql.create()[0] and sql.replace("s", "h", False)[0].endswith("= 'h'") and "WHERE" not in sql.replace("s", "h", True)[0]
    for bad in ({"type": "oracle"}, {"type": "duckdb"}, {"type": "postgres"}):
        with pytest.raises(ConfigError):
            destination(spark, bad, "t", "/w")


def test_changes_are_looked_up_by_an_index():
    """Not one by one for each row of the table, which takes the product of both."""
    sql = Sql("sqlite", "t", declared(parse({"format": "csv", "dest_table": "t", "columns": COLUMNS}).columns))
    con = sqlite3.connect(":memory:")
    con.execute(sql.create()[0])
    con.execute("CREATE TABLE staged (id TEXT, n INTEGER, day TEXT, operation TEXT)")
    *before, delete, _ = sql.merge("staged", ["id", "n"])
    for step in before:
        con.execute(step)
    plan = " ".join(r[-1] for r in con.execute(f"EXPLAIN QUERY PLAN {delete}"))
    assert "SEARCH s USING" in plan and "id=? AND n=?" in plan


@pytest.mark.parametrize("kind", ["duckdb", "sqlite"])
def test_rows_are_read_by_many_tasks(spark, tmp_path, kind):
    kinds = ("string", "integer", "float", "boolean", "date", "timestamp")
    table = destination(spark, {"type": kind, "path": str(tmp_path / "a b?.db")}, "t", "")
    table.ensure(declared(parse({"format": "csv", "dest_table": "t", "columns": [{"source": k, "dest": k, "type": k, "required": False} for k in kinds]}).columns))
    rows = spark.range(50).selectExpr("concat('é', id) AS string", "id AS integer", "id / 4 AS float", "id % 2 = 0 AS boolean", "date_add(DATE'2024-01-01', int(id)) AS date", "timestamp_seconds(id + 0.5) AS timestamp")
    rows = rows.selectExpr(*(k if k == "integer" else f"if(integer % 7 = 3, null, {k}) AS {k}" for k in kinds)).withColumns({"_source_file_hash": F.lit("h"), "_ingested_at": F.lit("2024-01-01").cast("timestamp")})
    assert table.read(str(tmp_path / "none")).count() == 0
    table.append(rows, "h")
    more = {"rows": 20} if kind == "sqlite" else {}
    got = table.read(str(tmp_path / "read"), **more)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == sorted(map(tuple, rows.select(*got.columns).collect()), key=lambda r: r[1])
    assert kind == "duckdb" or got.rdd.getNumPartitions() == 3
