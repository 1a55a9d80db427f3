"""Destinations in SQL databases, with the same contract as the file store: ensure, append, truncate, apply, ping.

Rows go to a staging table first; one transaction then deletes what a file had, or everything, and inserts, so readers see a
whole file or nothing and a retry changes nothing. Changes are merged by deleting their keys and inserting those that are not
deletions. DuckDB and SQLite take the Parquet files that Spark has staged, SQLite batch by batch; other databases are written by
Spark's JDBC sink and need their driver on the class path.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import time
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.config import ConfigError
from .cdc import OPERATION
from .schema import HASH, SchemaError, differences
from .store import Table

#: Column types by Spark's name, for each kind of database.
TYPES = {
    "duckdb": {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"},
    "sqlite": {"string": "TEXT", "bigint": "INTEGER", "double": "REAL", "boolean": "INTEGER", "date": "TEXT", "timestamp": "TEXT"},
    "postgres": {"string": "TEXT", "bigint": "BIGINT", "double": "DOUBLE PRECISION", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMPTZ"},
    "snowflake": {"string": "STRING", "bigint": "NUMBER", "double": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP_NTZ"},
    "bigquery": {"string": "STRING", "bigint": "INT64", "double": "FLOAT64", "boolean": "BOOL", "date": "DATE", "timestamp": "TIMESTAMP"},
    "databricks": {"string": "STRING", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"},
}
KINDS = ("files", *TYPES)
MARKERS = "harborline_applied_files"


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class Sql:
    """The statements of a destination, for one kind of database."""

    def __init__(self, kind: str, table: str, schema: T.StructType):
        self.kind, self.table, self.schema = kind, quoted(table), schema
        self.columns = ", ".join(quoted(f.name) for f in schema)

    def create(self) -> list[str]:
        columns = [f"{quoted(f.name)} {TYPES[self.kind][f.dataType.simpleString()]}" for f in self.schema]
        own, before = "_id INTEGER PRIMARY KEY", []
        if self.kind == "duckdb":
            sequence = quoted(self.table.strip('"') + "_id_seq")
            before, own = [f"CREATE SEQUENCE IF NOT EXISTS {sequence}"], f"_id BIGINT DEFAULT nextval('{sequence}')"
        elif self.kind == "postgres":
            own = "_id BIGSERIAL PRIMARY KEY"
        elif self.kind == "snowflake":
            own = "_id NUMBER AUTOINCREMENT"
        index = [] if self.kind == "snowflake" else [f"CREATE INDEX IF NOT EXISTS {quoted('idx_' + self.table.strip(chr(34)) + '_file')} ON {self.table} ({quoted(HASH)})"]
        return [*before, f"CREATE TABLE IF NOT EXISTS {self.table} ({', '.join([own, *columns])})", *index]

    def replace(self, staged: str, content_hash: str, everything: bool) -> list[str]:
        where = "" if everything else f" WHERE {quoted(HASH)} = '{content_hash}'"
        return [f"DELETE FROM {self.table}{where}", f"INSERT INTO {self.table} ({self.columns}) SELECT {self.columns} FROM {staged}"]

    def merge(self, staged: str, keys: list[str]) -> list[str]:
        same = " AND ".join(f"{staged_name}.{quoted(k)} = {self.table}.{quoted(k)}" for staged_name in ("s",) for k in keys)
        # SQLite has no hash joins: without an index it would look through all changes for each row
        index = [f"CREATE INDEX {quoted(staged + '_keys')} ON {staged} ({', '.join(quoted(k) for k in keys)})"] if self.kind == "sqlite" else []
        return [
            *index,
            f"DELETE FROM {self.table} WHERE EXISTS (SELECT 1 FROM {staged} AS s WHERE {same})",
            f"INSERT INTO {self.table} ({self.columns}) SELECT {self.columns} FROM {staged} AS s WHERE s.{quoted(OPERATION)} <> 'delete'",
        ]

    def markers(self) -> str:
        """The table that tells which change files a destination has taken."""
        return f"CREATE TABLE IF NOT EXISTS {quoted(MARKERS)} (destination_table VARCHAR(512) NOT NULL, content_hash VARCHAR(64) NOT NULL, applied_at TIMESTAMP, PRIMARY KEY (destination_table, content_hash))"

    def marked(self, content_hash: str) -> str:
        return f"SELECT 1 FROM {quoted(MARKERS)} WHERE destination_table = {self._text()} AND content_hash = '{content_hash}'"

    def mark(self, content_hash: str) -> str:
        """Its key makes the transaction of a second run that applies the same file fail as a whole."""
        return f"INSERT INTO {quoted(MARKERS)} VALUES ({self._text()}, '{content_hash}', CURRENT_TIMESTAMP)"

    def _text(self) -> str:
        return "'" + self.table.strip('"').replace("'", "''") + "'"


class SqlDestination:
    def __init__(self, spark: SparkSession, kind: str, table: str, options: dict):
        self.spark, self.kind, self.name, self.options = spark, kind, table, options
        self.schema: T.StructType | None = None

    def actual(self) -> dict[str, str] | None:
        raise NotImplementedError

    def run(self, statements: list[str]) -> None:
        """All of them in one transaction."""
        raise NotImplementedError

    def select(self, statement: str) -> list[tuple]:
        raise NotImplementedError

    def stage(self, df: DataFrame) -> tuple[str, int]:
        """What to select from, and how many rows are there."""
        raise NotImplementedError

    def drop(self, staged: str) -> None:
        raise NotImplementedError

    def ensure(self, schema: T.StructType) -> None:
        self.schema = schema
        self.sql = Sql(self.kind, self.name, schema)
        have = self.actual()
        if have is None:
            self.run(self.create())
            return
        have.pop("_id", None)
        want = {f.name: TYPES[self.kind][f.dataType.simpleString()] for f in schema}
        if found := differences(want, have):
            raise SchemaError("; ".join(f"{c}: {what} (declared {a}, found {b})" for c, what, a, b in found))

    def create(self) -> list[str]:
        return self.sql.create()

    def replace_sql(self, staged: str, content_hash: str, everything: bool) -> list[str]:
        return self.sql.replace(staged, content_hash, everything)

    def _typed(self, df: DataFrame) -> DataFrame:
        more = [F.col(OPERATION)] if OPERATION in df.columns else []
        return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema), *more)

    def _replace(self, df: DataFrame, content_hash: str, everything: bool, check) -> int:
        staged, rows = self.stage(self._typed(df))
        try:
            if check:
                check(rows)
            self.run(self.replace_sql(staged, content_hash, everything))
        finally:
            self.drop(staged)
        return rows

    def append(self, df: DataFrame, content_hash: str, check=None) -> int:
        return self._replace(df, content_hash, False, check)

    def truncate(self, df: DataFrame, content_hash: str, check=None) -> int:
        return self._replace(df, content_hash, True, check)

    def apply(self, changes: DataFrame, keys: list[str], content_hash: str) -> bool:
        """False if the file was applied before: an older file that comes again does not undo newer ones."""
        self.run([self.sql.markers()])
        if self.select(self.sql.marked(content_hash)):
            return False
        staged, _ = self.stage(self._typed(changes))
        try:
            self.run([*self.sql.merge(staged, keys), self.sql.mark(content_hash)])
        finally:
            self.drop(staged)
        return True

    def state(self):
        """A probe, for health checks."""
        return self.actual()


def _write_files(df: DataFrame, options: dict) -> str:
    """Rows as Parquet files in a new folder beside a database's file."""
    folder = os.path.join(os.path.abspath(options.get("staging") or os.path.dirname(os.path.abspath(options["path"]))), f"_staged-{uuid.uuid4().hex}")
    df.write.parquet(f"file://{folder}")
    return folder


class DuckDb(SqlDestination):
    def _connect(self):
        import duckdb

        for attempt in range(50):  # one process writes at a time
            try:
                return duckdb.connect(self.options["path"])
            except duckdb.IOException:
                if attempt == 49:
                    raise
                time.sleep(0.2)

    def actual(self):
        con = self._connect()
        try:
            rows = con.execute("SELECT column_name, data_type FROM information_schema.columns WHERE table_name = ?", [self.name]).fetchall()
            return dict(rows) or None
        finally:
            con.close()

    def select(self, statement):
        con = self._connect()
        try:
            return con.execute(statement).fetchall()
        finally:
            con.close()

    def run(self, statements):
        con = self._connect()
        try:
            con.execute("BEGIN")
            for s in statements:
                con.execute(s)
            con.execute("COMMIT")
        except BaseException:
            con.execute("ROLLBACK")
            raise
        finally:
            con.close()

    def stage(self, df):
        folder = _write_files(df, self.options)
        return f"read_parquet('{folder}/*.parquet')", self.spark.read.schema(df.schema).parquet(f"file://{folder}").count()

    def drop(self, staged):
        shutil.rmtree(staged.split("'")[1].rsplit("/", 1)[0], ignore_errors=True)

    def read(self, folder: str) -> DataFrame:
        """The table's rows, which DuckDB writes to a new folder that executors share."""
        folder = os.path.abspath(folder.removeprefix("file://"))
        self.run([f"COPY (SELECT {self.sql.columns} FROM {self.sql.table}) TO '{folder}' (FORMAT parquet, PER_THREAD_OUTPUT true)"])
        return self._typed(self.spark.read.parquet(f"file://{folder}"))


class Sqlite(SqlDestination):
    def _connect(self):
        return sqlite3.connect(self.options["path"], timeout=30, isolation_level=None)

    def actual(self):
        con = self._connect()
        try:
            return {r[1]: r[2] for r in con.execute(f"PRAGMA table_info({quoted(self.name)})")} or None
        finally:
            con.close()

    def select(self, statement):
        con = self._connect()
        try:
            return con.execute(statement).fetchall()
        finally:
            con.close()

    def run(self, statements):
        con = self._connect()
        try:
            con.execute("BEGIN IMMEDIATE")
            for s in statements:
                con.execute(s)
            con.execute("COMMIT")
        except BaseException:
            con.execute("ROLLBACK")
            raise
        finally:
            con.close()

    def stage(self, df):
        import pyarrow.parquet as pq

        name = f"_staged_{uuid.uuid4().hex}"
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        as_text = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) if k == "timestamp" else F.col(f"`{c}`").cast("string").alias(c) if k == "date" else F.col(f"`{c}`").cast("int").alias(c) if k == "boolean" else F.col(f"`{c}`") for c, k in kinds.items()]
        folder = _write_files(df.select(*as_text), self.options)
        con, n = self._connect(), 0
        try:
            # of the destination's types, or an index on them is no use to comparisons
            con.execute(f"CREATE TABLE {name} ({', '.join(f'{quoted(c)} {TYPES["sqlite"][k]}' for c, k in kinds.items())})")
            con.execute("BEGIN")
            for file in sorted(x for x in os.listdir(folder) if x.endswith(".parquet")):
                for batch in pq.ParquetFile(f"{folder}/{file}").iter_batches(10_000):
                    con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(kinds))})", zip(*(c.to_pylist() for c in batch.columns)))
                    n += batch.num_rows
            con.execute("COMMIT")
        finally:
            con.close()
            shutil.rmtree(folder, ignore_errors=True)
        return name, n

    def drop(self, staged):
        con = self._connect()
        con.execute(f"DROP TABLE IF EXISTS {staged}")
        con.close()

    def read(self, folder: str = "", rows: int = 100_000) -> DataFrame:
        """The table's rows. Each task opens the file, which has to lie where executors reach it, and reads so many numbers of rows."""
        (first, last), = self.select(f"SELECT coalesce(min(_id), 0), coalesce(max(_id), -1) FROM {self.sql.table}")
        at, statement = f"file:{quote(os.path.abspath(self.options['path']))}?mode=ro", f"SELECT {self.sql.columns} FROM {self.sql.table} WHERE _id BETWEEN ? AND ?"
        raw = T.StructType([T.StructField(f.name, T.LongType() if TYPES["sqlite"][k] == "INTEGER" else T.DoubleType() if k == "double" else T.StringType()) for f in self.schema for k in (f.dataType.simpleString(),)])
        kinds = pa.schema([(f.name, {"bigint": pa.int64(), "double": pa.float64()}.get(f.dataType.simpleString(), pa.string())) for f in raw])

        def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for begin in (x for batch in parts for x in batch.column(0).to_pylist()):
                con = sqlite3.connect(at, timeout=30, uri=True)
                try:
                    found = con.execute(statement, (begin, min(last, begin + rows - 1)))
                    while some := found.fetchmany(10_000):
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some), kinds)], schema=kinds)
                finally:
                    con.close()

        n = -(-(last + 1 - first) // rows)
        return self._typed(self.spark.range(first, first + n * rows, rows, max(1, n)).mapInArrow(work, raw))


class Jdbc(SqlDestination):
    """Postgres, Snowflake: Spark writes the staging table in parallel, the JVM's driver runs the transaction."""

    def _properties(self):
        p = self.spark._jvm.java.util.Properties()
        for k in ("user", "password", "driver"):
            if self.options.get(k):
                p.setProperty(k, str(self.options[k]))
        return p

    def _connect(self):
        return self.spark._jvm.java.sql.DriverManager.getConnection(self.options["url"], self._properties())

    def actual(self):
        con = self._connect()
        try:
            found = con.getMetaData().getColumns(None, None, self.name, None)
            out = {}
            while found.next():
                out[found.getString("COLUMN_NAME")] = found.getString("TYPE_NAME")
            return out or None
        finally:
            con.close()

    def select(self, statement):
        con = self._connect()
        try:
            found, out = con.createStatement().executeQuery(statement), []
            while found.next():
                out.append((found.getObject(1),))
            return out
        finally:
            con.close()

    def run(self, statements):
        con = self._connect()
        try:
            con.setAutoCommit(False)
            step = con.createStatement()
            for s in statements:
                step.execute(s)
            con.commit()
        except BaseException:
            con.rollback()
            raise
        finally:
            con.close()

    def stage(self, df):
        name = f"_staged_{uuid.uuid4().hex}"
        properties = {k: str(self.options[k]) for k in ("user", "password", "driver") if self.options.get(k)}
        df.write.jdbc(self.options["url"], name, properties=properties)
        return name, self.spark.read.jdbc(self.options["url"], f"(SELECT count(*) AS n FROM {name}) AS c", properties=properties).first()[0]

    def drop(self, staged):
        self.run([f"DROP TABLE IF EXISTS {staged}"])


def destination(spark: SparkSession, connector: dict, table: str, warehouse: str):
    """The destination that a connector: block names; without one, the file store below the warehouse."""
    kind = connector.get("type", "files")
    if kind == "files":
        return Table(spark, f"{(connector.get('path') or warehouse).rstrip('/')}/{table}")
    if kind in ("duckdb", "sqlite"):
        if not connector.get("path"):
            raise ConfigError(f"connector {kind} requires path:")
        return (DuckDb if kind == "duckdb" else Sqlite)(spark, kind, table, connector)
    if kind in ("postgres", "snowflake"):
        url = connector.get("url") or os.environ.get("DATABASE_URL")
        if not url:
            raise ConfigError(f"connector {kind} requires url: or DATABASE_URL")
        return Jdbc(spark, kind, table, connector | {"url": url})
    if kind in ("bigquery", "databricks"):
        from .warehouses import BigQuery, Databricks

        return (BigQuery if kind == "bigquery" else Databricks)(spark, kind, table, connector)
    raise ConfigError(f"Unknown connector {kind!r}; choose one of {', '.join(KINDS)}")
