"""Destinations in cloud warehouses: BigQuery and Databricks, with the contract of the SQL destinations.

Spark writes a file's rows as Parquet below `staging`, a folder that both it and the warehouse reach, so no row passes through
the driver; the warehouse loads them from there. What then changes the table is one transaction or one atomic statement that
names the file's hash, so that a retry at any time later changes nothing. Applied change files are kept in a marker table.

The client is the vendor's (google.cloud.bigquery.Client, databricks.sql.connect), taken from the options as `client`, or made
from them if the vendor's package is installed.
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..plans.config import ConfigError
from .cdc import OPERATION
from .destinations import TYPES, SqlDestination
from .schema import HASH

MARKERS = "harborline_applied_files"


def ticked(name: str) -> str:
    return "`" + name.replace("\\", "\\\\").replace("`", "\\`") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


class Warehouse(SqlDestination):
    #: How a folder of Parquet becomes a table: a statement with {table} and {uri}.
    load: str
    needs: tuple[str, ...] = ()

    def __init__(self, spark, kind, table, options):
        super().__init__(spark, kind, table, options)
        if missing := [k for k in (*self.needs, "staging") if not options.get(k)]:
            raise ConfigError(f"connector {kind} requires {', '.join(k + ':' for k in missing)}")
        self.client = options.get("client") or self.connect()

    def connect(self):
        raise NotImplementedError

    def select(self, sql: str) -> list[tuple]:
        raise NotImplementedError

    def path(self, table: str) -> str:
        raise NotImplementedError

    # -- contract

    def ensure(self, schema):
        self.schema = schema
        self.columns = [f.name for f in schema]
        super().ensure(schema)

    def create(self) -> list[str]:
        return [f"CREATE TABLE IF NOT EXISTS {self.path(self.name)} ({', '.join(f'{ticked(f.name)} {TYPES[self.kind][f.dataType.simpleString()]}' for f in self.schema)})"]

    def stage(self, df: DataFrame) -> tuple[str, int]:
        name = f"_staged_{uuid.uuid4().hex}"
        uri = f"{self.options['staging'].rstrip('/')}/{name}"
        try:
            df.write.parquet(uri)
            rows = self.spark.read.schema(df.schema).parquet(uri).count()
            kinds = {f.name: TYPES[self.kind][f.dataType.simpleString()] for f in df.schema}
            self.run([f"CREATE TABLE {self.path(name)} ({', '.join(f'{ticked(c)} {t}' for c, t in kinds.items())})", self.load.format(table=self.path(name), uri=uri)])
        finally:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
            at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        return self.path(name), rows

    def drop(self, staged: str) -> None:
        self.run([f"DROP TABLE IF EXISTS {staged}"])

    def merge_sql(self, staged: str, keys: list[str]) -> str:
        """Matched deletions go, other matches are updated, new keys come in unless they are deletions."""
        gone = f"s.{ticked(OPERATION)} = 'delete'"
        sets = ", ".join(f"{ticked(c)} = s.{ticked(c)}" for c in self.columns)
        return (
            f"MERGE INTO {self.path(self.name)} AS t USING {staged} AS s ON {' AND '.join(f't.{ticked(k)} = s.{ticked(k)}' for k in keys)} "
            f"WHEN MATCHED AND {gone} THEN DELETE WHEN MATCHED THEN UPDATE SET {sets} "
            f"WHEN NOT MATCHED AND NOT ({gone}) THEN INSERT ({self.listed()}) VALUES ({', '.join('s.' + ticked(c) for c in self.columns)})"
        )

    def listed(self) -> str:
        return ", ".join(ticked(c) for c in self.columns)

    def markers(self) -> str:
        return f"CREATE TABLE IF NOT EXISTS {self.path(MARKERS)} (destination_table STRING, content_hash STRING, applied_at TIMESTAMP)"

    def marked(self, content_hash: str) -> str:
        return f"SELECT 1 FROM {self.path(MARKERS)} WHERE destination_table = {text(self.name)} AND content_hash = {text(content_hash)}"

    def mark(self, content_hash: str) -> str:
        return f"INSERT INTO {self.path(MARKERS)} (destination_table, content_hash, applied_at) VALUES ({text(self.name)}, {text(content_hash)}, CURRENT_TIMESTAMP())"

    def applied(self, content_hash: str) -> bool:
        self.run([self.markers()])
        return bool(self.select(f"{self.marked(content_hash)} LIMIT 1"))

    def apply(self, changes, keys, content_hash):
        if self.applied(content_hash):
            return False
        staged, _ = self.stage(self._typed(changes))
        try:
            self.run(self.apply_sql(staged, keys, content_hash))
        finally:
            self.drop(staged)
        return True

    def apply_sql(self, staged: str, keys: list[str], content_hash: str) -> list[str]:
        raise NotImplementedError

    def replace_sql(self, staged: str, content_hash: str, everything: bool) -> list[str]:
        raise NotImplementedError


class BigQuery(Warehouse):
    """Every change is one script with a transaction, so it does not lean on job ids, which BigQuery forgets after a week."""

    needs = ("project", "dataset")
    load = "LOAD DATA INTO {table} FROM FILES (format = 'PARQUET', uris = ['{uri}/*.parquet'])"

    def connect(self):
        try:
            return importlib.import_module("google.cloud.bigquery").Client(project=self.options["project"])
        except ImportError as e:
            raise ConfigError("connector bigquery needs the package google-cloud-bigquery") from e

    def path(self, table):
        return ticked(f"{self.options['project']}.{self.options['dataset']}.{table}")

    def select(self, sql):
        return [tuple(r) for r in self.client.query(sql).result()]

    def run(self, statements: Iterable[str]):
        self.client.query("\n".join(f"{s};" for s in statements)).result()

    def actual(self):
        where = f"{ticked(self.options['project'] + '.' + self.options['dataset'])}.INFORMATION_SCHEMA.COLUMNS"
        return dict(self.select(f"SELECT column_name, data_type FROM {where} WHERE table_name = {text(self.name)}")) or None

    def replace_sql(self, staged, content_hash, everything):
        where = "true" if everything else f"{ticked(HASH)} = {text(content_hash)}"
        return ["BEGIN TRANSACTION", f"DELETE FROM {self.path(self.name)} WHERE {where}", f"INSERT INTO {self.path(self.name)} ({self.listed()}) SELECT {self.listed()} FROM {staged}", "COMMIT TRANSACTION"]

    def apply_sql(self, staged, keys, content_hash):
        # the marker is looked at again inside the transaction: of two runs that apply a file one does
        return ["BEGIN TRANSACTION", f"IF NOT EXISTS ({self.marked(content_hash)}) THEN {self.merge_sql(staged, keys)}; {self.mark(content_hash)}; END IF", "COMMIT TRANSACTION"]


class Databricks(Warehouse):
    """A Delta table: each statement is atomic. Replacing by the file's hash makes append repeatable, INSERT OVERWRITE truncates
    and fills at once. Changes and their marker are two statements; a merge of the same changes again gives the same table."""

    needs = ()
    load = "COPY INTO {table} FROM '{uri}' FILEFORMAT = PARQUET"

    def connect(self):
        try:
            return importlib.import_module("databricks.sql").connect(**{k: self.options[k] for k in ("server_hostname", "http_path", "access_token") if k in self.options})
        except ImportError as e:
            raise ConfigError("connector databricks needs the package databricks-sql-connector") from e

    def path(self, table):
        return ".".join(ticked(x) for x in (self.options.get("catalog"), self.options.get("schema"), table) if x)

    def _execute(self, sql: str, rows: bool = False):
        with self.client.cursor() as c:
            c.execute(sql)
            return [tuple(r) for r in c.fetchall()] if rows else None

    def select(self, sql):
        return self._execute(sql, True)

    def run(self, statements):
        for s in statements:
            self._execute(s)

    def actual(self):
        catalog = f"{ticked(self.options['catalog'])}." if self.options.get("catalog") else ""
        where = f" AND table_schema = {text(self.options['schema'])}" if self.options.get("schema") else ""
        return dict(self.select(f"SELECT column_name, data_type FROM {catalog}information_schema.columns WHERE table_name = {text(self.name)}{where}")) or None

    def replace_sql(self, staged, content_hash, everything):
        if everything:
            return [f"INSERT OVERWRITE {self.path(self.name)} ({self.listed()}) SELECT {self.listed()} FROM {staged}"]
        return [f"INSERT INTO {self.path(self.name)} REPLACE WHERE {ticked(HASH)} = {text(content_hash)} SELECT {self.listed()} FROM {staged}"]

    def apply_sql(self, staged, keys, content_hash):
        return [self.merge_sql(staged, keys), self.mark(content_hash)]


