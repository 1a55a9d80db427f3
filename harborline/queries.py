"""Queries that show the engine's operators on the test tables, each with the SQL that gives the same rows.

Every query runs the operator that the engine itself uses. Those of readers, registration, compaction and fetches first write
files below the shared folder, as a watched directory would hold them; in the others tables stand in for files, with fields as
the text that a CSV file would have.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import zipfile
from datetime import UTC, datetime
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import coerce, crypto
from .functions.json import dotted_get
from .operators import audit_views, cdc, compact, infer, quarantine, schema, validate
from .operators.destinations import destination
from .operators.store import Table, with_provenance
from .operators.transform import check
from .plans import authoring, export
from .plans.audit import Audit
from .plans.config import Column, Pipeline, Quarantine, parse
from .plans.register import found, register
from .plans.run import run
from .sources import fetch, readers
from .sources.api import read_api
from .sources.files import Index
from .sources.readers import ERROR, ROW, Scan
from .sources.sink import stage_files
from .sources.stores import read_text, store_of
from .streaming import materialize
from .streaming.log import append_log
from .streaming.materialize import cut

KEY = bytes(range(32))
#: Namespaces of workbooks.
_SHEETS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _scan(df: DataFrame, row: str, names: list[str]) -> Scan:
    """Columns of text as a file's raw rows."""
    df = df.withColumns({ROW: F.col(row).cast("long") + 1, ERROR: F.lit(None).cast("string")})
    return Scan(df, {n: coerce.Raw(F.col(n), "text") for n in names}, names)


def _temporary(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local session may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="harborline-")
    return f"{base.rstrip('/')}/{name}-{os.urandom(6).hex()}"


def _put(spark: SparkSession, path: str, data: bytes) -> str:
    """A small file, through Hadoop's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(at)
    out.write(data)
    out.close()
    return path


def _written(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """Lines (value) as one text file below a new folder."""
    path = _temporary(spark, name)
    lines.select("value").coalesce(1).write.text(path)
    return path


def _pipeline(column: str, kind: str) -> Pipeline:
    return parse({"format": "csv", "dest_table": "t", "columns": [{"source": column, "dest": column, "type": kind}]})


# -- coercion and transform


def transform_cast(spark, sf):
    o = _t(spark, sf, "orders")
    raw = o.select(
        "o_orderkey", F.col("o_orderkey").cast("string").alias("k"), F.col("o_totalprice").cast("string").alias("p"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("t"), F.when(F.col("o_orderstatus") == "F", " YES ").when(F.col("o_orderstatus") == "O", "false").otherwise("").alias("b"), F.col("o_orderpriority").alias("s"),
    )
    columns = (Column("k", "order_key", "integer"), Column("p", "price", "float"), Column("d", "order_date", "date"), Column("t", "order_ts", "timestamp"), Column("b", "is_final", "boolean", required=False), Column("s", "priority", "string"))
    got = check(_scan(raw, "o_orderkey", ["k", "p", "d", "t", "b", "s"]), columns, keep_raw=False).good()
    return got.withColumns({"order_date": F.col("order_date").cast("string"), "order_ts": F.date_format("order_ts", "yyyy-MM-dd HH:mm:ss")})


def coerce_boolean(spark, sf):
    li = _t(spark, sf, "lineitem")
    text = F.when(F.col("l_returnflag") == "A", " True").when(F.col("l_returnflag") == "N", "0").when(F.col("l_linestatus") == "F", "y").otherwise("yes")
    return li.select(text.alias("raw")).groupBy("raw").agg(F.count("*").alias("n")).select("raw", coerce.boolean_text(F.col("raw")).alias("value"), "n")


def coerce_edge_cases(spark, sf):
    """Forms that casts take and a strict parser does not, and the reverse."""
    forms = [" 3 ", "+5", "3.0", "1e3", "1_000", "9223372036854775808", "1d", "nan", "20240115", "2024-1-5", "2024-01", "2024-01-15", " 2024-01-15", "2024-01-15 10:00:00", "T10:00", "2024-01-15T10:00:00+02:00", "y", "2024-W03-1", "", "no"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(forms)], "id long, v string").join(_t(spark, sf, "region").where("r_regionkey = 0").select("r_regionkey"))
    v = F.col("v")
    return df.select(
        "id", coerce.integer_text(v).alias("as_integer"), F.when(~F.isnan(coerce.float_text(v)), coerce.float_text(v)).alias("as_float"), coerce.boolean_text(v).alias("as_boolean"),
        coerce.date_text(v).cast("string").alias("as_date"), F.date_format(coerce.timestamp_text(v), "yyyy-MM-dd HH:mm:ss").alias("as_timestamp"),
    )


def coerce_json_number(spark, sf):
    e = _t(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("v"))
    raw = coerce.Raw(F.try_variant_get("v", "$.k", "variant"), "variant")
    return e.select("event_id", raw.to("integer").alias("k"), raw.to("float").alias("k_float"), raw.to("string").alias("k_text"))


def _broken(spark, sf) -> Scan:
    """Events as text rows: every 7th without a value, every 11th with one that is no number, every 13th with a bad time."""
    e = _t(spark, sf, "events")
    value = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("string"))
    ts = F.when(F.col("event_id") % 13 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    raw = e.select("event_id", F.col("event_id").cast("string").alias("id"), ts.alias("ts"), F.col("event_type").alias("type"), value.alias("value"))
    return _scan(raw, "event_id", ["id", "ts", "type", "value"])


EVENT_COLUMNS = (Column("id", "id", "integer"), Column("ts", "ts", "timestamp"), Column("type", "type", "string"), Column("value", "value", "float"))


def strict_partition_good(spark, sf):
    return check(_broken(spark, sf), EVENT_COLUMNS, keep_raw=False).good().select("id", "type", "value")


def strict_partition_bad(spark, sf):
    return check(_broken(spark, sf), EVENT_COLUMNS).bad().select("row_number", "column", "error")


def quarantine_by_column(spark, sf):
    return strict_partition_bad(spark, sf).groupBy("column").agg(F.count("*").alias("n"))


def quarantine_by_error(spark, sf):
    return strict_partition_bad(spark, sf).groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(20)


def quarantine_threshold(spark, sf):
    policy = Quarantine("unused", max_invalid_fraction=0.28)
    scan = _broken(spark, sf)
    df = check(scan, EVENT_COLUMNS, keep_raw=False).df
    sums = df.groupBy("type").agg(F.count("*").alias("total"), F.count("_error").alias("invalid"))
    return sums.select("type", "total", "invalid", ((F.col("total") > 0) & (F.col("invalid") / F.col("total") > policy.max_invalid_fraction)).alias("exceeded"))


def quarantine_raw_row(spark, sf):
    """The row as it was, inside the sidecar's JSON."""
    bad = check(_broken(spark, sf), EVENT_COLUMNS).bad()
    v = F.parse_json("row")
    return bad.select("row_number", dotted_get(v, "id").alias("id"), dotted_get(v, "value").alias("value"))


def validate_failures(spark, sf):
    return validate.failures(_broken(spark, sf), EVENT_COLUMNS)


def drift_required_null(spark, sf):
    got = validate.drift(_broken(spark, sf), (*EVENT_COLUMNS, Column("country", "country", "string")))
    return got.select("column", "kind", "rows", F.array_join(F.transform("first_rows", lambda x: x.cast("string")), ",").alias("first_rows"))


def infer_schema_profile(spark, sf):
    o = _t(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"), F.col("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("minute"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_day"), F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("no").alias("final"), F.when(F.col("o_custkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("none").alias("mixed"), F.lit("").alias("nothing"),
    )
    return infer.profile_frame(o, o.columns)


# -- change data


def _changes(spark, sf) -> DataFrame:
    e = _t(spark, sf, "events")
    op = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "I").otherwise("U")
    ops = {"insert": ("I",), "update": ("U",), "delete": ("D",)}
    return e.select((F.col("event_id") + 1).alias("_row"), "user_id", F.floor(F.col("value")).cast("long").alias("seq"), "value", cdc.operation(op, ops).alias(cdc.OPERATION))


def cdc_latest(spark, sf):
    return cdc.latest(_changes(spark, sf), ["user_id"], "seq").select("user_id", "seq", F.col("_row").alias("row_number"), F.col(cdc.OPERATION).alias("operation"))


def cdc_tie_errors(spark, sf):
    return cdc.errors(_changes(spark, sf), ["user_id"], "seq").select(F.col("_row").alias("row_number"))


def cdc_merge(spark, sf):
    target = _t(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(-1).cast("long").alias("seq"), F.col("c_acctbal").alias("value"))
    newest = cdc.latest(_changes(spark, sf), ["user_id"], "seq").select("user_id", "seq", "value", cdc.OPERATION)
    return cdc.merge(target, newest, ["user_id"])


# -- destinations and provenance


def append_rerun(spark, sf):
    """Two files appended, the second twice: its rows are there once."""
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    table = Table(spark, _temporary(spark, "append"))
    table.ensure(schema.declared((Column("key", "key", "integer"), Column("name", "name", "string"))))
    for part in (0, 1, 1):
        table.append(with_provenance(n.where(F.col("key") % 2 == part), f"file{part}", "2024-01-01"), f"file{part}")
    return table.read().select("key", "name", F.col(schema.HASH).alias("file_hash"))


def truncate_last_wins(spark, sf):
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    table = Table(spark, _temporary(spark, "truncate"))
    table.ensure(schema.declared((Column("key", "key", "integer"), Column("name", "name", "string"))))
    for part in (0, 1):
        table.truncate(with_provenance(n.where(F.col("key") % 2 == part), f"file{part}", "2024-01-01"), f"file{part}")
    return table.read().select("key", "name", F.col(schema.HASH).alias("file_hash"))


def cdc_apply(spark, sf):
    """Changes applied to a stored table, twice; the second time does nothing."""
    table = Table(spark, _temporary(spark, "cdc"))
    table.ensure(schema.declared((Column("user_id", "user_id", "integer"), Column("seq", "seq", "integer"), Column("value", "value", "float"))))
    newest = cdc.latest(_changes(spark, sf), ["user_id"], "seq").select("user_id", "seq", "value", cdc.OPERATION)
    for _ in range(2):
        table.apply(with_provenance(newest, "changes", "2024-01-01"), ["user_id"], "changes")
    return table.read().select("user_id", "seq", "value")


def append_after_merge(spark, sf):
    """Changes merged, customers appended beside them, then the changes of every third user deleted: nothing else is lost."""
    table = Table(spark, _temporary(spark, "merged"), buckets=16)
    table.ensure(schema.declared((Column("user_id", "user_id", "integer"), Column("seq", "seq", "integer"), Column("value", "value", "float"))))
    newest = cdc.latest(_changes(spark, sf), ["user_id"], "seq").select("user_id", "seq", "value", cdc.OPERATION)
    table.apply(with_provenance(newest, "first", "2024-01-01"), ["user_id"], "first")
    more = _t(spark, sf, "customer").select((F.col("c_custkey") + 1_000_000).cast("long").alias("user_id"), F.lit(0).cast("long").alias("seq"), F.col("c_acctbal").cast("double").alias("value"))
    for _ in range(2):
        table.append(with_provenance(more, "customers", "2024-01-01"), "customers")
    gone = newest.where(F.col("user_id") % 3 == 0).withColumn(cdc.OPERATION, F.lit("delete"))
    table.apply(with_provenance(gone, "second", "2024-01-01"), ["user_id"], "second")
    return table.read().select("user_id", "seq", "value")


def provenance_lineage(spark, sf):
    """Rows and totals of each source file, where a month stands for a file."""
    o = _t(spark, sf, "orders")
    by = F.sha2(F.date_format("o_orderdate", "yyyy-MM"), 256)
    return o.groupBy(F.substring(by, 1, 12).alias("file_hash")).agg(F.count("*").alias("rows"), F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total"))


def dedup_by_content_hash(spark, sf):
    """Registered twice from a directory where nations of one region are equal files: one record a content, under its first name."""
    folder = _temporary(spark, "copies")
    for r in _t(spark, sf, "nation").collect():
        _put(spark, f"{folder}/n{r['n_nationkey']:02d}.csv", f"region\n{r['n_regionkey']}\n".encode())
    audit = Audit(":memory:")
    for _ in range(2):
        found = register(spark, audit, folder, _pipeline("region", "integer"))
    copies = spark.createDataFrame([(c.content_hash,) for c in found.candidates], "content_hash string").groupBy("content_hash").agg(F.count("*").alias("copies"))
    return audit.frame(spark).select("content_hash", F.col("filename").alias("first_name")).join(copies, "content_hash")


def registration_anti_join(spark, sf):
    """Candidates of a directory: content that is new or pending, not what the audit store has loaded under any name."""
    folder, rows = _temporary(spark, "inbox"), _t(spark, sf, "nation").collect()
    audit = Audit(":memory:")
    for r in rows:
        data = f"{r['n_name']}\n".encode()
        _put(spark, f"{folder}/{r['n_name']}.csv", data)
        if r["n_nationkey"] % 3 == 0:
            h = hashlib.sha256(data).hexdigest()
            audit.insert_pending("other name.csv", h)
            if r["n_nationkey"] % 2 == 0:
                audit.claim(h, "w", "r")
                audit.committed(h, 1)
    found = register(spark, audit, folder, _pipeline("name", "string"))
    return spark.createDataFrame([(c.name, c.size, c.content_hash) for c in found.candidates], "name string, size long, content_hash string")


def register_files(spark, sf):
    """Orders of each clerk's customers as files of a watched folder, some with a sidecar of each kind: listed, hashed and joined with what is
    loaded and with their sidecars, twice, the second time from the index."""
    folder = _temporary(spark, "watched")
    o = _t(spark, sf, "orders").select((F.col("o_custkey") % 200).alias("k"), F.col("o_orderkey").alias("mark"), F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("line"))
    job = stage_files(o.select(F.format_string("%03d", "k").alias("key"), "mark", "line"), folder)
    run = {"job": {"namespace": "n", "name": "orders"}}
    sides = [json.dumps(run), "{", "[]", '{"job": {}}', json.dumps(run | {"manifest_version": "9"}), json.dumps(run | {"source_range": 5})]
    job.publish(lambda f: (f"{folder}/o{f.key}.csv", sides[int(f.key) % 7] if int(f.key) % 7 < 6 else None))
    index, config = Index(spark, _temporary(spark, "index")), parse({"format": "csv", "dest_table": "t", "columns": [{"source": "a", "dest": "a", "type": "string"}]})
    index.loaded([r["content_hash"] for r in found(spark, folder, config, index).where("name < 'o050'").collect()], "e")  # 50 files
    return found(spark, folder, config, index, "e").select("name", "size", "content_hash", "category", F.col("manifest.name").alias("source"))


def schema_diff(spark, sf):
    """The declared columns of orders against what its table has."""
    declared = {"o_orderkey": "bigint", "o_orderstatus": "VARCHAR", "o_totalprice": "date", "o_discount": "double"}
    actual = {f.name: f.dataType.simpleString() for f in _t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").schema}
    return spark.createDataFrame([(c, what) for c, what, _, _ in schema.differences(declared, actual)], "column string, difference string")


# -- audit read models


def _records(spark, sf) -> DataFrame:
    """Orders as audit records."""
    o = _t(spark, sf, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "COMMITTED").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("PENDING")
    return o.select(
        F.col("o_orderkey").cast("string").alias("content_hash"), F.concat(F.lit("file"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("filename"), state.alias("state"), (F.col("o_custkey") % 5).alias("attempt_count"),
        F.lit("bad row").alias("error_message"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"), F.floor("o_totalprice").cast("long").alias("row_count"),
        F.when(F.col("o_custkey") % 10 == 0, F.lit(3)).cast("long").alias("quarantined_row_count"),
    )


def audit_status(spark, sf):
    return audit_views.by_state(_records(spark, sf))


def audit_recent_failures(spark, sf):
    return audit_views.recent_failures(_records(spark, sf)).select("filename", "content_hash", "updated_at")


def audit_overview(spark, sf):
    return audit_views.overview(_records(spark, sf))


def _failed(spark, sf) -> Audit:
    """Suppliers as files that have failed 0 to 4 times more than once."""
    audit = Audit(":memory:")
    for r in _t(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey").orderBy("s_suppkey").collect():
        audit.insert_pending(r["s_name"], str(r["s_suppkey"]))
        for _ in range(r["s_nationkey"] % 5 + 1):
            audit.failed(str(r["s_suppkey"]), "bad row")
    return audit


def requeue_eligible(spark, sf):
    """What the next run tries again: failed fewer times than the cap."""
    audit = _failed(spark, sf)
    audit.retry_failed(3)
    return audit.frame(spark).where("state = 'PENDING'").select("content_hash", "attempt_count")


def requeue_terminal(spark, sf):
    """What an operator sends back: failed for good, with attempts from nought."""
    audit = _failed(spark, sf)
    audit.requeue_all(3)
    return audit.frame(spark).where("state = 'PENDING'").select("content_hash", "attempt_count", "error_message")


# -- crypto


def hmac_token(spark, sf):
    return _t(spark, sf, "customer").select("c_custkey", crypto.hmac_token(F.col("c_name"), KEY).alias("token"))


def aes_roundtrip(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("name"))
    c = c.withColumn("name", crypto.sealed(F.col("name"), KEY)).withColumn("name", crypto.frame(F.col("name")))
    return c.select("c_custkey", crypto.decrypt(F.col("name"), KEY).alias("name"))


# -- files, batches, cursors


def fixed_width_slice(spark, sf):
    line = F.concat(F.lpad(F.col("p_partkey").cast("string"), 8, " "), F.rpad("p_name", 30, " "), F.rpad("p_brand", 12, " "), F.lpad(F.col("p_size").cast("string"), 4, "0"))
    path = _written(spark, _t(spark, sf, "part").select(line.alias("value")), "fixed")
    got = readers.scan(spark, path, "fixed_width", layout=[("key", 1, 8), ("name", 9, 30), ("brand", 39, 12), ("size", 51, 4)])
    return check(got, (Column("key", "part_key", "integer"), Column("name", "name", "string"), Column("brand", "brand", "string"), Column("size", "size", "integer")), keep_raw=False).good()


def csv_scan(spark, sf):
    """Quotes, commas and line feeds inside cells; a column that is not declared; empty cells that may be so."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))
    name = F.concat(F.lit('Mr "'), F.col("c_name"), F.lit('", of\n'), F.col("c_mktsegment"))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), quoted(name), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_acctbal").cast("string")), F.lit("x"))
    lines = spark.createDataFrame([(-1, "key,name,balance,more")], "c_custkey long, value string").unionByName(_t(spark, sf, "customer").select(F.col("c_custkey").cast("long"), line.alias("value")))
    got = readers.scan(spark, _written(spark, lines.orderBy("c_custkey"), "csv"), "csv")
    return check(got, (Column("key", "key", "integer"), Column("name", "name", "string"), Column("balance", "balance", "float", required=False)), keep_raw=False).good()


def encoded_scan(spark, sf):
    """Objects in UTF-16 in files that many tasks write, read by as many tasks as these have splits; some characters hold the byte of a line feed."""
    text = F.concat(F.lit('\u0a0a "'), "o_orderstatus", F.lit('",\n'), "o_orderpriority")
    price = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    path = _temporary(spark, "encoded")
    _t(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), text.alias("text"), price.alias("price")).write.option("encoding", "UTF-16LE").json(path)
    got = readers.scan(spark, path, "ndjson", "utf-16le", wanted=["key", "text", "price"])
    return check(got, (Column("key", "key", "integer"), Column("text", "text", "string"), Column("price", "price", "float", required=False)), keep_raw=False).good()


def ndjson_scan(spark, sf):
    """JSON keeps its types: a number is cut to an integer, the same digits in quotes are one, true is no text but True."""
    e = _t(spark, sf, "events")
    value = F.to_json(F.struct("event_id", F.col("value").alias("n"), F.col("user_id").cast("string").alias("q"), (F.col("event_id") % 2 == 0).alias("even")))
    got = readers.scan(spark, _written(spark, e.select(value.alias("value")), "ndjson"), "ndjson", wanted=["event_id", "n", "q", "even"])
    return check(got, (Column("event_id", "event_id", "integer"), Column("n", "n", "integer"), Column("q", "q", "integer"), Column("even", "even", "string")), keep_raw=False).good()


def parquet_scan(spark, sf):
    """Native columns, read as the declared types."""
    got = readers.scan(spark, f"{sf}/orders.parquet", "parquet")
    columns = (Column("o_orderkey", "key", "integer"), Column("o_totalprice", "whole", "integer"), Column("o_orderstatus", "status", "string"), Column("o_orderdate", "day", "string"))
    return check(got, columns, keep_raw=False).good().withColumn("day", F.substring("day", 1, 10))


def excel_scan(spark, sf):
    """A workbook of the customers, on its second sheet, with shared and inline strings; a task writes it and a task reads it."""
    path = _temporary(spark, "customers") + ".xlsx"
    books = {
        "xl/workbook.xml": f'<workbook xmlns="{_SHEETS}" xmlns:r="{_OFFICE}"><sheets><sheet name="Notes" sheetId="1" r:id="rId1"/><sheet name="Customers" sheetId="2" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_OFFICE}/worksheet" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_SHEETS}"><sheetData><row><c t="inlineStr"><is><t>note</t></is></c></row></sheetData></worksheet>',
    }

    def write(parts):
        import pyarrow as pa

        store, at = store_of(path)
        n, shared = 0, []
        with store.open_output_stream(at, compression=None) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in books.items():
                z.writestr(name, text)
            with z.open("xl/worksheets/sheet2.xml", "w", force_zip64=True) as sheet:
                line = lambda cells: sheet.write(f"<row>{''.join(cells)}</row>".encode())
                text = lambda v: f'<c t="inlineStr"><is><t>{escape(v)}</t></is></c>'
                sheet.write(f'<worksheet xmlns="{_SHEETS}"><sheetData>'.encode())
                line(map(text, ("key", "name", "segment", "balance")))
                for batch in parts:
                    for r in batch.to_pylist():
                        if r["c_mktsegment"] not in shared:  # there are five
                            shared.append(r["c_mktsegment"])
                        line((f"<c><v>{r['c_custkey']}</v></c>", text(r["c_name"]), f'<c t="s"><v>{shared.index(r["c_mktsegment"])}</v></c>', f"<c><v>{r['c_acctbal']!r}</v></c>"))
                        n += 1
                sheet.write(b"</sheetData></worksheet>")
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_SHEETS}">{"".join(f"<si><t>{escape(x)}</t></si>" for x in shared)}</sst>')
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    _t(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("double")).coalesce(1).mapInArrow(write, "n long").collect()
    got = readers.scan(spark, path, "excel", sheet="Customers")
    return check(got, (Column("key", "key", "integer"), Column("name", "name", "string"), Column("segment", "segment", "string"), Column("balance", "balance", "float")), keep_raw=False).good()


def preview_window(spark, sf):
    """Rows 11 to 20 of a file, by their numbers."""
    lines = F.concat(F.col("o_orderkey").cast("string"), F.lit(","), F.col("o_orderpriority"))
    head = spark.createDataFrame([(-1, "key,priority")], "o_orderkey long, value string")
    path = _written(spark, head.unionByName(_t(spark, sf, "orders").select(F.col("o_orderkey").cast("long"), lines.alias("value"))).orderBy("o_orderkey"), "preview")
    part = readers.window(readers.scan(spark, path, "csv"), 11, 10)
    return part.df.select(part.values["key"].to("integer").alias("o_orderkey"), part.values["priority"].text.alias("priority"))


def compact_batches(spark, sf):
    """Nations as files, compacted by 7 in order of path; a second run finds nothing to do."""
    source, target = _temporary(spark, "small"), _temporary(spark, "compacted")
    for r in _t(spark, sf, "nation").collect():
        _put(spark, f"{source}/{r['n_name']}.ndjson", f'{{"name":   "{r["n_name"]}"}}\n\n'.encode())
    first, second = (compact.compact(spark, source, target, 7) for _ in range(2))
    rows = spark.read.text(f"{target}/*.ndjson").select(F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)\.ndjson$", 1).cast("long").alias("batch"), F.get_json_object("value", "$.name").alias("name"))
    more = F.lit(second["batches"] + first["files_compacted"] - 25).cast("long").alias("left_over")
    return rows.groupBy("batch").agg(F.count("*").alias("files"), F.min("name").alias("first_name"), F.max("name").alias("last_name"), more)


def compact_again(spark, sf):
    """Lines of orders as many files, half of them compacted, then all that is new: two runs with one time of day keep every line once."""
    source, target, now = _temporary(spark, "lines"), _temporary(spark, "joined"), datetime(2024, 1, 1, tzinfo=UTC)
    lines = _t(spark, sf, "orders").select(F.to_json(F.struct("o_orderkey", "o_orderpriority")).alias("line"), (F.col("o_orderkey") % 20).alias("k"), F.col("o_orderkey").alias("mark"))
    for half in (0, 1):
        job = stage_files(lines.where(F.col("k") % 2 == half).select(F.format_string("o%02d.ndjson", "k").alias("key"), "mark", "line"), source)
        job.publish(lambda f: (f"{source}/{f.key}", None))
        compact.compact(spark, source, target, 3, now=now)
    rows = spark.read.text(f"{target}/*.ndjson")
    return rows.select(F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"), F.get_json_object("value", "$.o_orderpriority").alias("priority"))


def materialize_events(spark, sf):
    """Events as messages of a log in four partitions, taken to files in two drains that go on from each other: rows by file."""
    e = _t(spark, sf, "events").withColumn("partition", (F.col("user_id") % 4).cast("int"))
    value = F.encode(F.to_json(F.struct("event_id", "user_id", "event_type", "value")), "UTF-8")
    sent = cut(e.select(F.lit("events").alias("topic"), "partition", F.col("event_id").alias("offset"), value.alias("value")), 1).withColumn("offset", F.col("cut"))
    base = _temporary(spark, "queue")
    plan = materialize.parse_plan({"name": "q", "log": f"{base}/log", "inbox": f"{base}/in", "staging": f"{base}/staging", "checkpoint": f"{base}/checkpoint", "batch_size": 500})
    for part in (F.col("offset") < 700, F.col("offset") >= 700):
        append_log(sent.where(part), plan.log, 300)
        materialize.drain(materialize.source(spark, plan), plan)
    rows = spark.read.option("pathGlobFilter", "*.ndjson").text(plan.inbox).select(F.from_json("value", "event_id long, user_id long, event_type string, value double").alias("v"), F.col("_metadata.file_name").alias("file"))
    return rows.select("v.*", "file")


def microbatch_cut(spark, sf):
    e = _t(spark, sf, "events").select(F.lit("events").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"))
    return cut(e, 100).groupBy("partition", "cut").agg(F.min("offset").alias("start_offset"), F.max("offset").alias("end_offset"), F.count("*").alias("messages"))


def _paged(records: DataFrame, size: int) -> DataFrame:
    """records (mark, record) with the page of each, from 1, in order of mark: numbered in many tasks, as messages of a queue are."""
    sent = records.select(F.lit("").alias("topic"), F.lit(0).alias("partition"), F.col("mark").cast("long").alias("offset"), "record")
    return cut(sent, size).select(F.col("offset").alias("mark"), "record", (F.col("cut") + 1).alias("page"))


def _served(spark, records: DataFrame, size: int, counted: bool = True):
    """A server of records (mark, record, at), in numbered pages of this size that lie as files in the shared folder. Asked for
    records `since` a cursor, it pages through those alone, which lie in a folder of their own."""
    folder = _temporary(spark, "served")

    def put(part: DataFrame, name: str) -> int:
        job = stage_files(_paged(part, size).select(F.col("page").cast("string").alias("key"), "mark", F.col("record").alias("line")), folder)
        job.publish(lambda f: (f"{folder}/{name}/{f.key}.ndjson", None))
        return len(job.files)

    pages: dict[str, int] = {}

    def transport(url, params, headers):
        name, number = params.get("since", "all"), params.get("page", 1)
        there = range(number, (number if "page" in params else pages.get(name, 0)) + 1)
        lines = [x for i in there if i <= pages.get(name, 0) for x in read_text(f"{folder}/{name}/{i}.ndjson").splitlines()]
        link = {"Link": f'<{url}?page={pages.get(name, 0)}&per_page={size}>; rel="last"'} if counted else {}
        return fetch.Response(200, {"data": [json.loads(x) for x in lines]}, link)

    def serve(part: DataFrame, since: str = "all") -> None:
        pages[since] = put(part, since)

    serve(records)
    return transport, serve


def _suppliers(spark, sf) -> DataFrame:
    at = F.format_string("%02d-%06d", F.col("s_nationkey"), F.col("s_suppkey"))
    return _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("mark"), at.alias("at"), F.to_json(F.struct(F.col("s_suppkey").alias("id"), F.struct(at.alias("at")).alias("meta"))).alias("record"))


def max_cursor(spark, sf):
    """The cursor after a fetch that starts anew, and after one that finds nothing newer."""
    source = fetch.Source("s", "https://api.example", records_path="data", cursor_field="meta.at", cursor_param="since", page_size=30)
    transport, _ = _served(spark, _suppliers(spark, sf), 30, counted=False)
    base = _temporary(spark, "fetched")
    cursors = fetch.CursorStore(f"{tempfile.mkdtemp(prefix='harborline-')}/cursors.json")  # of the driver, as in a run
    done = [fetch.run_fetch(spark, source, transport, f"{base}/in", f"{base}/staging", cursors) for _ in range(2)]
    return spark.createDataFrame([(i + 1, x["cursor"], x["records"]) for i, x in enumerate(done)], "run long, cursor string, records long")


def cursor_filter(spark, sf):
    """One document whose records are compared with the cursor by its reader, as text."""
    transport, _ = _served(spark, _suppliers(spark, sf), 1_000_000)
    got = read_api(spark, fetch.Source("s", "https://api.example", records_path="data", cursor_field="meta.at"), transport, "12-")
    return got.select(F.get_json_object("record", "$.id").cast("long").alias("id"), F.col("cursor").alias("at"))


def fetch_pages(spark, sf):
    """Customers as pages of an API, asked for in ranges side by side; later customers by a second run, which sends the cursor: rows of both
    runs' files."""
    c = _t(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("mark"), F.to_json(F.struct("c_custkey", "c_name", F.format_string("%012d", F.col("c_custkey")).alias("changed"))).alias("record"))
    middle = c.agg(F.floor(F.avg("mark"))).first()[0]
    transport, serve = _served(spark, c.where(F.col("mark") <= middle), 100)
    source = fetch.parse_source({"name": "customers", "url": "https://api.example/customers", "record_path": "data", "cursor": {"field": "changed", "param": "since"}, "page_size": 100})
    base, cursors = _temporary(spark, "fetched"), fetch.CursorStore(f"{tempfile.mkdtemp(prefix='harborline-')}/cursors.json")
    for k in range(2):
        if k:
            serve(c.where(F.col("mark") > middle), cursors.get("customers"))
        fetch.run_fetch(spark, source, transport, f"{base}/in{k}", f"{base}/staging", cursors, file_records=1000, pages_per_task=4)
    row = F.from_json("value", "c_custkey long, c_name string, changed string")
    rows = [spark.read.option("pathGlobFilter", "*.ndjson").text(f"{base}/in{k}").select(F.lit(k).cast("long").alias("run"), row.alias("r")) for k in range(2)]
    return rows[0].unionByName(rows[1]).select("run", "r.*")


# -- authoring, whole runs, quarantine and destinations


def _broken_csv(spark, sf) -> str:
    rows = _broken(spark, sf)
    line = F.concat_ws(",", *(v.text for v in rows.values.values()))
    head = spark.createDataFrame([(0, ",".join(rows.names))], f"{ROW} long, value string")
    return _written(spark, head.unionByName(rows.df.select(F.col(ROW).cast("long"), line.alias("value"))).orderBy(ROW), "broken")


def authoring_report(spark, sf):
    """What a report says of each area, and the cells that do not load."""
    raw = {"format": "csv", "dest_table": "t", "columns": [{"source": c.source, "dest": c.dest, "type": c.type} for c in EVENT_COLUMNS]}
    report = authoring.examine(spark, _broken_csv(spark, sf), raw)
    rows = [(a, all(f.ok for f in report.of(a)), report.rows, report.failing_cells if a == "strict" else 0) for a in authoring.AREAS]
    return spark.createDataFrame(rows, "area string, ok boolean, rows long, failing_cells long")


def draft_from_sample(spark, sf):
    """The columns that a draft starts with: types of the whole sample, all of them required."""
    draft = authoring.from_sample(spark, _broken_csv(spark, sf), "events", "csv", rows=1000)
    return spark.createDataFrame([(c["source"], c["type"], c["required"], draft.evidence[c["source"]].null_count) for c in draft.raw["columns"]], "source string, type string, required boolean, null_count long")


def _sidecar(spark, sf) -> str:
    """The rows of _broken that do not load, as a quarantine's sidecar; its folder."""
    bad = check(_broken(spark, sf), EVENT_COLUMNS, keep_raw=True).bad()
    folder = _temporary(spark, "quarantine")
    job, named, _ = quarantine.stage_sidecars(bad, folder, "events.csv", "a" * 64, _t(spark, sf, "events").count())
    job.publish(named)
    return folder


def quarantine_redrop(spark, sf):
    """Rows of a sidecar, as they were in their file."""
    row = F.from_json("value", "id string, type string, value string")
    return quarantine.redrop(spark, _sidecar(spark, sf)).select(row.alias("r")).select("r.id", "r.type", "r.value")


def quarantine_triage(spark, sf):
    return quarantine.triage(spark, _sidecar(spark, sf)).groupBy("file", "column").agg(F.count("*").alias("n"), F.min("row_number").alias("first_row"))


def parquet_inference(spark, sf):
    found = infer.infer_parquet(_t(spark, sf, "lineitem").schema)
    return spark.createDataFrame([(c.name, c.type, c.confidence) for c in found], "column string, type string, confidence string")


def column_tolerance(spark, sf):
    """Columns that only the file has, and required ones that it lacks."""
    fit = validate.tolerance(readers.scan(spark, f"{sf}/nation.parquet", "parquet").names, (Column("n_nationkey", "key", "integer"), Column("n_code", "code", "string"), Column("n_more", "more", "string", required=False)))
    return spark.createDataFrame([(c, "extra") for c in fit.extra] + [(c, "missing") for c in fit.missing], "column string, kind string")


def one_source_two_columns(spark, sf):
    c = _t(spark, sf, "customer")
    rows = _scan(c.select(F.col("c_custkey"), F.col("c_custkey").cast("string").alias("key"), "c_name"), "c_custkey", ["key", "c_name"])
    return check(rows, (Column("key", "key", "integer"), Column("key", "key_text", "string"), Column("c_name", "name", "string")), keep_raw=False).good()


def pipeline_run(spark, sf):
    """A run over a folder: a file of each region's nations, one of them twice, one with a bad key; then the same run again."""
    folder, raw = _temporary(spark, "run"), {"format": "csv", "dest_table": "nations", "columns": [{"source": "key", "dest": "key", "type": "integer"}, {"source": "name", "dest": "name", "type": "string"}]}
    files: dict[str, list[str]] = {}
    for r in _t(spark, sf, "nation").orderBy("n_nationkey").collect():  # 25 rows
        files.setdefault(f"region{r['n_regionkey']}", []).append(f"{r['n_nationkey']},{r['n_name']}")
    files |= {"same": files["region0"], "wrong": ["x,NOWHERE"]}
    for name, lines in files.items():
        _put(spark, f"{folder}/{name}.csv", "\n".join(["key,name", *lines, ""]).encode())
    audit, warehouse = Audit(":memory:"), _temporary(spark, "warehouse")
    done = [run(spark, folder, parse(raw), audit, warehouse) for _ in range(2)]
    loaded = Table(spark, f"{warehouse}/nations").read().select("key").distinct().count()
    return spark.createDataFrame([(i, x.committed, x.failed, x.rows, loaded) for i, x in enumerate(done)], "run long, committed long, failed long, rows long, loaded long")


def audit_listing(spark, sf):
    return audit_views.listing(_failed(spark, sf).frame(spark)).select("filename", "content_hash", "state", "attempt_count", "error_message")


def status_summary(spark, sf):
    audit = _failed(spark, sf)
    audit.retry_failed(3)
    return spark.createDataFrame(list(export.status(spark, audit)["by_state"].items()), "state string, files long")


def _stored(spark, sf, kind: str):
    """The latest changes in a database of this kind, after an older table of customers; applied twice."""
    folder = _temporary(spark, kind).removeprefix("file://")
    os.makedirs(folder)
    table = destination(spark, {"type": kind, "path": f"{folder}/x.db"}, "t", "")
    table.ensure(schema.declared((Column("user_id", "user_id", "integer"), Column("seq", "seq", "integer"), Column("value", "value", "float"))))
    before = _t(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("user_id"), F.lit(-1).cast("long").alias("seq"), F.col("c_acctbal").cast("double").alias("value"))
    for _ in range(2):
        table.append(with_provenance(before, "customers", "2024-01-01"), "customers")
    newest = cdc.latest(_changes(spark, sf), ["user_id"], "seq").select("user_id", "seq", "value", cdc.OPERATION)
    for _ in range(2):
        table.apply(with_provenance(newest, "changes", "2024-01-01"), ["user_id"], "changes")
    return table.read(_temporary(spark, "read")).select("user_id", "seq", "value")


def duckdb_cdc(spark, sf):
    return _stored(spark, sf, "duckdb")


def sqlite_cdc(spark, sf):
    return _stored(spark, sf, "sqlite")


QUERIES = {
    f.__name__: f
    for f in (
        transform_cast, coerce_boolean, coerce_edge_cases, coerce_json_number, strict_partition_good, strict_partition_bad, quarantine_by_column, quarantine_by_error, quarantine_threshold, quarantine_raw_row,
        validate_failures, drift_required_null, infer_schema_profile, cdc_latest, cdc_tie_errors, cdc_merge, append_rerun, truncate_last_wins, cdc_apply, append_after_merge, provenance_lineage, dedup_by_content_hash, registration_anti_join, register_files,
        schema_diff, audit_status, audit_recent_failures, audit_overview, requeue_eligible, requeue_terminal, hmac_token, aes_roundtrip,
        authoring_report, draft_from_sample, quarantine_redrop, quarantine_triage, parquet_inference, column_tolerance, one_source_two_columns, pipeline_run, audit_listing, status_summary, duckdb_cdc, sqlite_cdc,
        fixed_width_slice, csv_scan, encoded_scan, ndjson_scan, parquet_scan, excel_scan, preview_window, compact_batches, compact_again, microbatch_cut, materialize_events, max_cursor, cursor_filter, fetch_pages,
    )
}

_BROKEN = """b AS (
  SELECT event_id, event_id + 1 AS row_number, event_type AS type, value,
         event_id % 7 = 0 AS no_value, event_id % 7 <> 0 AND event_id % 11 = 0 AS bad_value, event_id % 13 = 0 AS bad_ts FROM events
), e AS (
  SELECT row_number, 'ts' AS "column", 'Cannot coerce ''ts''=''yesterday'' to timestamp' AS error, 1 AS pos FROM b WHERE bad_ts
  UNION ALL SELECT row_number, 'value', 'Required column ''value'' is empty', 2 FROM b WHERE no_value
  UNION ALL SELECT row_number, 'value', 'Cannot coerce ''value''=''n/a'' to float', 2 FROM b WHERE bad_value
), f AS (
  SELECT row_number, "column", error FROM e QUALIFY row_number() OVER (PARTITION BY row_number ORDER BY pos) = 1
)"""
_CHANGES = """c AS (
  SELECT event_id + 1 AS r, user_id, CAST(floor(value) AS BIGINT) AS seq, value, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS operation FROM events
), l AS (
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC, r) = 1
)"""
_RECORDS = """r AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS content_hash, 'file' || o_orderkey || '.csv' AS filename,
         CASE o_orderstatus WHEN 'F' THEN 'COMMITTED' WHEN 'P' THEN 'FAILED' ELSE 'PENDING' END AS state, o_custkey % 5 AS attempt_count,
         strftime(o_orderdate, '%Y-%m-%d') AS updated_at, CAST(floor(o_totalprice) AS BIGINT) AS row_count, CASE WHEN o_custkey % 10 = 0 THEN 3 END AS quarantined FROM orders
)"""
_PADS = "".join(f"\\x{b ^ 0x36:02X}" for b in KEY.ljust(64, b"\0")), "".join(f"\\x{b ^ 0x5C:02X}" for b in KEY.ljust(64, b"\0"))

ORACLE_SQL = {
    "transform_cast": """SELECT o_orderkey AS order_key, o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d') AS order_date, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS order_ts,
        CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS is_final, o_orderpriority AS priority FROM orders""",
    "coerce_boolean": """SELECT raw, CASE WHEN lower(trim(raw)) IN ('true', '1', 'yes') THEN true WHEN lower(trim(raw)) IN ('false', '0', 'no') THEN false END AS value, count(*) AS n FROM (
        SELECT CASE WHEN l_returnflag = 'A' THEN ' True' WHEN l_returnflag = 'N' THEN '0' WHEN l_linestatus = 'F' THEN 'y' ELSE 'yes' END AS raw FROM lineitem) GROUP BY raw""",
    "coerce_edge_cases": """SELECT * FROM (VALUES
        (0, 3, 3.0, NULL, NULL, NULL), (1, 5, 5.0, NULL, NULL, NULL), (2, NULL, 3.0, NULL, NULL, NULL), (3, NULL, 1000.0, NULL, NULL, NULL), (4, 1000, 1000.0, NULL, NULL, NULL), (5, NULL, 9223372036854775808.0, NULL, NULL, NULL),
        (6, NULL, NULL, NULL, NULL, NULL), (7, NULL, NULL, NULL, NULL, NULL), (8, 20240115, 20240115.0, NULL, '2024-01-15', '2024-01-15 00:00:00'), (9, NULL, NULL, NULL, NULL, NULL), (10, NULL, NULL, NULL, NULL, NULL),
        (11, NULL, NULL, NULL, '2024-01-15', '2024-01-15 00:00:00'), (12, NULL, NULL, NULL, NULL, NULL), (13, NULL, NULL, NULL, NULL, '2024-01-15 10:00:00'), (14, NULL, NULL, NULL, NULL, NULL),
        (15, NULL, NULL, NULL, NULL, '2024-01-15 08:00:00'), (16, NULL, NULL, NULL, NULL, NULL), (17, NULL, NULL, NULL, '2024-01-15', '2024-01-15 00:00:00'), (18, NULL, NULL, NULL, NULL, NULL), (19, NULL, NULL, false, NULL, NULL)
        ) AS t(id, as_integer, as_float, as_boolean, as_date, as_timestamp)""",
    "coerce_json_number": "SELECT event_id, try_cast(props->>'$.k' AS BIGINT) AS k, try_cast(props->>'$.k' AS DOUBLE) AS k_float, props->>'$.k' AS k_text FROM events",
    "strict_partition_good": f"WITH {_BROKEN} SELECT event_id AS id, type, value FROM b WHERE NOT no_value AND NOT bad_value AND NOT bad_ts",
    "strict_partition_bad": f"WITH {_BROKEN} SELECT * FROM f",
    "quarantine_by_column": f'WITH {_BROKEN} SELECT "column", count(*) AS n FROM f GROUP BY 1',
    "quarantine_by_error": f"WITH {_BROKEN} SELECT error, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, error LIMIT 20",
    "quarantine_threshold": f"WITH {_BROKEN} SELECT type, count(*) AS total, count(f.row_number) AS invalid, count(f.row_number) / count(*) > 0.28 AS exceeded FROM b LEFT JOIN f ON b.row_number = f.row_number GROUP BY type",
    "quarantine_raw_row": f"WITH {_BROKEN} SELECT f.row_number, CAST(event_id AS VARCHAR) AS id, CASE WHEN no_value THEN '' WHEN bad_value THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value FROM f JOIN b ON b.row_number = f.row_number",
    "validate_failures": f'WITH {_BROKEN} SELECT row_number, "column", error FROM e',
    "drift_required_null": f"""WITH {_BROKEN} SELECT 'country' AS "column", 'absent' AS kind, 0 AS rows, '' AS first_rows
        UNION ALL SELECT 'value', 'required_null', count(*), array_to_string((array_agg(row_number ORDER BY row_number))[1:5], ',') FROM b WHERE no_value""",
    "infer_schema_profile": """WITH t AS (SELECT count(*) AS n, count(*) FILTER (o_custkey % 5 = 0) AS p FROM orders) SELECT v.c AS "column", v.t AS type, v.f AS confidence, CASE v.c WHEN 'priority' THEN p WHEN 'nothing' THEN n ELSE 0 END AS null_count
        FROM t, (VALUES ('key', 'integer', 'high'), ('price', 'float', 'high'), ('day', 'date', 'high'), ('minute', 'timestamp', 'high'), ('us_day', 'string', 'ambiguous'), ('final', 'boolean', 'high'), ('priority', 'string', 'low'), ('mixed', 'string', 'ambiguous'), ('nothing', 'string', 'ambiguous')) AS v(c, t, f)""",
    "cdc_latest": f"WITH {_CHANGES} SELECT user_id, seq, r AS row_number, operation FROM l",
    "cdc_tie_errors": f"WITH {_CHANGES} SELECT r AS row_number FROM (SELECT r, seq, max(seq) OVER (PARTITION BY user_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM c) WHERE m = seq",
    "cdc_merge": f"WITH {_CHANGES} SELECT c_custkey AS user_id, -1 AS seq, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l) UNION ALL SELECT user_id, seq, value FROM l WHERE operation <> 'delete'",
    "append_rerun": "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, 'file' || (n_nationkey % 2) AS file_hash FROM nation",
    "truncate_last_wins": "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, 'file1' AS file_hash FROM nation WHERE n_nationkey % 2 = 1",
    "cdc_apply": f"WITH {_CHANGES} SELECT user_id, seq, value FROM l WHERE operation <> 'delete'",
    "append_after_merge": f"""WITH {_CHANGES} SELECT user_id, seq, value FROM l WHERE operation <> 'delete' AND user_id % 3 <> 0
        UNION ALL SELECT c_custkey + 1000000, 0, c_acctbal FROM customer""",
    "compact_again": "SELECT o_orderkey, o_orderpriority AS priority FROM orders",
    "materialize_events": """WITH m AS (SELECT *, user_id % 4 AS p, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS o FROM events),
        c AS (SELECT *, o >= 700 AS later, CASE WHEN o < 700 THEN o // 500 ELSE (o - 700) // 500 END AS cut FROM m)
        SELECT event_id, user_id, event_type, value, 'q-events-' || p || '-' || min(o) OVER w || '-' || max(o) OVER w || '.ndjson' AS file FROM c WINDOW w AS (PARTITION BY p, later, cut)""",
    "fetch_pages": """SELECT CASE WHEN c_custkey <= (SELECT floor(avg(c_custkey)) FROM customer) THEN 0 ELSE 1 END::BIGINT AS run, c_custkey::BIGINT AS c_custkey, c_name,
        lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS changed FROM customer""",
    "register_files": """WITH f AS (SELECT o_custkey % 200 AS k, string_agg(o_orderkey || ',' || o_orderpriority || chr(10), '' ORDER BY o_orderkey) AS body FROM orders GROUP BY 1)
        SELECT 'o' || lpad(CAST(k AS VARCHAR), 3, '0') || '.csv' AS name, CAST(strlen(body) AS BIGINT) AS size, sha256(body) AS content_hash,
          [NULL, 'malformed_json', 'invalid_shape', 'missing_required_field', 'unsupported_version', 'invalid_source_range', 'missing'][k % 7 + 1] AS category, CASE WHEN k % 7 = 0 THEN 'orders' END AS source
        FROM f WHERE k >= 50""",
    "provenance_lineage": "SELECT left(sha256(strftime(o_orderdate, '%Y-%m')), 12) AS file_hash, count(*) AS rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders GROUP BY 1",
    "dedup_by_content_hash": """WITH f AS (SELECT n_nationkey, sha256('region' || chr(10) || n_regionkey || chr(10)) AS content_hash FROM nation)
        SELECT content_hash, 'n' || lpad(CAST(min(n_nationkey) AS VARCHAR), 2, '0') || '.csv' AS first_name, count(*) AS copies FROM f GROUP BY 1""",
    "registration_anti_join": """SELECT n_name || '.csv' AS name, CAST(strlen(n_name) + 1 AS BIGINT) AS size, sha256(n_name || chr(10)) AS content_hash FROM nation WHERE n_nationkey % 6 <> 0""",
    "schema_diff": """SELECT * FROM (VALUES ('o_discount', 'missing'), ('o_orderpriority', 'extra'), ('o_totalprice', 'type_mismatch')) AS t("column", difference)""",
    "audit_status": f"WITH {_RECORDS} SELECT s.state, count(r.state) AS files FROM (VALUES ('PENDING'), ('PROCESSING'), ('COMMITTED'), ('FAILED')) AS s(state) LEFT JOIN r ON r.state = s.state GROUP BY s.state",
    "audit_recent_failures": f"WITH {_RECORDS} SELECT filename, content_hash, updated_at FROM r WHERE state = 'FAILED' ORDER BY updated_at DESC, content_hash LIMIT 10",
    "audit_overview": f"WITH {_RECORDS} SELECT count(*) AS total, count(*) FILTER (state = 'PENDING') AS pending, count(*) FILTER (state = 'PROCESSING') AS processing, count(*) FILTER (state = 'COMMITTED') AS committed, count(*) FILTER (state = 'FAILED') AS failed, CAST(sum(row_count) AS BIGINT) AS total_rows, CAST(coalesce(sum(quarantined), 0) AS BIGINT) AS quarantined_rows FROM r",
    "requeue_eligible": "SELECT CAST(s_suppkey AS VARCHAR) AS content_hash, s_nationkey % 5 + 1 AS attempt_count FROM supplier WHERE s_nationkey % 5 + 1 < 3",
    "requeue_terminal": "SELECT CAST(s_suppkey AS VARCHAR) AS content_hash, 0 AS attempt_count, CAST(NULL AS VARCHAR) AS error_message FROM supplier WHERE s_nationkey % 5 + 1 >= 3",
    "hmac_token": f"SELECT c_custkey, to_base64(unhex(sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(c_name)))))) AS token FROM customer",
    "aes_roundtrip": "SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_name ELSE '' END AS name FROM customer",
    "fixed_width_slice": "SELECT p_partkey AS part_key, trim(left(p_name, 30)) AS name, trim(left(p_brand, 12)) AS brand, CAST(p_size AS BIGINT) AS size FROM part",
    "preview_window": "SELECT o_orderkey, o_orderpriority AS priority FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 10",
    "csv_scan": """SELECT c_custkey AS key, 'Mr "' || c_name || '", of' || chr(10) || c_mktsegment AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS balance FROM customer""",
    "encoded_scan": """SELECT o_orderkey AS key, chr(2570) || ' "' || o_orderstatus || '",' || chr(10) || o_orderpriority AS text, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price FROM orders""",
    "ndjson_scan": "SELECT event_id, CAST(trunc(value) AS BIGINT) AS n, CAST(user_id AS BIGINT) AS q, CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END AS even FROM events",
    "parquet_scan": "SELECT o_orderkey AS key, CAST(trunc(o_totalprice) AS BIGINT) AS whole, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
    "excel_scan": "SELECT c_custkey::BIGINT AS key, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer",
    "compact_batches": "SELECT batch, count(*) AS files, min(n_name) AS first_name, max(n_name) AS last_name, CAST(0 AS BIGINT) AS left_over FROM (SELECT n_name, CAST((row_number() OVER (ORDER BY n_name || '.ndjson') - 1) // 7 + 1 AS BIGINT) AS batch FROM nation) GROUP BY batch",
    "microbatch_cut": 'SELECT "partition", cut, min(o) AS start_offset, max(o) AS end_offset, count(*) AS messages FROM (SELECT CAST(user_id % 4 AS INTEGER) AS "partition", event_id AS o, CAST((row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1) // 100 AS BIGINT) AS cut FROM events) GROUP BY ALL',
    "max_cursor": """WITH s AS (SELECT max(lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || '-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0')) AS cursor, count(*) AS n FROM supplier)
        SELECT CAST(1 AS BIGINT) AS run, cursor, n AS records FROM s UNION ALL SELECT 2, cursor, 0 FROM s""",
    "cursor_filter": """SELECT s_suppkey AS id, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || '-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS at FROM supplier WHERE s_nationkey >= 12""",
    "authoring_report": f"""WITH {_BROKEN}, n AS (SELECT (SELECT count(*) FROM b) AS rows, (SELECT count(*) FROM e) AS cells)
        SELECT area, area <> 'strict' OR cells = 0 AS ok, rows, CASE WHEN area = 'strict' THEN cells ELSE 0 END AS failing_cells
        FROM n, (VALUES ('config'), ('encryption'), ('write_mode'), ('parser'), ('tolerance'), ('strict')) AS v(area)""",
    "draft_from_sample": f"""WITH {_BROKEN}, s AS (SELECT count(*) FILTER (no_value) AS n FROM (SELECT * FROM b ORDER BY row_number LIMIT 1000))
        SELECT source, type, true AS required, CASE WHEN source = 'value' THEN n ELSE 0 END AS null_count
        FROM s, (VALUES ('id', 'integer'), ('ts', 'string'), ('type', 'string'), ('value', 'string')) AS v(source, type)""",
    "quarantine_redrop": f"WITH {_BROKEN} SELECT CAST(event_id AS VARCHAR) AS id, type, CASE WHEN no_value THEN '' WHEN bad_value THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value FROM f JOIN b ON b.row_number = f.row_number",
    "quarantine_triage": f"""WITH {_BROKEN} SELECT 'events.aaaaaaaaaaaa.quarantine.ndjson' AS file, "column", count(*) AS n, min(row_number) AS first_row FROM f GROUP BY 2""",
    "parquet_inference": """SELECT column_name AS "column", CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'SMALLINT', 'TINYINT') THEN 'integer' WHEN column_type IN ('DOUBLE', 'FLOAT') THEN 'float'
        WHEN column_type = 'DATE' THEN 'date' WHEN column_type LIKE 'TIMESTAMP%' THEN 'timestamp' WHEN column_type = 'BOOLEAN' THEN 'boolean' ELSE 'string' END AS type, 'high' AS confidence FROM (DESCRIBE lineitem)""",
    "column_tolerance": """SELECT column_name AS "column", 'extra' AS kind FROM (DESCRIBE nation) WHERE column_name <> 'n_nationkey' UNION ALL SELECT 'n_code', 'missing'""",
    "one_source_two_columns": "SELECT CAST(c_custkey AS BIGINT) AS key, CAST(c_custkey AS VARCHAR) AS key_text, c_name AS name FROM customer",
    "pipeline_run": "SELECT CAST(0 AS BIGINT) AS run, count(DISTINCT n_regionkey) AS committed, CAST(1 AS BIGINT) AS failed, count(*) AS rows, count(*) AS loaded FROM nation UNION ALL SELECT 1, 0, 1, 0, count(*) FROM nation",
    "audit_listing": "SELECT s_name AS filename, CAST(s_suppkey AS VARCHAR) AS content_hash, 'FAILED' AS state, s_nationkey % 5 + 1 AS attempt_count, 'bad row' AS error_message FROM supplier",
    "status_summary": """SELECT state, CASE state WHEN 'PENDING' THEN (SELECT count(*) FROM supplier WHERE s_nationkey % 5 + 1 < 3) WHEN 'FAILED' THEN (SELECT count(*) FROM supplier WHERE s_nationkey % 5 + 1 >= 3) ELSE 0 END AS files
        FROM (VALUES ('PENDING'), ('PROCESSING'), ('COMMITTED'), ('FAILED')) AS v(state)""",
}
ORACLE_SQL |= {k: ORACLE_SQL["cdc_merge"] for k in ("duckdb_cdc", "sqlite_cdc")}
