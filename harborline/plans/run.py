"""The run: load every new file of a directory, whole or not at all, and record what became of it."""

from __future__ import annotations

import os
import socket
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crypto import encryption_key, protect, token_key
from ..operators import cdc as changes
from ..operators.quarantine import gate, stage_sidecars
from ..operators.schema import declared
from ..operators.destinations import destination
from ..operators.store import Table, with_provenance
from ..operators.transform import FAULT, Checked, check
from ..sources.files import Index
from ..sources.readers import ERROR, ROW, Scan, scan
from .audit import Audit
from .config import Pipeline
from .register import Candidate, register


class FileError(ValueError):
    """What fails a file, in words for its audit record."""


@dataclass
class Summary:
    committed: int = 0
    failed: int = 0
    skipped: int = 0
    new: int = 0
    reclaimed: int = 0
    retried: int = 0
    rows: int = 0
    quarantined: int = 0
    bytes: int = 0
    duration_s: float = 0.0


def open_scan(spark: SparkSession, path: str, config: Pipeline) -> Scan:
    layout = [(c.source, int(c.start), int(c.width)) for c in config.columns] if config.format == "fixed_width" else None
    wanted = [c.source for c in config.columns]
    if config.cdc:
        wanted = list(dict.fromkeys([*wanted, config.cdc.operation_column]))
    return scan(spark, path, config.format, config.encoding, layout, config.sheet, wanted)


def _protected(df: DataFrame, config: Pipeline) -> DataFrame:
    return protect(df, config.columns)


def _first_error(df: DataFrame, column: str) -> str | None:
    found = df.where(F.col(column).isNotNull()).orderBy(ROW).select(ROW, column).first()
    return f"row {found[0]}: {found[1]}" if found else None


def load_file(spark: SparkSession, table: Table, candidate: Candidate, config: Pipeline, now: datetime | None = None) -> tuple[int, int, str | None]:
    """Rows loaded, rows quarantined and where to. Raises FileError and leaves the table as it was if the file fails."""
    for c in config.columns:  # keys first: a missing one fails before any work
        if c.encrypt:
            encryption_key(c.encrypt.key)
        if c.hash:
            token_key(c.hash.key)
    source = open_scan(spark, candidate.path, config)
    at = now or datetime.now(UTC)
    extra = {}
    if config.write_mode == "cdc":
        op = source.raw(config.cdc.operation_column)
        extra[changes.OPERATION] = changes.operation(op.text if op else F.lit(None).cast("string"), config.cdc.operations)
    quarantines = config.quarantine is not None and config.write_mode != "cdc"
    checked = check(source, config.columns, keep_raw=quarantines, extra=extra)
    df = checked.df
    counts = df.agg(F.count("*").alias("rows"), F.count(ERROR).alias("unparsed"), F.count(FAULT).alias("bad")).first()
    if counts["unparsed"]:
        raise FileError(_first_error(df, ERROR))
    if counts["bad"] and not quarantines:
        raise FileError(_first_error(df, FAULT))
    if quarantines:
        gate(config.quarantine, counts["bad"], counts["rows"])
    if config.write_mode == "cdc":
        return _load_changes(table, checked, candidate, config, at, counts["rows"]), 0, None
    good = with_provenance(_protected(checked.good(), config), candidate.content_hash, at)
    path = job = None
    if counts["bad"]:
        # sidecars are written out before the commit and named after it, so a fault in them cannot follow the commit
        job, named, path = stage_sidecars(checked.bad(), config.quarantine.dir, candidate.name, candidate.content_hash, counts["rows"])

    def whole(rows: int) -> None:
        if rows != counts["rows"] - counts["bad"]:
            raise FileError(f"staged {rows} rows of {counts['rows'] - counts['bad']}; the file changed while it was read")

    try:
        rows = (table.truncate if config.write_mode == "truncate" else table.append)(good, candidate.content_hash, whole)
    except BaseException:
        if job:
            job.discard()
        raise
    if job:
        job.publish(named)
    return rows, counts["bad"], path


def _load_changes(table: Table, checked: Checked, candidate: Candidate, config: Pipeline, at: datetime, parsed: int) -> int:
    dest = {c.source: c.dest for c in config.columns}
    keys, sequence = [dest[k] for k in config.cdc.keys], dest[config.cdc.sequence_by]
    df = checked.df.select(ROW, changes.OPERATION, *(F.col(f"`{c.dest}`") for c in config.columns))
    df = _protected(df, config)
    if found := changes.errors(df, keys, sequence, ROW).orderBy(ROW).first():
        raise FileError(f"row {found[0]}: {found['error']}")
    rows = df.count()
    if rows != parsed:
        raise FileError(f"read {rows} rows of {parsed}; the file changed while it was read")
    newest = changes.latest(df, keys, sequence, ROW).drop(ROW)
    table.apply(with_provenance(newest, candidate.content_hash, at), keys, candidate.content_hash)
    return rows


def run(spark: SparkSession, directory: str, config: Pipeline, audit: Audit, warehouse: str = "", progress: Callable[[dict], None] | None = None, worker: str | None = None) -> Summary:
    """Recover, register, then claim and load each file in order of path. One file's failure does not stop the others."""
    tell = progress or (lambda event: None)
    began, out, run_id = time.time(), Summary(), uuid.uuid4().hex
    worker = worker or f"{socket.gethostname()}:{os.getpid()}"
    audit.ping()
    out.retried = audit.retry_failed(config.retry_cap)
    out.reclaimed = audit.reclaim_stale(config.stale_timeout_minutes)
    table = destination(spark, config.connector, config.dest_table, warehouse)
    table.ensure(declared(config.columns))
    # beside the tables that a warehouse has; other destinations have no folder for it
    found = register(spark, audit, directory, config, Index(spark, f"{warehouse.rstrip('/')}/.harborline") if warehouse else None)
    out.new, out.skipped, out.failed = found.new, found.skipped, len(found.refused)
    for c in found.candidates:
        if not audit.claim(c.content_hash, worker, run_id):
            continue  # another process, or the same content under another name
        tell({"phase": "load", "action": "start", "path": c.path})
        try:
            rows, bad, path = load_file(spark, table, c, config)
        except Exception as e:
            audit.failed(c.content_hash, str(e).split("\n\nJVM stacktrace")[0][:4000])
            out.failed += 1
            tell({"phase": "load", "action": "failed", "path": c.path, "error": str(e)})
            continue
        audit.committed(c.content_hash, rows, bad, path)
        out.committed, out.rows, out.quarantined, out.bytes = out.committed + 1, out.rows + rows, out.quarantined + bad, out.bytes + c.size
        tell({"phase": "load", "action": "committed", "path": c.path, "rows": rows})
    out.duration_s = time.time() - began
    tell({"phase": "run", "action": "done", **asdict(out)})
    return out


def health(spark: SparkSession, audit: Audit, table=None) -> dict[str, dict]:
    """ok, latency_ms and error of the audit store and of a destination of any kind."""
    out = {}
    probes = {"audit": audit.ping, "destination": lambda: (spark.sql("SELECT 1").first(), table is not None and table.state())}
    for name, probe in probes.items():
        began = time.perf_counter()
        try:
            probe()
            out[name] = {"ok": True, "latency_ms": round((time.perf_counter() - began) * 1000, 3), "error": None}
        except Exception as e:
            out[name] = {"ok": False, "latency_ms": round((time.perf_counter() - began) * 1000, 3), "error": str(e)}
    return out
