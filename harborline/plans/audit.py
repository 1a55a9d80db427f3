"""The audit store: one record for each content hash and its state, in SQLite on the driver.

Claims are compare-and-swap updates, which file tables cannot do; everything that only reads goes through DataFrames.
States: PENDING, then PROCESSING, then COMMITTED or FAILED; retries and reclaims lead back to PENDING.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

STATES = ("PENDING", "PROCESSING", "COMMITTED", "FAILED")
#: Columns of a record, in order, with their SQLite and Spark types.
FIELDS = {
    "id": ("INTEGER PRIMARY KEY", "long"), "filename": ("TEXT NOT NULL", "string"), "source_dir": ("TEXT", "string"), "content_hash": ("TEXT NOT NULL UNIQUE", "string"),
    "state": ("TEXT NOT NULL", "string"), "attempt_count": ("INTEGER NOT NULL DEFAULT 0", "long"), "error_message": ("TEXT", "string"), "worker_id": ("TEXT", "string"), "run_id": ("TEXT", "string"),
    "row_count": ("INTEGER", "long"), "claimed_at": ("TEXT", "string"), "created_at": ("TEXT NOT NULL", "string"), "updated_at": ("TEXT NOT NULL", "string"),
    "source_type": ("TEXT", "string"), "source_name": ("TEXT", "string"), "producer": ("TEXT", "string"), "external_run_id": ("TEXT", "string"), "manifest_payload": ("TEXT", "string"),
    "manifest_version": ("TEXT", "string"), "manifest_started_at": ("TEXT", "string"), "manifest_finished_at": ("TEXT", "string"), "manifest_record_count": ("INTEGER", "long"), "source_range": ("TEXT", "string"),
    "quarantined_row_count": ("INTEGER", "long"), "quarantine_path": ("TEXT", "string"),
}
TABLE = "etl_file_audit"
MANIFEST_FIELDS = [k for k in FIELDS if k in ("source_type", "source_name", "producer", "external_run_id", "source_range") or k.startswith("manifest_")]


class Audit:
    def __init__(self, path: str, clock=lambda: datetime.now(UTC)):
        self.path = path.removeprefix("sqlite:///")
        self.clock = clock
        self.db = sqlite3.connect(self.path, isolation_level=None, timeout=30, check_same_thread=False)
        self.db.row_factory = sqlite3.Row
        self.db.execute(f"CREATE TABLE IF NOT EXISTS {TABLE} ({', '.join(f'{k} {t}' for k, (t, _) in FIELDS.items())})")
        have = {r["name"] for r in self.db.execute(f"PRAGMA table_info({TABLE})")}
        for k, (t, _) in FIELDS.items():
            if k not in have:
                self.db.execute(f"ALTER TABLE {TABLE} ADD COLUMN {k} {t.replace(' NOT NULL', '').replace(' UNIQUE', '')}")

        # what has been noted elsewhere of committed records holds while this value does: it changes when one is not committed any more
        self.db.execute("CREATE TABLE IF NOT EXISTS harborline_epoch (value TEXT)")
        self.db.execute("INSERT INTO harborline_epoch SELECT hex(randomblob(16)) WHERE NOT EXISTS (SELECT 1 FROM harborline_epoch)")
        for name, event in (("reopened", f"UPDATE OF state ON {TABLE} WHEN OLD.state = 'COMMITTED' AND NEW.state <> 'COMMITTED'"), ("removed", f"DELETE ON {TABLE} WHEN OLD.state = 'COMMITTED'")):
            self.db.execute(f"CREATE TRIGGER IF NOT EXISTS harborline_{name} AFTER {event} BEGIN UPDATE harborline_epoch SET value = hex(randomblob(16)); END")

    def epoch(self) -> str:
        return self.db.execute("SELECT value FROM harborline_epoch").fetchone()[0]

    def _now(self) -> str:
        return self.clock().isoformat()

    def _set(self, where: str, args: tuple, **values) -> int:
        values["updated_at"] = self._now()
        sets = ", ".join(f"{k} = {v.sql}" if isinstance(v, _Sql) else f"{k} = ?" for k, v in values.items())
        return self.db.execute(f"UPDATE {TABLE} SET {sets} WHERE {where}", (*(v for v in values.values() if not isinstance(v, _Sql)), *args)).rowcount

    # -- transitions

    def insert_pending(self, filename: str, content_hash: str, source_dir: str | None = None, **manifest) -> bool:
        """False if the hash is known, whatever its file was called."""
        row = {"filename": filename, "source_dir": source_dir, "content_hash": content_hash, "state": "PENDING", "created_at": self._now(), "updated_at": self._now()} | {k: v for k, v in manifest.items() if k in MANIFEST_FIELDS}
        return self.db.execute(f"INSERT OR IGNORE INTO {TABLE} ({', '.join(row)}) VALUES ({', '.join('?' * len(row))})", tuple(row.values())).rowcount == 1

    def claim(self, content_hash: str, worker: str, run: str) -> bool:
        return self._set("content_hash = ? AND state = 'PENDING'", (content_hash,), state="PROCESSING", worker_id=worker, run_id=run, claimed_at=self._now()) == 1

    def committed(self, content_hash: str, rows: int, quarantined: int = 0, quarantine_path: str | None = None) -> None:
        self._set("content_hash = ?", (content_hash,), state="COMMITTED", row_count=rows, error_message=None, quarantined_row_count=quarantined, quarantine_path=quarantine_path)

    def failed(self, content_hash: str, error: str) -> None:
        self._set("content_hash = ?", (content_hash,), state="FAILED", error_message=error, attempt_count=_Sql("attempt_count + 1"))

    def retry_failed(self, cap: int) -> int:
        return self._set("state = 'FAILED' AND attempt_count < ?", (cap,), state="PENDING")

    def reclaim_stale(self, minutes: int) -> int:
        limit = (self.clock() - timedelta(minutes=minutes)).isoformat()
        return self._set("state = 'PROCESSING' AND claimed_at < ?", (limit,), state="PENDING", attempt_count=_Sql("attempt_count + 1"))

    def requeue(self, reference: str, cap: int) -> tuple[str, list[str]]:
        """(requeued | missing | ambiguous | not_terminal, hashes): one record by hash, or by name if it is the only terminal one."""
        found = self.lookup(reference)
        if not found:
            return "missing", []
        terminal = [r for r in found if r["state"] == "FAILED" and r["attempt_count"] >= cap]
        if len(terminal) > 1:
            return "ambiguous", [r["content_hash"] for r in terminal]
        if not terminal:
            return "not_terminal", [r["content_hash"] for r in found]
        self._set("content_hash = ?", (terminal[0]["content_hash"],), state="PENDING", attempt_count=0, error_message=None)
        return "requeued", [terminal[0]["content_hash"]]

    def requeue_all(self, cap: int) -> int:
        return self._set("state = 'FAILED' AND attempt_count >= ?", (cap,), state="PENDING", attempt_count=0, error_message=None)

    # -- lookups

    def terminal(self, cap: int) -> list[dict]:
        """Records that have failed for good."""
        return [dict(r) for r in self.db.execute(f"SELECT * FROM {TABLE} WHERE state = 'FAILED' AND attempt_count >= ? ORDER BY id", (cap,))]

    def known(self, hashes: Iterable[str]) -> dict[str, str]:
        """The states of those hashes that have a record; a listing is looked up by index, however long the store is."""
        asked, out = sorted(set(hashes)), {}
        for i in range(0, len(asked), 500):
            some = asked[i : i + 500]
            out |= {r["content_hash"]: r["state"] for r in self.db.execute(f"SELECT content_hash, state FROM {TABLE} WHERE content_hash IN ({', '.join('?' * len(some))})", some)}
        return out

    def get(self, content_hash: str) -> dict | None:
        row = self.db.execute(f"SELECT * FROM {TABLE} WHERE content_hash = ?", (content_hash,)).fetchone()
        return dict(row) if row else None

    def lookup(self, reference: str) -> list[dict]:
        """By content hash first, then by file name."""
        for key in ("content_hash", "filename"):
            if rows := self.db.execute(f"SELECT * FROM {TABLE} WHERE {key} = ? ORDER BY id", (reference,)).fetchall():
                return [dict(r) for r in rows]
        return []

    def lineage(self, reference: str) -> tuple[str, list[dict]]:
        """(found | ambiguous | missing, records)."""
        rows = self.lookup(reference)
        return ("missing" if not rows else "found" if len(rows) == 1 else "ambiguous"), rows

    def frame(self, spark: SparkSession) -> DataFrame:
        """All records, for the read models."""
        rows = [tuple(r) for r in self.db.execute(f"SELECT {', '.join(FIELDS)} FROM {TABLE}")]
        return spark.createDataFrame(rows, ", ".join(f"{k} {t}" for k, (_, t) in FIELDS.items()))

    def ping(self) -> None:
        self.db.execute("SELECT 1").fetchone()

    def close(self) -> None:
        self.db.close()


class _Sql:
    def __init__(self, sql: str):
        self.sql = sql
