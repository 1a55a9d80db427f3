"""Destination tables on plain files, with atomic commits.

A table is a folder with version folders and a pointer, CURRENT, which is replaced in one rename. Readers resolve the pointer
first, so a version that is still being written is never seen. Three writes:

* append: a file's rows live in a folder of their own; a version lists its parts. Writing a hash again replaces its part, so a
  retry leaves one copy, and rows of no file at all leave none.
* truncate: the new version has this file's part alone.
* cdc: merged rows live in buckets by a hash of their keys, a folder each. A change file rewrites the buckets that its keys fall
  into and no others; parts that were appended since are taken into theirs. The pointer names the folder of each bucket and
  the hashes that have been applied, so data and marker commit together and a retry is a no-op.

Appended parts and merged buckets are read together. Writers of one table take turns by a lock, which its holder renews; one that
has lost it, or finds that the pointer has moved, fails its commit. vacuum() deletes what no version points to any more.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cdc import merge
from .schema import AT, HASH, require

POINTER = "CURRENT"
BUCKET = "_harborline_bucket"


class CommitConflict(RuntimeError):
    """Another writer has committed since this one began."""


@dataclass
class State:
    version: int = 0
    schema: str = ""
    parts: dict[str, str] = field(default_factory=dict)  # content hash to folder
    base: str = ""  # folder of a merged version without buckets, as older tables have it
    applied: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)  # of the buckets
    bucket_count: int = 0
    buckets: dict[str, str] = field(default_factory=dict)  # number to folder, of those that have rows
    folded: list[str] = field(default_factory=list)  # hashes of parts that are in buckets now

    def copy(self, **change) -> State:
        return State(**(self.__dict__ | change))


class Table:
    def __init__(self, spark: SparkSession, path: str, stale_lock_s: float = 1800, buckets: int = 64):
        """buckets: of a table that change files are merged into, fixed by its first merge. The more, the less a small file rewrites."""
        self.spark, self.path, self.stale_lock_s, self.bucket_count = spark, path.rstrip("/"), stale_lock_s, buckets
        self._token: str | None = None

    # -- files, through Hadoop's file systems

    def _path(self, name: str = ""):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _read(self, name: str) -> str | None:
        p, store = self._path(name)
        if not store.exists(p):
            return None
        stream = store.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        p, store = self._path(name)
        out = store.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def state(self) -> State | None:
        raw = self._read(POINTER)
        return State(**json.loads(raw)) if raw else None

    def _commit(self, old: State | None, new: State) -> None:
        """The pointer holds the whole state, so replacing it is the commit."""
        now = self.state()
        if (now.version if now else 0) != (old.version if old else 0):
            raise CommitConflict(f"{self.path} is at version {now.version if now else 0} now")
        if self._token and self._read("_lock") != self._token:
            raise CommitConflict(f"{self.path}: the lock was lost to another writer")
        new.version = (old.version if old else 0) + 1
        temporary = f"_{POINTER}-{uuid.uuid4().hex}"
        self._write(temporary, json.dumps(new.__dict__))
        self._replace(temporary, POINTER)

    def _replace(self, source: str, target: str) -> None:
        s, store = self._path(source)
        t, _ = self._path(target)
        jvm = self.spark._jvm
        uri = t.toUri()
        if (uri.getScheme() or store.getUri().getScheme()) == "file":
            import os

            os.replace(s.toUri().getPath(), uri.getPath())
            for crc in (s.toUri().getPath(), uri.getPath()):
                head, _, name = crc.rpartition("/")
                if os.path.exists(f"{head}/.{name}.crc"):
                    os.unlink(f"{head}/.{name}.crc")
            return
        options = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        jvm.java.lang.reflect.Array.set(options, 0, getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri).rename(s, t, options)

    def lock(self):
        return _Lock(self)

    # -- reading

    def exists(self) -> bool:
        return self.state() is not None

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.state().schema))

    def _frame(self, state: State, folders: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state.schema))
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def read(self, *hashes: str) -> DataFrame:
        """All rows, or those of some files: their own folders alone, and of merged rows those that a filter lets through."""
        state = self.state()
        merged = [*([state.base] if state.base else []), *state.buckets.values()]
        if not hashes:
            return self._frame(state, [*state.parts.values(), *merged])
        rows = self._frame(state, [p for h, p in state.parts.items() if h in hashes])
        return rows.unionByName(self._frame(state, merged).where(F.col(HASH).isin(*hashes))) if merged else rows

    # -- writing

    def ensure(self, schema: T.StructType) -> None:
        """Make the table, or check that it is what is declared; it is never changed to fit."""
        state = self.state()
        if state is None:
            with self.lock():
                if self.state() is None:
                    self._commit(None, State(schema=schema.json()))
        else:
            require(schema, T.StructType.fromJson(json.loads(state.schema)))

    def _stage(self, df: DataFrame, state: State) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        schema = T.StructType.fromJson(json.loads(state.schema))
        df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema)).write.parquet(f"{self.path}/{folder}")
        return folder

    def append(self, df: DataFrame, content_hash: str, check=None) -> int:
        return self._replace_part(df, content_hash, False, check)

    def truncate(self, df: DataFrame, content_hash: str, check=None) -> int:
        return self._replace_part(df, content_hash, True, check)

    def _replace_part(self, df: DataFrame, content_hash: str, alone: bool, check) -> int:
        state = self.state()
        folder = self._stage(df, state)
        rows = self.spark.read.schema(T.StructType.fromJson(json.loads(state.schema))).parquet(f"{self.path}/{folder}").count()
        if check:
            check(rows)  # may raise: what was staged is then never pointed to
        with self.lock():
            state = self.state()
            parts = {} if alone else {h: p for h, p in state.parts.items() if h != content_hash}
            if rows:
                parts[content_hash] = folder
            if alone:
                new = state.copy(parts=parts, base="", buckets={}, keys=[], bucket_count=0, folded=[])
            else:
                new = self._without(state, content_hash).copy(parts=parts)
            self._commit(state, new)
        return rows

    def _without(self, state: State, content_hash: str) -> State:
        """The state whose merged rows are those of other files. Buckets without a row of this one stay as they are."""
        if state.base:  # an older table: not known which files it holds
            if not self._frame(state, [state.base]).where(F.col(HASH) == content_hash).limit(1).count():
                return state
            return state.copy(base=self._stage(self._frame(state, [state.base]).where(F.col(HASH) != content_hash), state))
        if content_hash not in state.folded:
            return state
        rows = self._bucketed(self._frame(state, list(state.buckets.values())), state.keys, state.bucket_count)
        hit = {str(r[0]) for r in rows.where(F.col(HASH) == content_hash).select(BUCKET).distinct().collect()}  # at most bucket_count numbers
        rest = self._frame(state, [f for k, f in state.buckets.items() if k in hit]).where(F.col(HASH) != content_hash)
        kept = {k: f for k, f in state.buckets.items() if k not in hit}
        return state.copy(buckets=kept | (self._stage_buckets(rest, state, state.keys, state.bucket_count) if hit else {}), folded=[h for h in state.folded if h != content_hash])

    def _bucketed(self, df: DataFrame, keys: list[str], count: int) -> DataFrame:
        types = {f.name: f.dataType for f in self.schema()}
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*(F.col(f"`{k}`").cast(types[k]) for k in keys)), F.lit(count)).cast("int"))

    def _stage_buckets(self, df: DataFrame, state: State, keys: list[str], count: int) -> dict[str, str]:
        """Write rows by bucket; the folders of those that have rows. Rebalancing puts a bucket's rows together and splits large ones."""
        folder = f"data/{uuid.uuid4().hex}"
        schema = T.StructType.fromJson(json.loads(state.schema))
        rows = self._bucketed(df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema)), keys, count)
        rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        p, store = self._path(folder)
        names = [s.getPath().getName() for s in store.listStatus(p) if s.isDirectory()]
        return {n.rpartition("=")[2]: f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}

    def apply(self, changes: DataFrame, keys: list[str], content_hash: str) -> bool:
        """Merge one change a key. False if this hash was applied before."""
        with self.lock():
            state = self.state()
            if content_hash in state.applied:
                return False
            count = state.bucket_count or self.bucket_count
            same = state.keys == list(keys)
            # rows that are in no bucket of these keys yet: all of them are taken into theirs
            loose = [*state.parts.values(), *([state.base] if state.base else []), *([] if same else state.buckets.values())]
            staged = f"data/{uuid.uuid4().hex}"
            changes.write.parquet(f"{self.path}/{staged}")
            changes = self.spark.read.schema(changes.schema).parquet(f"{self.path}/{staged}")
            touched = self._bucketed(changes.select(*keys), keys, count).select(BUCKET)
            if loose:
                touched = touched.union(self._bucketed(self._frame(state, loose), keys, count).select(BUCKET))
            numbers = {str(r[0]) for r in touched.distinct().collect()}  # at most `count` of them
            old = self._frame(state, loose + [f for k, f in state.buckets.items() if same and k in numbers])
            kept = {k: f for k, f in state.buckets.items() if k not in numbers} if same else {}
            buckets = kept | self._stage_buckets(merge(old, changes, keys), state, keys, count)
            self._commit(state, state.copy(parts={}, base="", keys=list(keys), bucket_count=count, buckets=buckets, folded=sorted({*state.folded, *state.parts}), applied=[*state.applied, content_hash]))
            p, store = self._path(staged)
            store.delete(p, True)
        return True

    def vacuum(self, older_than_s: float = 7 * 86400) -> int:
        """Delete folders that the table does not point to and that are older than readers and writers live. How many."""
        state, (data, store) = self.state(), self._path("data")
        used, gone, before = {*state.parts.values(), *state.buckets.values(), state.base}, 0, (time.time() - older_than_s) * 1000

        def drop(status) -> int:
            return int(status.getModificationTime() <= before and store.delete(status.getPath(), True))

        for s in store.listStatus(data) if store.exists(data) else []:
            name = f"data/{s.getPath().getName()}"
            if name in used:
                continue
            if any(u.startswith(f"{name}/") for u in used):
                gone += sum(drop(x) for x in store.listStatus(s.getPath()) if x.isDirectory() and f"{name}/{x.getPath().getName()}" not in used)
            else:
                gone += drop(s)
        return gone


class _Lock:
    """A file that one writer can make. Its holder renews it, so that only one that has died is passed over."""

    def __init__(self, table: Table):
        self.table, self.done = table, threading.Event()

    def _renew(self) -> None:
        p, store = self.table._path("_lock")
        while not self.done.wait(self.table.stale_lock_s / 4):
            if self.table._read("_lock") == self.table._token:
                store.setTimes(p, int(time.time() * 1000), -1)

    def __enter__(self):
        p, store = self.table._path("_lock")
        parent, _ = self.table._path()
        store.mkdirs(parent)
        token = uuid.uuid4().hex
        for _ in range(600):
            try:
                out = store.create(p, False)
            except Exception:
                if store.exists(p) and time.time() - store.getFileStatus(p).getModificationTime() / 1000 > self.table.stale_lock_s:
                    store.delete(p, False)
                time.sleep(0.1)
                continue
            try:
                out.write(bytearray(token.encode()))
            finally:
                out.close()
            self.table._token = token
            threading.Thread(target=self._renew, daemon=True).start()
            return self
        raise CommitConflict(f"{self.table.path} is locked")

    def __exit__(self, *_):
        self.done.set()
        p, store = self.table._path("_lock")
        if self.table._read("_lock") == self.table._token:
            store.delete(p, False)
        self.table._token = None


def with_provenance(df: DataFrame, content_hash: str, at) -> DataFrame:
    """The content hash of the file and the one time of its load, on every row."""
    return df.withColumns({HASH: F.lit(content_hash), AT: F.lit(at).cast("timestamp")})
