"""Compaction: many small NDJSON files into few, each batch complete or absent.

Batches are cut by number of files in order of path. Every batch is one task that streams its files, so batches go in parallel
and none is held in memory. Files are opened with pyarrow.fs, on any store that driver and executors share.

Which sources are done is told by manifests in a hidden folder, one for each batch. A task writes the manifest of its batch first;
it counts from when the batch has its final name. So a run that stops half way has lost nothing and the next does not repeat
what was finished. Where sources are deleted, the manifest goes after them, and a run begins by ending such deletions. A manifest knows a
file by name, size and modification time, so another file that later takes the name is not taken for it.

Batches are named by the time to the microsecond, their number and a random part, and never replace a file: two runs, in one
process or in two, cannot overwrite each other's.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import list_files
from ..sources.stores import store_of

MANIFESTS = ".harborline"


def batch_numbers(files: DataFrame, max_files: int) -> DataFrame:
    """files (path, ...) with batch, from 1, by order of path."""
    order = Window.orderBy("path")  # one row a file: a listing, not data
    return files.withColumn("batch", F.floor((F.row_number().over(order) - 1) / max_files).cast("long") + 1)


def _manifests(source: str):
    """(path, content) of the manifests of batches that are complete."""
    from pyarrow import fs

    store, base = store_of(source)
    for f in store.get_file_info(fs.FileSelector(f"{base}/{MANIFESTS}", allow_not_found=True)):
        if f.path.endswith(".json"):
            with store.open_input_stream(f.path) as s:
                m = json.loads(s.read())
            other, target = store_of(m["batch"])
            if other.get_file_info(target).type == fs.FileType.File:
                yield f.path, m


def _mark(uri: str) -> list:
    """Size and modification time of a file, which tell it from a later one of the same name."""
    store, at = store_of(uri)
    info = store.get_file_info(at)
    return [info.size, info.mtime_ns]


def finished(source: str) -> set[str]:
    """Names of the files in batches that are complete."""
    base = source.rstrip("/")
    return {n for _, m in _manifests(source) for n in m["files"] if n not in m.get("marks", {}) or m["marks"][n] == _mark(f"{base}/{n}")}


def _end_deletions(source: str) -> None:
    """Delete what is left of sources whose batch is complete, then their manifests."""
    store, base = store_of(source)
    for path, m in _manifests(source):
        if m.get("delete"):
            for n in m["files"]:
                if m["marks"][n] == _mark(f"{base}/{n}"):
                    store.delete_file(f"{base}/{n}")
            store.delete_file(path)


def _write_batch(paths: list[str], target: str, manifest: str, compress: bool, delete: bool) -> None:
    from pyarrow import fs

    store, final = store_of(target)
    part = f"{final}.{uuid.uuid4().hex}.tmp"
    marks = {p.rsplit("/", 1)[-1]: _mark(p) for p in paths}
    try:
        with store.open_output_stream(part, compression=None) as raw:
            sink = gzip.GzipFile(fileobj=raw, mode="wb") if compress else raw
            for p in paths:
                other, at = store_of(p)
                with other.open_input_file(at) as lines:
                    for line in io.TextIOWrapper(lines, encoding="utf-8"):
                        if line.strip():
                            sink.write((json.dumps(json.loads(line), ensure_ascii=False) + "\n").encode())
            if compress:
                sink.close()
        if store.get_file_info(final).type != fs.FileType.NotFound:
            raise FileExistsError(target)
        other, at = store_of(manifest)
        with other.open_output_stream(at, compression=None) as log:
            log.write(json.dumps({"batch": target, "files": list(marks), "marks": marks, "delete": delete}).encode())
        store.move(part, final)
    except BaseException:
        if store.get_file_info(part).type == fs.FileType.File:
            store.delete_file(part)
        raise


def compact(spark: SparkSession, source: str, target: str, max_files: int = 1000, compress: bool = False, delete_source: bool = False, now: datetime | None = None) -> dict:
    """Returns batches and files_compacted."""
    _end_deletions(source)
    done = finished(source)
    names = [(p,) for p, _ in list_files(spark, source, "*.ndjson") if p.rsplit("/", 1)[-1] not in done]
    if not names:
        return {"batches": 0, "files_compacted": 0}
    stamp = (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%S.%fZ")
    run = uuid.uuid4().hex[:8]
    suffix = ".ndjson.gz" if compress else ".ndjson"
    for folder in (target, f"{source.rstrip('/')}/{MANIFESTS}"):
        store, at = store_of(folder)
        store.create_dir(at, recursive=True)
    groups = batch_numbers(spark.createDataFrame(names, "path string"), max_files).groupBy("batch").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()

    def work(rows):
        for r in rows:
            name = f"{stamp}_{run}_{r['batch']:04d}"
            manifest = f"{source.rstrip('/')}/{MANIFESTS}/{name}.json"
            _write_batch(r["paths"], f"{target.rstrip('/')}/{name}{suffix}", manifest, compress, delete_source)
            if delete_source:
                for p in [*r["paths"], manifest]:
                    store, at = store_of(p)
                    store.delete_file(at)
            yield len(r["paths"])

    made = spark.sparkContext.parallelize(groups, len(groups)).mapPartitions(work).collect()
    return {"batches": len(made), "files_compacted": sum(made)}
