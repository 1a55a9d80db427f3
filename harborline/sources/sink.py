"""A sink of complete text files: executors write them, the driver names them.

Rows are (key, mark, line); all lines of a key are one file, in order of mark. It goes in two phases. Each task writes the files of its
keys into a folder of the job, under names of their own, and tells which it has finished. When all tasks have, what they told
is written beside the files: only then are they staged. Files of attempts that were killed, lost or repeated are in nobody's
account and go with the job's folder. Publishing is renames alone, sidecar before file, so a watcher that sees a file finds its
manifest; no row passes the driver. Publishing twice gives the same files under the same names.

Staging and target are on one store, which driver and executors share.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..plans.manifest import SUFFIX
from .stores import delete_folder, make_folder, move, qualified, read_text, store_of, write_text

NAME = "harborline_files"
ACCOUNT = "files.json"
#: Files that the driver names at a time.
NAMING = 16


@dataclass
class Staged:
    """A file that a task has finished: its key, path, number of lines, and the marks of the first and the last."""

    key: str
    path: str
    lines: int
    first: int
    last: int


@dataclass
class _Told(WriterCommitMessage):
    files: list[dict]


class _File:
    def __init__(self, path: str, key: str, mark: int, compress: bool):
        self.staged = Staged(key, path, 0, mark, mark)
        store, at = store_of(path)
        self.raw = store.open_output_stream(at, compression=None)
        self.out = gzip.GzipFile(fileobj=self.raw, mode="wb", mtime=0) if compress else self.raw

    def add(self, lines: list[str], last: int) -> None:
        self.out.write(("\n".join(lines) + "\n").encode())
        self.staged.lines, self.staged.last = self.staged.lines + len(lines), last

    def close(self) -> Staged:
        if self.out is not self.raw:
            self.out.close()
        self.raw.close()
        return self.staged


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, compress: bool):
        self.folder, self.compress = folder, compress

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        done: list[Staged] = []
        file: _File | None = None
        make_folder(self.folder)
        try:
            for batch in iterator:
                keys, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                i = 0
                while i < len(keys):
                    j = i + 1
                    while j < len(keys) and keys[j] == keys[i]:
                        j += 1
                    if file is None or file.staged.key != keys[i]:
                        if file is not None:
                            done.append(file.close())
                        file = _File(f"{self.folder}/{uuid.uuid4().hex}", keys[i], marks[i], self.compress)
                    file.add(batch.column(2).slice(i, j - i).to_pylist(), marks[j - 1])
                    i = j
            if file is not None:
                done.append(file.close())
        except BaseException:
            if file is not None:
                file.raw.close()
                done.append(file.staged)
            for f in done:
                store, at = store_of(f.path)
                store.delete_file(at)
            raise
        return _Told([asdict(f) for f in done])

    def commit(self, messages: list) -> None:
        make_folder(self.folder)
        write_text(f"{self.folder}/{ACCOUNT}.tmp", json.dumps([f for m in messages if m for f in m.files]))
        move(f"{self.folder}/{ACCOUNT}.tmp", f"{self.folder}/{ACCOUNT}")

    def abort(self, messages: list) -> None:
        delete_folder(self.folder)


class FileSink(DataSource):
    """Options: folder of the job, compress."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "key string, mark long, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["folder"], self.options.get("compress", "false") == "true")


@dataclass
class Job:
    """Files that are staged and not yet named."""

    spark: SparkSession
    folder: str
    files: list[Staged]

    def publish(self, target: Callable[[Staged], tuple[str, str | None]]) -> list[str]:
        """Name each file by target(file): its path and the text of its manifest, if it has one. The job's folder goes at the end."""
        named = [(f, *target(f)) for f in self.files]
        folders = {path.rpartition("/")[0] for _, path, _ in named}
        reached = {folder: qualified(self.spark, folder) for folder in folders}
        for folder in reached.values():
            make_folder(folder)

        def put(file: tuple[Staged, str, str | None]) -> str:
            f, path, manifest = file
            folder, _, name = path.rpartition("/")
            at = f"{reached[folder]}/{name}"
            if manifest is not None:
                write_text(f"{f.path}.manifest", manifest)
                move(f"{f.path}.manifest", at + SUFFIX)
            move(f.path, at)
            return path

        with ThreadPoolExecutor(NAMING) as pool:
            paths = list(pool.map(put, named))
        self.discard()
        return paths

    def discard(self) -> None:
        delete_folder(self.folder)


def stage_files(rows: DataFrame, folder: str, compress: bool = False) -> Job:
    """Write rows (key, mark, line) as staged files below folder, in order of key and first mark. Nothing is left if it fails."""
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    at = f"{qualified(spark, folder).rstrip('/')}/.job-{uuid.uuid4().hex}"
    dealt = rows.select("key", "mark", "line").repartition("key").sortWithinPartitions("key", "mark")
    try:
        dealt.write.format(NAME).option("folder", at).option("compress", str(compress).lower()).mode("append").save()
        files = [Staged(**f) for f in json.loads(read_text(f"{at}/{ACCOUNT}"))]
    except BaseException:
        delete_folder(at)
        raise
    return Job(spark, at, sorted(files, key=lambda f: (f.key, f.first)))
