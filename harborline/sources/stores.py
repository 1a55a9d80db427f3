"""Files on any store that driver and executors share, outside Spark's readers: pyarrow's file systems by URI, and locks."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession


class Locked(RuntimeError):
    """Another process works on this source."""


def store_of(uri: str):
    """The file system of a URI or local path, and the path there."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def qualified(spark: SparkSession, path: str) -> str:
    """A path without a scheme is one of the cluster's default store, for Spark and for store_of() alike."""
    if ":" in path.split("/", 1)[0]:
        return path
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return path if store.getUri().getScheme() == "file" else p.makeQualified(store.getUri(), store.getWorkingDirectory()).toString()


def exists(uri: str) -> bool:
    from pyarrow import fs

    store, at = store_of(uri)
    return store.get_file_info(at).type != fs.FileType.NotFound


def write_text(uri: str, text: str) -> None:
    store, at = store_of(uri)
    with store.open_output_stream(at, compression=None) as out:
        out.write(text.encode())


def read_text(uri: str) -> str:
    store, at = store_of(uri)
    with store.open_input_stream(at, compression=None) as f:
        return f.read().decode()


def move(source: str, target: str) -> None:
    """Give a file its final name, in place of one that has it. Some stores refuse to rename onto a file: it is deleted first."""
    from pyarrow import fs

    (store, s), (_, t) = store_of(source), store_of(target)
    if not isinstance(store, fs.LocalFileSystem) and exists(target):
        store.delete_file(t)
    store.move(s, t)


def make_folder(uri: str) -> None:
    store, at = store_of(uri)
    store.create_dir(at, recursive=True)


def delete_folder(uri: str) -> None:
    if exists(uri):
        store, at = store_of(uri)
        store.delete_dir(at)


@contextmanager
def store_lock(spark: SparkSession, folder: str, name: str):
    """One holder at a time, by a file that only one can make, on any of Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/.{name}.lock")
    store = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    store.mkdirs(p.getParent())
    try:
        store.create(p, False).close()
    except Exception as e:
        raise Locked(f"{name} is being worked on; remove {p} if it is not") from e
    try:
        yield
    finally:
        store.delete(p, False)
