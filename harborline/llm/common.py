"""Helpers the corpus operators share: tables, the shared folder, Arrow text buffers, word hashes."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SWEPT: str | None = None
#: A text batch is worked on in pieces of about this many bytes, so that temporaries stay small.
PIECE_BYTES = 1 << 20

#: Bytes that separate words: space and 0x09-0x0D.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240611).integers(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets a temporary one;
    on a cluster, where each machine would write to its own disk, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master or 'the cluster'} share")
        at = "file://" + tempfile.mkdtemp(prefix="harborline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the application's part of the shared folder, which goes when the driver ends."""
    global _SWEPT
    if _SWEPT != (app := spark.sparkContext.applicationId):
        _SWEPT = app
        atexit.register(sweep, spark)
    return f"{shared_dir(spark)}/harborline/{app}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete all that this application has staged; results that were not yet written go with it."""
    with contextlib.suppress(Exception):  # the session may have ended before
        _delete(spark, f"{shared_dir(spark)}/harborline/{spark.sparkContext.applicationId}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    # a write that fails raises, so that no mark of success is needed
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that is not needed again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now; it learns of them from the driver's collector."""
    gc.collect()
    spark._jvm.System.gc()


def trim() -> None:
    """Give memory that is no longer used back to the system. Python workers live on between tasks, and what one task has held
    would count beside what the next needs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that gives memory back when its task is done."""

    def work(parts: Iterator) -> Iterator:
        yield from run(parts)
        trim()

    return work


def nameless(rows: DataFrame) -> DataFrame:
    """rows with columns named by their places, for functions on Arrow batches: PySpark looks up columns by name, where equal names and dots fail."""
    return rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def pieces(offsets: np.ndarray, most: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of about `most` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, in place on a uint64 array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        with np.errstate(over="ignore"):
            a = np.full(size, _BASE, np.uint64)
            b = np.full(size, _BASE_INV, np.uint64)
            a[0] = b[0] = 1
            _POWERS, _INVERSES = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _POWERS, _INVERSES


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span [start, end): a polynomial over random byte values, then mixed with the length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
        h = (total[end] - total[start]) * down[start]
        h ^= (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix(h)


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of some texts, or what else bytes that are `blank` separate: byte spans, hashes and the range of
    words of each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False, blank: np.ndarray = _BLANK):
        base = int(offsets[0])
        raw = raw[base : int(offsets[-1])]
        off = offsets - base
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = ~blank[raw]
        begins = inside[1:] & ~inside[:-1]
        ends = inside[:-1] & ~inside[1:]
        cut = off[(off > 0) & (off < len(raw))]
        both = inside[cut] & inside[cut + 1]  # texts that touch: a word ends and another begins here
        begins[cut[both]] = True
        ends[cut[both]] = True
        self.raw = raw
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, off)  # words of text i: first[i] .. first[i+1]
        self._hash = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hashes(self.raw, self.start, self.end)
        return self._hash

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def encoded(self) -> pa.DictionaryArray:
        """Words as bytes, each different one once, and the number of each word's."""
        size = self.end - self.start
        at = np.concatenate([[0], np.cumsum(size)])
        data = self.raw[np.repeat(self.start - at[:-1], size) + np.arange(at[-1])]
        return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values; has len(h) - k + 1 values (none if fewer than k)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for i in range(1, k):
            out *= np.uint64(0x9DDFEA08EB382D69)
            out += h[i : i + n]
            out ^= out >> np.uint64(32)
        return mix(out)


def batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
