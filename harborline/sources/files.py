"""Files of a watched directory: listing, content hashes, formats."""

from __future__ import annotations

import fnmatch
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stores import store_of

# What a listing leaves out, and formats by file name.
SKIPPED = (".tmp", ".manifest.json")
EXTENSIONS = {".csv": "csv", ".ndjson": "ndjson", ".jsonl": "ndjson", ".ndjson.gz": "ndjson", ".csv.gz": "csv", ".parquet": "parquet", ".xlsx": "excel"}
#: binaryFile holds a file in one row; larger files are hashed as streams.
BINARY_LIMIT = 1 << 30


def format_of(name: str, explicit: str | None = None) -> str:
    if explicit:
        return explicit
    for ending in sorted(EXTENSIONS, key=len, reverse=True):
        if name.lower().endswith(ending):
            return EXTENSIONS[ending]
    raise ValueError(f"the format of {name!r} cannot be told from its name; state it")


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def list_files(spark: SparkSession, directory: str, pattern: str | None = None) -> list[tuple[str, int]]:
    """(path, size) of the files directly in a directory, in order of path; any file system that Spark reaches."""
    path, store = _hadoop(spark, directory)
    found = []
    for s in store.listStatus(path):
        name = s.getPath().getName()
        if s.isFile() and not name.startswith((".", "_")) and not name.endswith(SKIPPED) and (pattern is None or fnmatch.fnmatch(name, pattern)):
            found.append((s.getPath().toString(), s.getLen()))
    return sorted(found)


def read_bytes(spark: SparkSession, path: str, chunk: int = 1 << 16):
    """Chunks of a file, through Hadoop's file systems."""
    p, store = _hadoop(spark, path)
    stream = store.open(p)
    try:
        while True:
            data = stream.readNBytes(chunk)
            if not len(data):
                return
            yield bytes(data)
    finally:
        stream.close()


def content_hash(spark: SparkSession, path: str) -> str:
    h = hashlib.sha256()
    for chunk in read_bytes(spark, path, 1 << 20):
        h.update(chunk)
    return h.hexdigest()


def content_hashes(spark: SparkSession, files: list[tuple[str, int]]) -> dict[str, str]:
    """SHA-256 of each file's bytes: by the executors, but for files too large for one row."""
    small = [p for p, size in files if size <= BINARY_LIMIT]
    hashes = {p: content_hash(spark, p) for p, size in files if size > BINARY_LIMIT}
    for i in range(0, len(small), 5000):
        rows = spark.read.format("binaryFile").load(small[i : i + 5000]).select("path", F.sha2("content", 256).alias("h"))
        by_path = {r["path"]: r["h"] for r in rows.collect()}
        for p in small[i : i + 5000]:
            hashes[p] = by_path.get(p) or content_hash(spark, p)
    return hashes


def listing(spark: SparkSession, directory: str, pattern: str | None = None) -> DataFrame:
    """path, name, size, modified of the files directly in a directory, as a frame: Spark lists, no content is read."""
    p, store = _hadoop(spark, directory)
    home = p.makeQualified(store.getUri(), store.getWorkingDirectory()).toString()
    # recursive, as folders named k=v would else be taken for partitions and hide the files beside them
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    name = F.substring_index("path", "/", -1)
    found = found.withColumn("name", name).where(F.col("path") == F.concat(F.lit(home.rstrip("/") + "/"), name))
    for ending in SKIPPED:
        found = found.where(~name.endswith(ending))
    if pattern is not None:
        found = found.where(name.rlike("^" + fnmatch.translate(pattern).replace("\\z", "\\Z")))
    return found.select("path", "name", "size", "modified")


def hashed(files: DataFrame) -> DataFrame:
    """files with content_hash: SHA-256 of each one's bytes, streamed by executors, so that no file has to fit in memory."""

    def work(parts):
        import pyarrow as pa

        for batch in parts:
            digests = []
            for path in batch.column(0).to_pylist():
                store, at = store_of(path)
                h = hashlib.sha256()
                with store.open_input_stream(at, compression=None) as f:
                    while chunk := f.read(1 << 20):
                        h.update(chunk)
                digests.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "content_hash"])

    spark = files.sparkSession
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.repartition(spark.sparkContext.defaultParallelism).mapInArrow(work, f"{fields}, content_hash string")


class Index:
    """What is known of files, as tables beside the destination: the hash of each (path, size, modified), and hashes that are loaded for good.

    A file whose size and time are as they were is not read again. Times younger than SETTLED_S when the file was listed do not count, as
    the file may have been written once more within the resolution of the clock."""

    SETTLED_S = 5

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str) -> DataFrame | None:
        p, store = _hadoop(self.spark, f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}") if store.exists(p) and any(s.getPath().getName().endswith(".parquet") for s in store.listStatus(p)) else None

    def hashes(self, files: DataFrame) -> DataFrame:
        """files with content_hash; those that are not known are read, and known from then on."""
        keys, run = ["path", "size", "modified"], uuid.uuid4().hex
        known = self._table("files")
        fresh = files if known is None else files.join(known.where("settled").select(*keys), keys, "left_anti")
        settled = F.col("modified") < F.current_timestamp() - F.make_interval(secs=F.lit(self.SETTLED_S))
        rows = hashed(fresh).select(*keys, "content_hash", settled.alias("settled"), F.lit(run).alias("run"))
        rows.coalesce(max(1, self.spark.sparkContext.defaultParallelism // 4)).write.mode("append").parquet(f"{self.path}/files")
        known = self._table("files")
        known = known.where(F.col("settled") | (F.col("run") == run)).groupBy(*keys).agg(F.max_by("content_hash", F.col("run") == run).alias("content_hash"))
        return files.join(known, keys)

    def unloaded(self, files: DataFrame, epoch: str) -> DataFrame:
        """files without those whose content is loaded for good, as far as has been noted in this epoch of the audit store."""
        done = self._table("loaded")
        return files if done is None else files.join(done.where(F.col("epoch") == epoch), "content_hash", "left_anti")

    def loaded(self, hashes: list[str], epoch: str) -> None:
        if hashes:
            rows = self.spark.createDataFrame([(h, epoch) for h in hashes], "content_hash string, epoch string")
            rows.coalesce(1).write.mode("append").parquet(f"{self.path}/loaded")
