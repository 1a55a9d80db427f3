"""A queue in a folder: topics of numbered partitions, whose messages lie in segment files named by their offsets.

    <folder>/<topic>/<partition>/<first offset>-<last offset>.parquet      (offset, value)

Both ends are a data source of Spark, `harborline_log`. Writing: a task writes the segments of its partitions under hidden names, and
when all tasks are done they get their names in order of offset, so that a reader never sees an offset before those below it.
Reading, as a stream: an offset of the stream is the next offset of each partition; the end of a batch is what the listing of names
says when the batch begins, so later messages wait for the next one. A batch's tasks are runs of segments of a partition, of some 100,000
messages each: a hot partition is read by many, and short segments do not make a task each. Offsets of a partition are consecutive; if the ones that a stream is to go on with are gone, it fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage

from ..sources.stores import exists, make_folder, move, store_of

NAME = "harborline_log"
SCHEMA = "topic string, partition int, offset long, value binary"
#: Messages of a task that reads, at most but for its last segment.
TASK_MESSAGES = 100_000
_SEGMENT = pa.schema([("offset", pa.int64()), ("value", pa.binary())])


class Gone(RuntimeError):
    """Messages that a stream has not read yet are not there any more."""


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple]  # topic, partition, first, last, path


@dataclass
class _Range(InputPartition):
    topic: str
    partition: int
    folder: str
    names: list[str]
    begin: int
    end: int


def _segments(folder: str) -> dict[str, list[tuple[int, int, str]]]:
    """(first, last, path) of the segments of each topic/partition, in order."""
    from pyarrow import fs

    store, base = store_of(folder)
    out: dict[str, list] = {}
    for f in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        name = f.base_name
        if f.type == fs.FileType.File and name.endswith(".parquet") and not name.startswith("."):
            first, _, last = name.removesuffix(".parquet").partition("-")
            out.setdefault("/".join(f.path.split("/")[-3:-1]), []).append((int(first), int(last), name))
    return {k: sorted(v) for k, v in sorted(out.items())}


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {k: s[-1][1] + 1 for k, s in _segments(self.folder).items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, there = [], _segments(self.folder)
        for key, stop in end.items():
            begin, segments = start.get(key, 0), there.get(key, [])
            if begin < stop and (not segments or (begin and segments[0][0] > begin)):
                raise Gone(f"{key}: offsets from {begin} on are gone from {self.folder}")
            topic, _, partition = key.rpartition("/")
            held = TASK_MESSAGES
            for first, last, name in segments:
                if first < stop and last >= begin:
                    if held >= TASK_MESSAGES:
                        out.append(_Range(unquote(topic), int(partition), f"{self.folder}/{key}", [], begin, stop))
                        held = 0
                    out[-1].names.append(name)
                    held += last + 1 - first
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        store, at = store_of(partition.folder)
        for name in partition.names:
            with store.open_input_file(f"{at}/{name}") as f:
                for batch in pq.ParquetFile(f).iter_batches(4096, columns=["offset", "value"]):
                    offset = batch.column(0)
                    batch = batch.filter(pc.and_(pc.greater_equal(offset, partition.begin), pc.less(offset, partition.end)))
                    n = batch.num_rows
                    if n:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([partition.topic] * n, pa.string()), pa.array([partition.partition] * n, pa.int32()), batch.column(0), batch.column(1)], names=["topic", "partition", "offset", "value"]
                        )


class _Writer(DataSourceArrowWriter):
    """Rows come in order of topic, partition and offset, all of a segment to one task."""

    def __init__(self, folder: str, segment: int):
        self.folder, self.segment = folder, segment

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import pyarrow.parquet as pq

        done, now, out = [], None, None

        def close() -> None:
            if out is not None:
                out[0].close()
                out[1].close()
                done.append((*now[:2], *span, path))

        for batch in iterator:
            topics, partitions, offsets = (batch.column(k).to_pylist() for k in range(3))
            names = [(t, p, o // self.segment) for t, p, o in zip(topics, partitions, offsets)]
            i = 0
            while i < len(names):
                j = i + 1
                while j < len(names) and names[j] == names[i]:
                    j += 1
                if names[i] != now:
                    close()
                    now, at = names[i], f"{self.folder}/{quote(topics[i], safe='')}/{partitions[i]}"
                    make_folder(at)
                    path, span = f"{at}/.{uuid.uuid4().hex}.parquet", [offsets[i], offsets[i]]
                    store, p = store_of(path)
                    stream = store.open_output_stream(p, compression=None)
                    out = (pq.ParquetWriter(stream, _SEGMENT), stream)
                out[0].write_table(pa.table([batch.column(2).slice(i, j - i), batch.column(3).slice(i, j - i).cast(pa.binary())], schema=_SEGMENT))
                span[1] = offsets[j - 1]
                i = j
        close()
        return _Written(done)

    def commit(self, messages: list) -> None:
        for *_, first, last, path in sorted(f for m in messages if m for f in m.files):
            move(path, f"{path.rpartition('/')[0]}/{first:020d}-{last:020d}.parquet")

    def abort(self, messages: list) -> None:
        for f in (f for m in messages if m for f in m.files):
            if exists(f[-1]):
                store, at = store_of(f[-1])
                store.delete_file(at)


class DirectoryLog(DataSource):
    """Options: path, and segment (offsets of a segment file, for writing)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"].rstrip("/"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"].rstrip("/"), int(self.options.get("segment", "100000")))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream, from its start."""
    spark.dataSource.register(DirectoryLog)
    return spark.readStream.format(NAME).option("path", path).load()


def append_log(messages: DataFrame, path: str, segment: int = 100_000) -> None:
    """Add messages (topic, partition, offset, value) to a log. The same messages again replace themselves."""
    messages.sparkSession.dataSource.register(DirectoryLog)
    rows = messages.select("topic", F.col("partition").cast("int").alias("partition"), F.col("offset").cast("long").alias("offset"), F.col("value").cast("binary").alias("value"))
    dealt = rows.repartition("topic", "partition", F.floor(F.col("offset") / segment)).sortWithinPartitions("topic", "partition", "offset")
    dealt.write.format(NAME).option("path", path).option("segment", str(segment)).mode("append").save()
