"""Paged APIs as a data source of Spark, `harborline_api`: rows (page, at, record, cursor).

Where the server numbers its pages and says how many there are, ranges of pages are partitions and are asked for side by side; the last
range goes on until a page is short, as the server may have got more meanwhile. Where each page names the next, or nothing is said, one task
reads page after page and hands on the records of each, never holding more. A task that fails asks for its own pages again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .fetch import Source, Transport, ask, cursor_of, last_page, page_params, pages

NAME = "harborline_api"


@dataclass
class Pages(InputPartition):
    begin: int
    end: int | None


class _Reader(DataSourceReader):
    def __init__(self, source: Source, transport: Transport, cursor: str | None, pages_per_task: int):
        self.source, self.transport, self.cursor, self.pages_per_task = source, transport, cursor, pages_per_task

    def partitions(self) -> list[InputPartition]:
        source = self.source
        if source.kind == "stripe" or not source.cursor_param:
            return [Pages(1, None)]
        total = last_page(source, ask(source, self.transport, page_params(source, 1, self.cursor))) or 1
        begins = range(1, total + 1, self.pages_per_task)
        return [Pages(b, None if b == begins[-1] else b + self.pages_per_task - 1) for b in begins]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        for number, records in pages(self.source, self.transport, self.cursor, partition.begin, partition.end):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * len(records), pa.int64()), pa.array(range(len(records)), pa.int64()),
                    pa.array([json.dumps(r, ensure_ascii=False) for r in records], pa.string()), pa.array([cursor_of(self.source, r) for r in records], pa.string()),
                ],
                names=["page", "at", "record", "cursor"],
            )


class Api(DataSource):
    """Bound to a source and a transport by read_api(); options: cursor, pages_per_task."""

    source: Source
    transport: tuple[Transport]  # in a tuple, so that it is no method

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "page long, at long, record string, cursor string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.source, self.transport[0], self.options.get("cursor"), int(self.options.get("pages_per_task", "10")))


def read_api(spark: SparkSession, source: Source, transport: Transport, cursor: str | None = None, pages_per_task: int = 10) -> DataFrame:
    """The records of a source after the cursor. Each action asks the server again: write them before they are used twice."""
    spark.dataSource.register(type("BoundApi", (Api,), {"source": source, "transport": (transport,)}))
    reader = spark.read.format(NAME).option("pages_per_task", str(pages_per_task))
    return (reader if cursor is None else reader.option("cursor", cursor)).load()
