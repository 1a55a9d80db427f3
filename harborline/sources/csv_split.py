"""CSV in many tasks, though cells may hold line feeds.

Spark splits the file into lines. Whether a line begins a record depends on all quotes before it; so each split is scanned for both
cases, that it begins between records and that it begins inside a quoted cell, and tells how it ends and how many records begin in it,
for either. The driver composes these, two numbers and two states a split, from the first split on, which gives each split its true
state and the number of its first record. Then each task cuts its own lines into records; what is left at its edges, at most one piece
at each, is put together by record number. Spark's own CSV parser reads the cells of each record.

Files without a quote need none of this: there lines are records.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PART = "split int, quoted long, begun0 long, begun1 long, inside0 boolean, inside1 boolean"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends within a quoted cell, if it begins within one or not. A quote opens a cell only where the cell begins;
    behind a closing quote, or in a cell without, it is a character like others."""
    i, n = 0, len(line)
    opened = inside
    while True:
        if opened or (i < n and line[i] == '"'):
            i += not opened
            while True:
                i = line.find('"', i)
                if i < 0:
                    return True
                if line[i + 1 : i + 2] != '"':
                    break
                i += 2
            opened = False
        i = line.find(",", i) + 1
        if not i:
            return False


def _split() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _runs(batch: pa.RecordBatch):
    """(lines without a quote, those of them with text; line with a quote or None) of a batch, in order."""
    lines = batch.column(0)
    quoted = pc.match_substring(lines, '"').to_pylist()
    text = pc.fill_null(pc.not_equal(pc.utf8_rtrim(lines, "\r"), ""), False)
    values, i = None, 0
    marks = [k for k, q in enumerate(quoted) if q]
    for k in [*marks, None]:
        j = len(quoted) if k is None else k
        filled = int(pc.sum(text.slice(i, j - i)).as_py() or 0) if j > i else 0
        if k is not None and values is None:
            values = lines.to_pylist()
        yield j - i, filled, None if k is None else values[k]
        i = j + 1


def _survey(parts):
    inside, begun, quotes = [False, True], [0, 0], 0
    for batch in parts:
        for _, filled, line in _runs(batch):
            for s in (0, 1):
                if not inside[s]:
                    begun[s] += filled + (line is not None)
                if line is not None:
                    inside[s] = ends_inside(line, inside[s])
            quotes += line is not None
    yield pa.record_batch([[_split()], [quotes], [begun[0]], [begun[1]], [inside[0]], [inside[1]]], schema=pa.schema([("split", pa.int32()), ("quoted", pa.int64()), ("begun0", pa.int64()), ("begun1", pa.int64()), ("inside0", pa.bool_()), ("inside1", pa.bool_())]))


@dataclass(frozen=True)
class _Start:
    inside: bool
    before: int  # records that began in splits before


def _starts(survey: list) -> tuple[dict[int, _Start], bool]:
    """The true start of each split, and whether the file ends in a cell that is never closed."""
    out, inside, before = {}, False, 0
    for r in sorted(survey, key=lambda r: r["split"]):
        out[r["split"]] = _Start(inside, before)
        before += r["begun1"] if inside else r["begun0"]
        inside = r["inside1"] if inside else r["inside0"]
    return out, inside


def _cutter(starts: dict[int, _Start]):
    schema = pa.schema([("record", pa.int64()), ("edge", pa.int32()), ("value", pa.string())])

    def cut(parts):
        split = _split()
        start = starts.get(split, _Start(False, 0))
        number, inside, head = start.before, start.inside, start.inside
        held: list[str] = []
        rows: list[tuple] = []
        for batch in parts:
            for line in batch.column(0).to_pylist():
                if not inside and not line.rstrip("\r"):
                    continue
                if not inside:
                    number += 1
                held.append(line)
                inside = ends_inside(line, inside) if '"' in line else inside
                if not inside:
                    rows.append((number, split if head else None, "\n".join(held)))
                    held, head = [], False
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if held:
            yield pa.record_batch([[number], [split], ["\n".join(held)]], schema=schema)

    return cut


def records(spark: SparkSession, path: str, lines: DataFrame | None = None) -> DataFrame:
    """record (number from 1, the header's) and value (its text) of a file, without blank lines: a UTF-8 file, or one whose lines, cut at
    line feeds, are given in order of partitions."""
    lines = spark.read.option("lineSep", "\n").text(path) if lines is None else lines
    survey = lines.mapInArrow(_survey, _PART).collect()  # a row a split
    starts, unclosed = _starts(survey)
    if not any(r["quoted"] for r in survey):
        numbers = spark.createDataFrame([(k, s.before) for k, s in starts.items()], "split int, before long")
        filled = lines.where(F.rtrim(F.col("value"), F.lit("\r")) != "").select("value", F.spark_partition_id().alias("split"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
        out = filled.join(F.broadcast(numbers), "split").select((F.col("before") + F.col("at") + 1).alias("record"), "value")
    else:
        cut = lines.mapInArrow(_cutter(starts), "record long, edge int, value string")
        out = cut.where("edge is null").select("record", "value")
        if unclosed or any(s.inside for s in starts.values()):
            edges = cut.where("edge is not null").groupBy("record").agg(F.sort_array(F.collect_list(F.struct("edge", "value"))).alias("pieces"))
            out = out.unionByName(edges.select("record", F.array_join(F.transform("pieces", lambda p: p["value"]), "\n").alias("value")))
    return out.select("record", F.regexp_replace(F.rtrim("value", F.lit("\r")), "\r\n", "\n").alias("value"))
