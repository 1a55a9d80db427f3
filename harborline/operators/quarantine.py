"""Quarantine: rows that fail go to a sidecar while the rest loads, as long as they are few; and their way back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import is_object
from ..plans.config import Quarantine
from ..sources.sink import Job, stage_files


class QuarantineExceeded(ValueError):
    """More rows fail than the configuration tolerates."""


#: Rows of a file whose failures share a sidecar: a longer file has one for each so many rows, written side by side.
PART_ROWS = 1_000_000


def sidecar_name(path: str, content_hash: str, part: str = "") -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return f"{name.rsplit('.', 1)[0] if '.' in name else name}.{content_hash[:12]}{part and '.' + part}.quarantine.ndjson"


def stage_sidecars(bad: DataFrame, folder: str, path: str, content_hash: str, rows: int, part_rows: int = PART_ROWS) -> tuple[Job, Callable, str]:
    """The sidecars of a file of so many rows, written by executors and not yet named; how to name them; and where they will be, as a
    path or a pattern of paths."""
    lines = sidecar_lines(bad).select(F.format_string("%05d", F.floor((F.col("row_number") - 1) / part_rows)).alias("key"), F.col("row_number").alias("mark"), F.col("value").alias("line"))
    at = lambda part: f"{folder.rstrip('/')}/{sidecar_name(path, content_hash, part)}"
    whole = rows <= part_rows
    return stage_files(lines, folder), lambda f: (at("" if whole else f.key), None), at("" if whole else "*")


def sidecar_lines(bad: DataFrame) -> DataFrame:
    """row_number and value, a line {row_number, column, error, row}; row keeps the JSON that the file had."""
    quote = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    line = F.concat(F.lit('{"row_number":'), F.col("row_number").cast("string"), F.lit(',"column":'), quote("column"), F.lit(',"error":'), quote("error"), F.lit(',"row":'), F.col("row"), F.lit("}"))
    return bad.select("row_number", line.alias("value"))


def gate(policy: Quarantine | None, invalid: int, total: int) -> None:
    if invalid and (policy is None or policy.exceeded(invalid, total)):
        raise QuarantineExceeded(f"{invalid} of {total} rows are invalid, more than the quarantine threshold allows")


def redrop(spark: SparkSession, sidecar: str) -> DataFrame:
    """Lines of the rows in a sidecar (or in all that a pattern names), as files to load again. One malformed line fails the whole."""
    v = F.try_parse_json("value")
    row = F.try_variant_get(v, "$.row", "variant")
    lines = spark.read.text(sidecar).where(F.trim("value") != "")
    return lines.select(F.when(is_object(v) & is_object(row), F.to_json(row)).otherwise(F.raise_error(F.concat(F.lit("not a quarantined row: "), F.substring("value", 1, 80)))).alias("value"))


def triage(spark: SparkSession, directory: str) -> DataFrame:
    """file, row_number, column, error of all sidecars of a folder, for questions about them. The parts of a long file's sidecar count as
    one, under the name that a short file's has."""
    lines = spark.read.option("pathGlobFilter", "*.quarantine.ndjson").text(directory).select("value", F.col("_metadata.file_name").alias("file"))
    v = F.parse_json("value")
    get = lambda p, kind: F.try_variant_get(v, p, kind)
    whole = F.regexp_replace("file", r"(\.[0-9a-f]{12})\.[0-9]{5,11}(\.quarantine\.ndjson)$", "$1$2")
    return lines.select(whole.alias("file"), get("$.row_number", "bigint").alias("row_number"), get("$.column", "string").alias("column"), get("$.error", "string").alias("error"))
