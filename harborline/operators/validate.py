"""Validation of files against a configuration: every failing cell, undeclared and missing columns, drift."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.config import Column as Declared
from ..sources.readers import ROW, Scan
from .transform import coerced, column_error


def failures(scan: Scan, columns: tuple[Declared, ...]) -> DataFrame:
    """row_number, column, error of each cell that fails, not only the first of a row."""
    made, values = coerced(scan, columns)
    cells = F.array(*(F.struct(F.lit(c.source).alias("column"), column_error(scan, c, v).alias("error")) for c, v in zip(columns, values)))
    bad = F.filter(cells, lambda x: x["error"].isNotNull())
    return made.select(F.col(ROW).alias("row_number"), F.explode(bad).alias("f")).select("row_number", "f.column", "f.error")


@dataclass(frozen=True)
class Tolerance:
    """Columns that the file has and the configuration does not, and required ones that the file lacks."""

    extra: list[str]
    missing: list[str]

    @property
    def ok(self) -> bool:
        return not self.missing


def tolerance(names: list[str], columns: tuple[Declared, ...]) -> Tolerance:
    declared = {c.source for c in columns}
    return Tolerance([n for n in names if n not in declared], [c.source for c in columns if c.required and c.source not in names])


def drift(scan: Scan, columns: tuple[Declared, ...], shown: int = 5) -> DataFrame:
    """column, kind (absent, required_null), rows, first_rows: what the data lacks of the declaration."""
    spark = scan.df.sparkSession
    absent = [(c.source, "absent") for c in columns if c.source not in scan.values]
    out = spark.createDataFrame(absent, "column string, kind string").select("column", "kind", F.lit(0).cast("long").alias("rows"), F.array().cast("array<bigint>").alias("first_rows"))
    there = [c for c in columns if c.required and c.source in scan.values]
    if there:
        nulls = F.array(*(F.when(scan.values[c.source].empty, F.lit(c.source)) for c in there))
        rows = scan.df.select(ROW, F.explode(F.array_compact(nulls)).alias("column"))
        first = _first_rows(rows, shown)
        out = out.unionByName(first.select("column", F.lit("required_null").alias("kind"), "rows", "first_rows"))
    return out


def _first_rows(rows: DataFrame, shown: int) -> DataFrame:
    """Count and the `shown` smallest row numbers of each column; row_number() <= shown is limited within each task first."""
    from pyspark.sql import Window

    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy(ROW))).where(F.col("k") <= shown)
    first = ranked.groupBy("column").agg(F.sort_array(F.collect_list(ROW)).alias("first_rows"))
    return rows.groupBy("column").agg(F.count("*").alias("rows")).join(first, "column")
