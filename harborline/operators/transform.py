"""Strict projection: declared columns, renamed and coerced, beside the first error of each row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import SPARK_TYPES
from ..plans.config import Column as Declared
from ..sources.readers import ERROR, ROW, Scan, raw_json

#: Names of helper columns of a checked frame.
FAULT, FAULT_COLUMN, RAW = "_error", "_column", "_raw"


@dataclass(frozen=True)
class Checked:
    """Rows with all declared columns by dest, _row, _error (null if good), _column (the first at fault) and _raw JSON."""

    df: DataFrame
    columns: tuple[Declared, ...]

    def good(self) -> DataFrame:
        return self.df.where(F.col(FAULT).isNull()).select(*(F.col(f"`{c.dest}`") for c in self.columns))

    def bad(self) -> DataFrame:
        return self.df.where(F.col(FAULT).isNotNull()).select(F.col(ROW).alias("row_number"), F.col(FAULT_COLUMN).alias("column"), F.col(FAULT).alias("error"), F.col(RAW).alias("row"))


def coerced(scan: Scan, columns: tuple[Declared, ...]) -> tuple[DataFrame, list[Column]]:
    """The scan's frame with the value of each declared column, coerced once, and these values.

    A generator of one row stands between them and what is made of them: Catalyst would else put the coercions into each later
    projection, and into filters on errors once more.
    """
    if not columns:
        return scan.df, []
    made = F.struct(*(column_value(scan, c).alias(f"_v{i}") for i, c in enumerate(columns)))
    return scan.df.select("*", F.inline(F.array(made))), [F.col(f"_v{i}") for i in range(len(columns))]


def column_error(scan: Scan, c: Declared, value: Column) -> Column:
    """Text of what is wrong with a column of a row, or null. value: the column, coerced. The texts are fixed: operators of a
    load read them in sidecars and reports."""
    raw = scan.raw(c.source)
    if raw is None:
        return F.lit(f"Missing required column: {c.source!r}") if c.required else F.lit(None).cast("string")
    empty = F.lit(f"Required column {c.source!r} is empty") if c.required else F.lit(None).cast("string")
    if raw.kind == "variant" and c.required:
        # a key that is absent reads as no variant at all, JSON's null as a variant that holds nothing
        empty = F.when(raw.value.isNull(), F.lit(f"Missing required column: {c.source!r}")).otherwise(empty)
    failed = F.concat(F.lit(f"Cannot coerce {c.source!r}='"), raw.text, F.lit(f"' to {c.type}"))
    return F.when(raw.empty, empty).when(value.isNull(), failed)


def column_value(scan: Scan, c: Declared) -> Column:
    raw = scan.raw(c.source)
    if raw is None:
        return F.lit(None).cast(SPARK_TYPES[c.type])
    return F.when(~raw.empty, raw.to(c.type)).cast(SPARK_TYPES[c.type])


def check(scan: Scan, columns: tuple[Declared, ...], keep_raw: bool = True, extra: dict[str, Column] | None = None) -> Checked:
    """Coerce all declared columns in one projection. extra: more columns to carry, by name."""
    made, values = coerced(scan, columns)
    errors = [column_error(scan, c, v) for c, v in zip(columns, values)]
    # both texts of the first error, so that each is worked out once
    first = F.coalesce(*(F.when(e.isNotNull(), F.struct(F.lit(c.source).alias("at"), e.alias("text"))) for e, c in zip(errors, columns)))
    df = made.select(
        F.col(ROW),
        F.col(ERROR),
        first["text"].alias(FAULT),
        first["at"].alias(FAULT_COLUMN),
        (raw_json(scan) if keep_raw else F.lit(None).cast("string")).alias(RAW),
        *(v.alias(c.dest) for c, v in zip(columns, values)),
        *(v.alias(k) for k, v in (extra or {}).items()),
    )
    return Checked(df, columns)
