"""Change data: the latest change of each key, its checks, and the merge into a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATION = "_operation"


def operation(value: Column, operations: dict[str, tuple[str, ...]]) -> Column:
    """insert, update or delete by the raw value, exactly; null if it is none of those configured."""
    out = F.lit(None).cast("string")
    for op, values in operations.items():
        out = F.when(value.isin(*values), op).otherwise(out)
    return out


def errors(changes: DataFrame, keys: list[str], sequence: str, row: str = "_row") -> DataFrame:
    """row, error of the changes that fail a file: unknown operation, null key or sequence, or a sequence equal to the
    highest one of the key's earlier rows. Lower ones are merely late."""
    earlier = Window.partitionBy(*keys).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    null_key = F.coalesce(*(F.when(F.col(f"`{k}`").isNull(), F.lit(f"CDC key {k!r} is null")) for k in keys))
    text = F.coalesce(
        F.when(F.col(OPERATION).isNull(), F.lit("unknown CDC operation")),
        null_key,
        F.when(F.col(f"`{sequence}`").isNull(), F.lit(f"CDC sequence {sequence!r} is null")),
        F.when(F.max(F.col(f"`{sequence}`")).over(earlier) == F.col(f"`{sequence}`"), F.lit("CDC sequence repeats the latest of its key")),
    )
    return changes.select(F.col(row), text.alias("error")).where("error is not null")


def latest(changes: DataFrame, keys: list[str], sequence: str, row: str = "_row") -> DataFrame:
    """The change with the highest sequence of each key; the first of equals. Spark keeps one row a key within each task first."""
    order = Window.partitionBy(*keys).orderBy(F.desc(f"`{sequence}`"), F.asc(row))
    return changes.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def merge(target: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows without a change, and all changes that are not deletions. changes: one row a key, with _operation."""
    kept = target.join(changes.select(*keys), keys, "left_anti")
    new = changes.where(F.col(OPERATION) != "delete").drop(OPERATION)
    return kept.select(*(F.col(f"`{c}`") for c in target.columns)).unionByName(new.select(*(F.col(f"`{c}`") for c in target.columns)))
