"""Dotted paths into JSON values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path(dotted: str) -> str:
    """a.b as a variant path; each part is quoted, so that any name works."""
    return "$" + "".join('["' + part.replace("\\", "\\\\").replace('"', '\\"') + '"]' for part in dotted.split(".") if part)


def dotted_get(value: Column, dotted: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, path(dotted), kind)


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
