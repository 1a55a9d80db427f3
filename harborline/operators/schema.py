"""Destination schemas: what a configuration makes of a table, and how two schemas differ."""

from __future__ import annotations

from pyspark.sql import types as T

from ..functions.coerce import SPARK_TYPES
from ..plans.config import Column as Declared

# The provenance columns of every destination row.
HASH, AT = "_source_file_hash", "_ingested_at"
#: Names of one type in different systems.
ALIASES = {"BIGINT": "INTEGER", "INT64": "INTEGER", "INT": "INTEGER", "LONG": "INTEGER", "NUMBER": "INTEGER", "DOUBLE": "FLOAT", "DOUBLE PRECISION": "FLOAT", "FLOAT64": "FLOAT", "REAL": "FLOAT", "VARCHAR": "STRING", "TEXT": "STRING", "BOOL": "BOOLEAN", "TIMESTAMPTZ": "TIMESTAMP", "TIMESTAMP_NTZ": "TIMESTAMP", "TIMESTAMP WITH TIME ZONE": "TIMESTAMP", "TIMESTAMPNTZ": "TIMESTAMP", "TIMESTAMP_TZ": "TIMESTAMP", "INT8": "INTEGER", "INT4": "INTEGER", "BIGSERIAL": "INTEGER", "DECIMAL": "INTEGER", "FLOAT8": "FLOAT", "FLOAT4": "FLOAT", "CHARACTER VARYING": "STRING"}


class SchemaError(ValueError):
    """The destination is not what the configuration declares."""


def declared(columns: tuple[Declared, ...]) -> T.StructType:
    """Encrypted and hashed columns hold text, whatever they were."""
    fields = [T.StructField(c.dest, T.StringType() if c.encrypt or c.hash else SPARK_TYPES[c.type], True) for c in columns]
    return T.StructType([*fields, T.StructField(HASH, T.StringType()), T.StructField(AT, T.TimestampType())])


def canonical(name: str) -> str:
    upper = name.upper().strip()
    return ALIASES.get(upper, upper)


def differences(expected: dict[str, str], actual: dict[str, str]) -> list[tuple[str, str, str | None, str | None]]:
    """(column, missing | type_mismatch | extra, expected, actual), by column."""
    out = []
    for c in sorted(set(expected) | set(actual)):
        want, have = expected.get(c), actual.get(c)
        if have is None:
            out.append((c, "missing", want, None))
        elif want is None:
            out.append((c, "extra", None, have))
        elif canonical(want) != canonical(have):
            out.append((c, "type_mismatch", want, have))
    return out


def require(expected: T.StructType, actual: T.StructType) -> None:
    names = lambda s: {f.name: f.dataType.simpleString() for f in s}
    if found := differences(names(expected), names(actual)):
        raise SchemaError("; ".join(f"{c}: {what} (declared {want}, found {have})" for c, what, want, have in found))
