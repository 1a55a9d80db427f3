"""Strict coercion of raw values to the six column types, as Column expressions.

A raw value is text, a VARIANT (a JSON value, whose own type matters) or a native column. try_cast alone accepts too much
("1d", "2024", "t", " 2024-01-15"), so a pattern decides and the cast follows. Casts that fail give null, which is told from a
null value by the raw value. Dates and timestamps take the ISO 8601 forms that a strict parser of such takes.

The usual shapes are told by one short pattern and cast as they are; the general forms are tried only where that fails.

Deviations: integers beyond 64 bits fail; digits other than 0-9 fail; a double as a string reads as Spark writes it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARK_TYPES = {"string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}

_DIGITS = r"\d+(?:_\d+)*"
INTEGER = rf"^[+-]?{_DIGITS}$"
FLOAT = rf"^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))$"
_DATE = r"\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-[1-7])?|\d{4}W\d{2}[1-7]?"
DATE = rf"^(?:{_DATE})$"
TIMESTAMP = rf"(?s)^({_DATE})(?:.(\d{{2}})(?::?(\d{{2}})(?::?(\d{{2}})(?:[.,](\d+))?)?)?(Z|z|[+-]\d{{2}}(?::?\d{{2}}(?::?\d{{2}})?)?)?)?$"
#: The forms of a timestamp that a cast reads alike.
PLAIN_TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:\d{2})?$"
TRUE, FALSE = ("true", "1", "yes"), ("false", "0", "no")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def integer_text(text: Column) -> Column:
    t = strip(text)
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")).when(t.rlike(INTEGER), F.regexp_replace(t, "_", "").try_cast("bigint"))


def float_text(text: Column) -> Column:
    t = strip(text)
    return F.when(text.rlike(r"^[+-]?\d+(?:\.\d+)?$"), text.try_cast("double")).when(t.rlike(FLOAT), F.regexp_replace(t, "_", "").try_cast("double"))


def boolean_text(text: Column) -> Column:
    t, plain = F.lower(strip(text)), F.lower(text)
    return F.when(plain.isin(*TRUE), True).when(plain.isin(*FALSE), False).when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)


def date_text(text: Column) -> Column:
    week = F.regexp_extract(text, r"^(\d{4})-?W(\d{2})-?([1-7])?$", 2).try_cast("int")
    year = F.substring(text, 1, 4).try_cast("int")
    day = F.coalesce(F.regexp_extract(text, r"W\d{2}-?([1-7])$", 1).try_cast("int"), F.lit(1))
    monday = F.date_trunc("week", F.make_timestamp(year, F.lit(1), F.lit(4), F.lit(0), F.lit(0), F.lit(0))).cast("date")
    at = F.date_add(monday, (week - 1) * 7 + day - 1)
    by_week = F.when(week.between(1, 53) & (F.weekofyear(at) == week), at)
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
        .when(text.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)).try_cast("date"))
        .when(text.rlike(DATE), by_week)
    )


def timestamp_text(text: Column) -> Column:
    part = [F.regexp_extract(text, TIMESTAMP, i) for i in range(7)]
    or_zero = [F.when(p == "", "00").otherwise(p) for p in part]
    fraction = F.when(part[5] == "", "0").otherwise(F.substring(part[5], 1, 6))
    zone = F.when(part[6].isin("", "Z", "z"), "+00:00").otherwise(
        F.concat(F.substring(part[6], 1, 3), F.lit(":"), F.rpad(F.substring(F.regexp_replace(F.substring(part[6], 4, 9), ":", ""), 1, 2), 2, "0"))
    )
    whole = F.concat(date_text(part[1]).cast("string"), F.lit("T"), or_zero[2], F.lit(":"), or_zero[3], F.lit(":"), or_zero[4], F.lit("."), fraction, zone)
    return F.when(text.rlike(PLAIN_TIMESTAMP), text.try_cast("timestamp")).when(text.rlike(TIMESTAMP), whole.try_cast("timestamp"))


_FROM_TEXT = {"string": lambda t: t, "integer": integer_text, "float": float_text, "boolean": boolean_text, "date": date_text, "timestamp": timestamp_text}


@dataclass(frozen=True)
class Raw:
    """A raw value: its text, whether it is null or empty, and how it becomes each type."""

    value: Column
    kind: str  # text, variant, or the name of a Spark type

    @property
    def text(self) -> Column:
        if self.kind == "text":
            return self.value
        if self.kind == "variant":
            of = F.schema_of_variant(self.value)
            return (
                F.when(of == "STRING", F.try_variant_get(self.value, "$", "string"))
                .when(of == "BOOLEAN", F.initcap(F.try_variant_get(self.value, "$", "string")))
                .when(of.startswith("OBJECT") | of.startswith("ARRAY"), F.to_json(self.value))
                .when(of != "VOID", F.try_variant_get(self.value, "$", "string"))
            )
        if self.kind == "boolean":
            return F.initcap(self.value.cast("string"))
        if self.kind in ("array", "map", "struct"):
            return F.to_json(self.value)
        return self.value.cast("string")

    @property
    def empty(self) -> Column:
        """Null, or the empty string."""
        return F.coalesce(self.text == "", F.lit(True))

    def to(self, kind: str) -> Column:
        text = self.text
        if self.kind == "text" or kind in ("string", "boolean"):
            return _FROM_TEXT[kind](text)
        if self.kind == "variant":
            of = F.schema_of_variant(self.value)
            number, truth = of.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), of == "BOOLEAN"
            double = F.try_variant_get(self.value, "$", "double")
            if kind == "integer":
                # a JSON number is cut towards zero; the same digits in quotes are not an integer
                return F.when(of.rlike("^(BIGINT|INT|SMALLINT|TINYINT)"), F.try_variant_get(self.value, "$", "bigint")).when(number, double.try_cast("bigint")).when(truth, F.try_variant_get(self.value, "$", "boolean").cast("bigint")).when(of == "STRING", integer_text(text))
            if kind == "float":
                return F.when(number, double).when(truth, F.try_variant_get(self.value, "$", "boolean").cast("double")).when(of == "STRING", float_text(text))
            return _FROM_TEXT[kind](text)
        if self.kind == "string":
            return _FROM_TEXT[kind](text)
        if kind == "integer":
            return self.value.try_cast("bigint") if self.kind in ("number", "boolean") else F.lit(None).cast("bigint")
        if kind == "float":
            return self.value.try_cast("double") if self.kind in ("number", "boolean") else F.lit(None).cast("double")
        if kind == "date":
            return self.value if self.kind == "date" else date_text(text)
        return self.value.cast("timestamp") if self.kind in ("date", "timestamp") else timestamp_text(text)


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.VariantType):
        return "variant"
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, T.DateType):
        return "date"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return {T.ArrayType: "array", T.MapType: "map", T.StructType: "struct"}.get(type(data_type), "other")
