import datetime as dt

import pytest
from pyspark.sql import functions as F

from harborline.functions import coerce

CASES = [
    ("integer", " 3 ", 3), ("integer", "+5", 5), ("integer", "3.0", None), ("integer", "1e3", None), ("integer", "1_000", 1000), ("integer", "1__0", None), ("integer", "9223372036854775808", None), ("integer", "", None),
    ("float", "1d", None), ("float", "1f", None), ("float", "1.", 1.0), ("float", ".5", 0.5), ("float", ".", None), ("float", "inf", float("inf")), ("float", "-Infinity", float("-inf")), ("float", "1_0.5", 10.5), ("float", " 2 ", 2.0),
    ("boolean", " YES ", True), ("boolean", "0", False), ("boolean", "t", None), ("boolean", "y", None), ("boolean", "1", True),
    ("date", "2024-01-15", dt.date(2024, 1, 15)), ("date", "20240115", dt.date(2024, 1, 15)), ("date", "2024-W03-1", dt.date(2024, 1, 15)), ("date", "2024W032", dt.date(2024, 1, 16)), ("date", "2024-W53", None), ("date", "2020-W53", dt.date(2020, 12, 28)),
    ("date", "2024-1-5", None), ("date", "2024-01", None), ("date", "2024-02-30", None), ("date", " 2024-01-15", None), ("date", "2024-01-15 10:00:00", None),
    ("timestamp", "2024-01-15", dt.datetime(2024, 1, 15)), ("timestamp", "2024-01-15T10:00", dt.datetime(2024, 1, 15, 10)), ("timestamp", "2024-01-15 10:00:00.5+02:00", dt.datetime(2024, 1, 15, 8, 0, 0, 500000)),
    ("timestamp", "T10:00", None), ("timestamp", "2024-01-15T25:00", None), ("timestamp", "20240115T1000Z", dt.datetime(2024, 1, 15, 10)), ("timestamp", "2024-01-15T", None),
]


def test_text_forms(spark):
    df = spark.createDataFrame([(i, v) for i, (_, v, _) in enumerate(CASES)], "i int, v string")
    kinds = {"integer": coerce.integer_text, "float": coerce.float_text, "boolean": coerce.boolean_text, "date": coerce.date_text, "timestamp": coerce.timestamp_text}
    rows = {r["i"]: r for r in df.select("i", *(f(F.col("v")).alias(k) for k, f in kinds.items())).collect()}
    wrong = [(kind, v, want, rows[i][kind]) for i, (kind, v, want) in enumerate(CASES) if rows[i][kind] != want]
    assert not wrong


@pytest.mark.parametrize("text,kind,want", [("9.99", "integer", 9), ("-9.99", "integer", -9), ('"9.99"', "integer", None), ("true", "string", "True"), ("true", "integer", 1), ("1", "boolean", True), ("1.5", "boolean", None), ('{"b": 1}', "string", '{"b":1}'), ("20240115", "date", dt.date(2024, 1, 15)), ('"x"', "float", None), ("7", "float", 7.0)])
def test_json_types_matter(spark, text, kind, want):
    raw = coerce.Raw(F.parse_json(F.lit(text)), "variant")
    assert spark.range(1).select(raw.to(kind).alias("x")).first()["x"] == want


def test_empty_is_null(spark):
    df = spark.createDataFrame([("",), (None,), (" ",), ("a",)], "v string")
    assert [r[0] for r in df.select(coerce.Raw(F.col("v"), "text").empty).collect()] == [True, True, False, False]
