import json

import pytest
from pyspark.sql import functions as F

from harborline.operators import infer, schema, validate
from harborline.operators.compact import compact
from harborline.plans.config import Column
from harborline.sources import readers
from harborline.sources.readers import Scan
from harborline.functions.coerce import Raw


def text_scan(spark, names, rows):
    df = spark.createDataFrame([(i + 1, None, *r) for i, r in enumerate(rows)], ", ".join(["_row long", "_parse_error string", *(f"`{n}` string" for n in names)]))
    return Scan(df, {n: Raw(F.col(f"`{n}`"), "text") for n in names}, names)


LADDER = [
    (["1", "0"], "integer", "high"), (["1", ""], "integer", "low"), (["1", "2.5"], "float", "high"), (["true", "FALSE"], "boolean", "high"), (["yes", "true"], "string", "high"),
    (["2024-01-01T10:00", "2024-01-02 11:30:00"], "timestamp", "high"), (["2024-99-99"], "date", "high"), (["01/02/2024", "2024-01-01"], "string", "ambiguous"), (["1", "x"], "string", "ambiguous"), (["a", "b"], "string", "high"), (["", None], "string", "ambiguous"),
]


@pytest.mark.parametrize("values,kind,confidence", LADDER)
def test_inference_ladder(spark, values, kind, confidence):
    got = infer.infer(text_scan(spark, ["c"], [(v,) for v in values]))[0]
    assert (got.type, got.confidence) == (kind, confidence)


def test_inference_of_json(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"n": 1, "s": "2", "o": {"b": 1, "a": 2}, "l": [1]}\n{"s": "3"}\n')
    got = {c.name: c for c in infer.infer(readers.read_ndjson(spark, str(tmp_path / "a.ndjson")))}
    assert (got["n"].type, got["n"].confidence, got["n"].rows) == ("string", "ambiguous", 1)
    assert got["s"].type == "integer" and got["o"].notes == ["holds objects with a, b; loads as JSON text"] and got["l"].notes[0].startswith("holds arrays")
    assert "source: s" in infer.as_yaml(list(got.values()))


def test_inference_samples_first_rows(spark):
    assert infer.infer(text_scan(spark, ["c"], [("1",), ("x",)]), rows=1)[0].type == "integer"


def test_validation_lists_every_cell(spark):
    s = text_scan(spark, ["a", "b", "z"], [("1", "x", ""), ("", "y", "")])
    columns = (Column("a", "a", "integer"), Column("b", "b", "float"), Column("c", "c", "string"))
    got = [tuple(r) for r in validate.failures(s, columns).orderBy("row_number", "column").collect()]
    assert [(n, c) for n, c, _ in got] == [(1, "b"), (1, "c"), (2, "a"), (2, "b"), (2, "c")]
    t = validate.tolerance(s.names, columns)
    assert t.extra == ["z"] and t.missing == ["c"] and not t.ok
    d = {r["column"]: r for r in validate.drift(s, columns).collect()}
    assert d["c"]["kind"] == "absent" and d["a"]["first_rows"] == [2] and "b" not in d


def test_schema_differences():
    got = schema.differences({"a": "bigint", "b": "string", "c": "date"}, {"a": "INTEGER", "b": "DOUBLE", "d": "text"})
    assert [(c, w) for c, w, _, _ in got] == [("b", "type_mismatch"), ("c", "missing"), ("d", "extra")]


def test_compaction(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(5):
        (src / f"{i}.ndjson").write_text(f'{{"i":   {i}}}\n\n')
    out = tmp_path / "out"
    assert compact(spark, str(src), str(out), 2) == {"batches": 3, "files_compacted": 5}
    rows = [json.loads(x)["i"] for p in sorted(out.iterdir()) for x in p.read_text().splitlines()]
    assert rows == [0, 1, 2, 3, 4]
    assert compact(spark, str(src), str(out), 2) == {"batches": 0, "files_compacted": 0}
    (src / "bad.ndjson").write_text("{\n")
    with pytest.raises(Exception):
        compact(spark, str(src), str(tmp_path / "out2"), 2)
    assert not list((tmp_path / "out2").iterdir())


def test_keys_of_objects_merge(spark, tmp_path):
    from harborline.operators import infer
    from harborline.sources import readers

    assert infer.object_keys("OBJECT<>") == [] and infer.object_keys("OBJECT<a: VARIANT, `b c`: OBJECT<x: BIGINT, y: ARRAY<OBJECT<z: VOID>>>, `d``e`: ARRAY<VARIANT>, `ü:, <`: VOID>") == ["a", "b c", "d`e", "ü:, <"]
    rows = [{"o": {f"k{i % 7}": i, "in": {"deep": [i]}}} if i % 3 else {"o": {"x y": "t", "`": None}} for i in range(300)]
    (tmp_path / "a.ndjson").write_text("\n".join(json.dumps(r) for r in rows))
    (got,) = infer.infer(readers.read_ndjson(spark, str(tmp_path / "a.ndjson")), None)
    assert got.notes == ["holds objects with `, in, k0, k1, k2, k3, k4, k5, k6, x y; loads as JSON text"] and got.type == "string"
