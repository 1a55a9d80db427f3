import io
import zipfile

import pytest
from pyspark.sql import functions as F

from harborline.operators.transform import check
from harborline.plans.config import Column
from harborline.sources import excel, readers
from harborline.sources.files import content_hashes, format_of, list_files


def rows(scan, raw=False):
    return [tuple(r) for r in scan.df.orderBy(readers.ROW).select(readers.ROW, *(v.text.alias(f"c{i}") for i, v in enumerate(scan.values.values()))).collect()]


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,name,note\n1," a ""x"" ","two\nlines"\n\n2,b\n3,c,d,extra\n')
    s = readers.read_csv(spark, str(p))
    assert s.names == ["id", "name", "note"]
    assert rows(s) == [(1, "1", ' a "x" ', "two\nlines"), (2, "2", "b", None), (3, "3", "c", "d")]


def test_csv_in_ebcdic(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('id,name\n1,"x,ä"\n2,y\n'.encode("cp500"))
    assert rows(readers.read_csv(spark, str(p), "cp500")) == [(1, "1", "x,ä"), (2, "2", "y")]


def test_ndjson_keeps_types_and_fails_bad_lines(spark, tmp_path):
    p = tmp_path / "a.ndjson"
    p.write_text('{"a": 9.99, "b": "9.99"}\n\n{"b": null, "c": {"z": 1}}\nnot json\n[1]\n')
    s = readers.read_ndjson(spark, str(p))
    assert s.names == ["a", "b", "c"]
    errors = [r[0] for r in s.df.orderBy(readers.ROW).select(readers.ERROR).collect()]
    assert errors == [None, None, "line 3: invalid JSON", "line 4: not a JSON object"]
    good = check(s, (Column("a", "a", "integer", False), Column("b", "b", "integer", False)))
    assert [(r["a"], r["_error"]) for r in good.df.orderBy("_row").limit(2).collect()] == [(9, "Cannot coerce 'b'='9.99' to integer"), (None, None)]


def test_ndjson_gzip(spark, tmp_path):
    import gzip

    p = tmp_path / "a.ndjson.gz"
    p.write_bytes(gzip.compress(b'{"a": 1}\n{"a": 2}\n'))
    assert rows(readers.read_ndjson(spark, str(p))) == [(1, "1"), (2, "2")]


def test_parquet(spark, tmp_path):
    spark.range(3).select("id", F.struct(F.lit(1).alias("z")).alias("s"), (F.col("id") == 1).alias("t")).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert rows(readers.read_parquet(spark, str(tmp_path / "p"))) == [(1, "0", '{"z":1}', "False"), (2, "1", '{"z":1}', "True"), (3, "2", '{"z":1}', "False")]


def test_fixed_width(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("001 Ann  x\n\n002 Bo   y trailing\n003\n")
    s = readers.read_fixed_width(spark, str(p), [("id", 1, 3), ("name", 5, 5)])
    assert rows(s)[:2] == [(1, "001", "Ann"), (2, "002", "Bo")]
    assert s.df.orderBy("_row").select(readers.ERROR).collect()[2][0].startswith("line 3: has 3 characters")


def workbook() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>An</t></r><r><t>n</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c><c r="C1" t="str"><v>d</v></c><c r="D1" t="str"><v>b</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><f>1+2</f><v>3</v></c><c r="C2" s="1"><v>45306</v></c><c r="D2" t="b"><v>1</v></c></row><row><c r="B3"><v>2.5</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData/></worksheet>")
    return out.getvalue()


def test_excel(spark, tmp_path):
    p = tmp_path / "a.xlsx"
    p.write_bytes(workbook())
    assert excel.sheet_names(workbook()) == ["One", "Two"]
    assert rows(readers.read_excel(spark, str(p), "One")) == [(1, "Ann", "3", "2024-01-15 00:00:00", "True"), (2, None, "2.5", None, None)]
    assert readers.read_excel(spark, str(p), 1).names == []
    with pytest.raises(ValueError):
        excel.read_sheet(workbook(), 2)
    with pytest.raises(ValueError):
        excel.read_sheet(workbook(), "Three")


def test_listing_and_hashes(spark, tmp_path):
    import hashlib

    for n in ("b.csv", "a.csv", "a.csv.manifest.json", "c.tmp", ".hidden"):
        (tmp_path / n).write_text(n)
    (tmp_path / "sub").mkdir()
    files = list_files(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p, _ in files] == ["a.csv", "b.csv"]
    assert list(content_hashes(spark, files).values()) == [hashlib.sha256(n.encode()).hexdigest() for n in ("a.csv", "b.csv")]
    assert len(list_files(spark, str(tmp_path), "b*")) == 1
    assert format_of("X.JSONL") == "ndjson" and format_of("a.dat", "csv") == "csv"
    with pytest.raises(ValueError):
        format_of("a.dat")


def test_a_long_sheet_is_streamed(spark, tmp_path):
    """200,000 rows with as many shared strings: the task's memory stays far below the sheet's 20 MB of XML as a tree (some 900 MB)."""
    import resource

    n, path = 200_000, str(tmp_path / "long.xlsx")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>é{i}</t></r><r><t>!</t></r></si>" for i in range(n)) + "</sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row><c r="B1" t="inlineStr"><is><t>b</t></is></c><c r="D1" t="inlineStr"><is><t>d</t></is></c></row>' + "".join(f'<row><c r="B{i}" t="s"><v>{i}</v></c><c r="D{i}"><v>{i}</v></c></row><row/>' for i in range(n)) + "</sheetData></worksheet>")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    names, rows_ = excel.stream_sheet(path, "S")
    count = sum(r == [f"é{i}!", str(i)] for i, r in enumerate(rows_))
    assert names == ["b", "d"] and count == n and (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) < 100_000
    s = readers.read_excel(spark, path, 0)
    got = s.df.agg({"_row": "max", "c0": "max", "*": "count"}).first()
    assert s.names == ["b", "d"] and got["max(_row)"] == n == got["count(1)"]
