"""Readers of the five file formats. Each gives raw columns as the file has them and `_row`, the number of the data row from 1.

`_row` comes from row_number over one file's split order for formats without row positions; a file that is one split, as every
compressed or multi-line file is, keeps its order trivially. Rows that a format cannot parse carry a text in `_parse_error`, and
one of them fails the file.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import Raw, kind_of
from ..functions.json import is_object
from . import csv_split, encoded, excel
from .files import read_bytes
from .stores import qualified

ROW, ERROR = "_row", "_parse_error"
#: Encodings that Spark's own readers take; others go through the JVM's charsets.
SPARK_ENCODINGS = {"utf-8", "utf8", "us-ascii", "ascii", "iso-8859-1", "latin-1", "utf-16", "utf-16le", "utf-16be", "utf-32"}
UTF_8 = {"utf-8", "utf8", "us-ascii", "ascii"}
#: Python's names of charsets that Java names otherwise.
JAVA_CHARSETS = {"cp500": "IBM500", "cp037": "IBM037", "cp1140": "IBM01140", "cp1252": "windows-1252", "cp1251": "windows-1251", "cp850": "IBM850", "latin-1": "ISO-8859-1", "shift_jis": "Shift_JIS", "gbk": "GBK", "euc_jp": "EUC-JP"}


@dataclass(frozen=True)
class Scan:
    """Raw rows of a file: the frame, and for each source name how its values are to be read."""

    df: DataFrame
    values: dict[str, Raw]
    names: list[str]

    def raw(self, name: str) -> Raw | None:
        return self.values.get(name)


def numbered(df: DataFrame) -> DataFrame:
    """Add _row in file order. Split counts are summed first, so no task orders more than its own split."""
    df = df.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    sizes = {r["_p"]: r["n"] for r in df.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    if not before:
        return df.withColumn(ROW, F.lit(0).cast("long")).drop("_p", "_i")
    base = F.create_map(*[x for p, n in before.items() for x in (F.lit(p), F.lit(n).cast("long"))])
    # the low 33 bits of the id count rows within a partition
    return df.withColumn(ROW, base[F.col("_p")] + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_p", "_i")


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Non-blank lines of a text file, in order, with their numbers."""
    if encoding.lower().replace("_", "-") in SPARK_ENCODINGS:
        lines = spark.read.text(path) if encoding.lower() in ("utf-8", "utf8", "ascii", "us-ascii") else _decoded(spark, path, encoding)
    else:
        lines = _decoded(spark, path, encoding)
    return numbered(lines.where(F.trim(F.regexp_replace("value", r"^\s+$", "")) != ""))


def _decoded(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines of a file in an encoding that Spark does not read, by Python's codec on executors: in many tasks where the encoding lets
    lines be told in bytes. On stores that only Spark reaches the file is one row."""
    lines = encoded.lines(spark, path, encoding)
    if lines is not None:
        return lines

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            for data in batch.column(0):
                text = data.as_py().decode(encoding)
                yield pa.RecordBatch.from_arrays([pa.array(text.splitlines(), pa.string())], names=["value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string")


def _header(spark: SparkSession, path: str, encoding: str) -> tuple[list[str], bool]:
    """The first row of a CSV file in an encoding of Python's codecs, and whether its lines end in a carriage return alone."""
    import codecs
    import csv
    import io
    import zlib

    text, decoder = "", codecs.getincrementaldecoder(encoding)()
    unzip = zlib.decompressobj(31).decompress if path.endswith(".gz") else bytes
    names: list[str] = []
    for chunk in read_bytes(spark, path):
        text += decoder.decode(unzip(chunk))
        names = next((r for r in csv.reader(io.StringIO(text, newline="")) if r), [])
        if names and "\n" in text:
            break
    return names, "\r" in text and "\n" not in text


def _csv_decoded(spark: SparkSession, path: str, encoding: str, names: list[str]) -> DataFrame:
    """Cells of a file whose lines end in carriage returns alone, or that only Spark reaches: one task."""
    import csv
    import io

    def run(parts):
        import pyarrow as pa

        for batch in parts:
            for data in batch.column(0):
                body = (r for r in csv.reader(io.StringIO(data.as_py().decode(encoding), newline="")) if r)
                next(body, None)
                cells = [[*r[: len(names)], *[None] * (len(names) - len(r))] for r in body]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*cells)] if cells else [pa.array([], pa.string())] * len(names), names=names)

    if not names:
        return spark.createDataFrame([], T.StructType([]))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8") -> Scan:
    """Header row, commas, double quotes doubled inside quotes, line feeds inside quotes, no trimming, all text. Short rows end in nulls, long ones are cut.

    An empty cell without quotes reads as null, not as empty text; both count as missing values everywhere."""
    options = {"escape": '"', "quote": '"', "mode": "PERMISSIVE", "nullValue": "\u0000", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    error = F.lit(None).cast("string").alias(ERROR)

    def split(names: list[str], path: str, lines: DataFrame | None = None) -> Scan:
        """The cells of each record, read by many tasks."""
        rows = csv_split.records(spark, path, lines).where("record > 1")
        ddl = ", ".join(f"c{i} string" for i in range(len(names)))
        cells = rows.select((F.col("record") - 1).alias(ROW), F.from_csv("value", ddl, {k: str(v) for k, v in options.items()}).alias("v"))
        cells = cells.select(ROW, *(F.col(f"v.c{i}").alias(c) for i, c in enumerate(names)), error)
        return Scan(cells, {c: Raw(F.col(f"`{c}`"), "text") for c in names}, names)

    if encoding.lower().replace("_", "-") in SPARK_ENCODINGS:
        df = spark.read.options(header=True, multiLine=True, inferSchema=False, enforceSchema=False, **options).option("encoding", encoding).csv(path)
        files = [unquote(f) for f in df.inputFiles()] if encoding.lower() in UTF_8 and df.columns else []
        if len(files) == 1 and not _other_line_ends(spark, files[0]):
            return split(list(df.columns), files[0])
    else:
        names, returns = _header(spark, path, encoding)
        lines = encoded.lines(spark, path, encoding, feeds_only=True) if names and not returns else None
        if lines is not None:
            return split(names, path, lines)
        df = _csv_decoded(spark, path, encoding, names)
    names = list(df.columns)
    df = numbered(df) if names else spark.createDataFrame([], f"{ROW} long")
    return Scan(df.withColumn(ERROR, F.lit(None).cast("string")), {c: Raw(F.col(f"`{c}`"), "text") for c in names}, names)


def _other_line_ends(spark: SparkSession, path: str) -> bool:
    """Whether lines end in a carriage return alone, by the first that is there."""
    head = "" if path.endswith(".gz") else next(read_bytes(spark, path), b"").decode("latin-1")
    return "\r" in head and "\n" not in head


def read_ndjson(spark: SparkSession, path: str, encoding: str = "utf-8", wanted: list[str] | None = None) -> Scan:
    """One JSON value a line; types are kept. A line that is not an object fails the file."""
    df = _lines(spark, path, encoding).withColumn("_v", F.try_parse_json(F.trim("value")))
    bad = F.when(F.col("_v").isNull(), "invalid JSON").when(~is_object(F.col("_v")), "not a JSON object")
    df = df.withColumn(ERROR, F.when(bad.isNotNull(), F.concat(F.lit("line "), F.col(ROW).cast("string"), F.lit(": "), bad)))
    names = wanted if wanted is not None else json_keys(df)
    values = {}
    for c in names:
        quoted = c.replace("\\", "\\\\").replace('"', '\\"')
        values[c] = Raw(F.try_variant_get(F.col("_v"), f'$["{quoted}"]', "variant"), "variant")
    return Scan(df, values, names)


def json_keys(df: DataFrame) -> list[str]:
    """Keys of the objects in column _v, in order of first appearance."""
    keys = df.where(is_object(F.col("_v"))).select(ROW, F.posexplode(F.map_keys(F.from_json(F.to_json("_v"), "map<string,string>"))).alias("at", "key"))
    return [r["key"] for r in keys.groupBy("key").agg(F.min(F.struct(ROW, "at")).alias("first")).orderBy("first").collect()]


def read_parquet(spark: SparkSession, path: str) -> Scan:
    """Native columns; nested ones are read as JSON text."""
    df = spark.read.parquet(path)
    names = list(df.columns)
    df = df.select(*(F.col(f"`{c}`") for c in names), (F.col("_metadata.row_index") + 1).alias(ROW), F.lit(None).cast("string").alias(ERROR))
    return Scan(df, {f.name: Raw(F.col(f"`{f.name}`"), kind_of(f.dataType)) for f in df.schema if f.name in names}, names)


def read_fixed_width(spark: SparkSession, path: str, layout: list[tuple[str, int, int]], encoding: str = "utf-8") -> Scan:
    """Slices (name, start from 1, width) of each non-blank line, trimmed at both sides. A line that ends before a slice fails the file."""
    reach = max(start + width - 1 for _, start, width in layout)
    df = _lines(spark, path, encoding)
    short = F.concat(F.lit("line "), F.col(ROW).cast("string"), F.lit(": has "), F.length("value").cast("string"), F.lit(f" characters, the layout needs {reach}"))
    df = df.withColumn(ERROR, F.when(F.length("value") < reach, short))
    values = {n: Raw(F.regexp_replace(F.substring("value", s, w), r"^\s+|\s+$", ""), "text") for n, s, w in layout}
    return Scan(df, values, [n for n, _, _ in layout])


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> Scan:
    names, df = excel.scan_sheet(spark, qualified(spark, path), sheet)
    return Scan(df.withColumn(ERROR, F.lit(None).cast("string")), {n: Raw(F.col(f"c{i}"), "text") for i, n in enumerate(names)}, names)


def scan(spark: SparkSession, path: str, kind: str, encoding: str = "utf-8", layout: list[tuple[str, int, int]] | None = None, sheet: str | int | None = None, wanted: list[str] | None = None) -> Scan:
    """A file of any format."""
    if kind == "csv":
        return read_csv(spark, path, encoding)
    if kind == "ndjson":
        return read_ndjson(spark, path, encoding, wanted)
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind == "fixed_width":
        return read_fixed_width(spark, path, layout or [], encoding)
    if kind == "excel":
        return read_excel(spark, path, 0 if sheet is None else sheet)
    raise ValueError(f"unknown format {kind!r}")


def window(s: Scan, start_row: int = 1, rows: int | None = None) -> Scan:
    """Rows start_row .. start_row + rows - 1, by number."""
    df = s.df.where(F.col(ROW) >= start_row)
    if rows is not None:
        df = df.where(F.col(ROW) < start_row + rows)
    return Scan(df, s.values, s.names)


def raw_json(s: Scan) -> Column:
    """The row as a JSON object with the values that the file has."""
    if not s.names:
        return F.lit("{}")
    parts = [(F.lit('"' + n.replace("\\", "\\\\").replace('"', '\\"') + '":'), F.coalesce(F.to_json(v.value) if v.kind == "variant" else _json_text(v), F.lit("null"))) for n, v in s.values.items()]
    body = reduce(lambda a, b: F.concat(a, F.lit(","), b), (F.concat(k, v) for k, v in parts))
    return F.concat(F.lit("{"), body, F.lit("}"))


def _json_text(v: Raw) -> Column:
    # a struct of one field quotes and escapes as JSON does
    return F.when(v.value.isNotNull(), F.regexp_extract(F.to_json(F.struct(v.value.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1))
