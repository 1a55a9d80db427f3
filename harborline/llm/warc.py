"""WARC archives: one gzip member per record, written by tasks to the shared folder and read back sequentially.

The reader decompresses incrementally, frames records by Content-Length and verifies block and payload digests.
Paths are opened with pyarrow.fs, so a shared folder may be local, HDFS, S3 or GCS.

Defined cases: a null payload is an empty one; a null url leaves out WARC-Target-URI; repeated rows give a record each;
an empty table gives no archive; columns beyond those named are not read. A record with a null page_id carries no id
and is never referred to.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stage, table

#: Payloads below this many bytes are always stored whole.
REVISIT_BYTES = 1000
#: A task starts a new archive after about this many compressed bytes.
ROLL_BYTES = 256 << 20
CHUNK = 1 << 16

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SOFTWARE = "software: harborline\r\nformat: WARC File Format 1.1\r\n"

_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_RECORD = pa.schema(
    [("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)


def _b32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    return "".join(c if " " <= c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def info(date: str) -> bytes:
    """The warcinfo record that an archive begins with."""
    block = SOFTWARE.encode()
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("WARC-Block-Digest", _b32(block)), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    """One record, not yet compressed. A revisit keeps the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", _line(url)))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("WARC-Payload-Digest", _b32(payload)), ("WARC-Block-Digest", _b32(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _members(source: io.RawIOBase | pa.NativeFile) -> Iterator[bytearray]:
    """Decompressed bytes of each gzip member in turn."""
    data = b""
    while True:
        data = data or source.read(CHUNK)
        if not data:
            return
        z, out = zlib.decompressobj(31), bytearray()
        while not z.eof:
            if not data and not (data := source.read(CHUNK)):
                raise ValueError("archive ends within a gzip member")
            out += z.decompress(data)
            data = z.unused_data if z.eof else b""
        yield out


def _fields(lines: bytes) -> dict[str, str]:
    pairs = (x.split(b":", 1) for x in lines.split(b"\r\n") if b":" in x)
    return {k.decode().strip().lower(): v.decode().strip() for k, v in pairs}


def _page(uri: str | None) -> int | None:
    return int(uri[10:-1]) if uri and uri.startswith("<urn:page:") else None


def read_records(source: io.RawIOBase | pa.NativeFile) -> Iterator[dict]:
    """Pages of an archive in order; a framing or digest fault of any record raises ValueError."""
    for raw in _members(source):
        end = raw.find(b"\r\n\r\n")
        if end < 0 or not raw.startswith(VERSION):
            raise ValueError("not a WARC record")
        head = _fields(bytes(raw[len(VERSION) : end]))
        n = int(head["content-length"])
        block = bytes(raw[end + 4 : end + 4 + n])
        if len(block) != n or raw[end + 4 + n :] != b"\r\n\r\n":
            raise ValueError(f"{head.get('warc-record-id')}: Content-Length does not frame the block")
        if _b32(block) != head["warc-block-digest"]:
            raise ValueError(f"{head.get('warc-record-id')}: block digest differs")
        if head["warc-type"] not in ("response", "revisit"):
            continue  # warcinfo and others that hold no page
        cut = block.index(b"\r\n\r\n") + 4
        payload = block[cut:]
        if head["warc-type"] == "response" and _b32(payload) != head["warc-payload-digest"]:
            raise ValueError(f"{head.get('warc-record-id')}: payload digest differs")
        yield {
            "record_type": head["warc-type"],
            "page_id": _page(head["warc-record-id"]),
            "url": head.get("warc-target-uri"),
            "refers_to": _page(head.get("warc-refers-to")),
            "payload_digest": base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex(),
            "payload_bytes": int(_fields(block[: cut - 2])["content-length"]),
            "payload": payload,
        }


def mark_revisits(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, record_type, refers_to. Of equal payloads of min_bytes or more the largest page_id is kept whole."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(F.encode(html, "UTF-8")).alias("digest"), F.octet_length(html).alias("size"))
    kept = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    kept = stage(kept, "warc-kept")  # so that the join deals both sides anew and Spark can split a hot payload
    revisit = F.coalesce(F.col("page_id") < F.col("kept"), F.col("page_id").isNull() & F.col("kept").isNotNull())
    return rows.join(kept, ["digest", "size"], "left").select(
        "page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("kept")).alias("refers_to")
    )


def write_archives(records: DataFrame, to: str, roll_bytes: int = ROLL_BYTES, date: str | None = None) -> DataFrame:
    """Write page_id, url, html, record_type, refers_to as .warc.gz files below `to`; returns path, records, bytes of each.
    date: WARC-Date of all records, when the pages were fetched; the time of this call by default.

    A file is listed only once it is closed, under a name of its own for each attempt, so what a lost task left is never read.
    """

    date = date or now()

    def write(parts):
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(to)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, done, n, size = None, [], 0, 0

        def close():
            out.close()
            done.append((f"{to}/{name}-{len(done):04d}.warc.gz", n, size))

        for batch in parts:
            for page_id, url, html, kind, refers_to in zip(*(batch.column(i) for i in range(5))):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out, n, size = store.open_output_stream(f"{base}/{name}-{len(done):04d}.warc.gz", compression=None), 0, 0
                    out.write(member(info(date)))
                payload = (html.as_py() or "").encode()
                data = member(record(page_id.as_py(), url.as_py(), payload, kind.as_py(), refers_to.as_py(), date))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(_MANIFEST.names, x)) for x in done], schema=_MANIFEST)

    return records.select("page_id", "url", "html", "record_type", "refers_to").mapInArrow(write, "path string, records long, bytes long")


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """Records of the archives listed in column path, one task per archive; without payload that column stays null."""

    def read(parts):
        from pyarrow import fs

        for batch in parts:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None, buffer_size=CHUNK) as source:
                    rows, held = [], 0
                    for x in read_records(source):
                        held += len(x["payload"])
                        rows.append(x if payload else x | {"payload": None})
                        if len(rows) >= 1000 or payload and held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    n = archives.count()
    return archives.select("path").repartition(max(1, n)).mapInArrow(
        read, "record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stage(write_archives(mark_revisits(table(spark, sf_dir, "pages")), scratch(spark, "warc")), "warc-manifest")
    return read_archives(archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size FROM pages
), k AS (
  SELECT html, max(page_id) AS kept FROM p WHERE size >= 1000 GROUP BY html
)
SELECT p.page_id, CAST(p.size AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN p.page_id < k.kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < k.kept THEN k.kept END AS refers_to
FROM p LEFT JOIN k ON p.html = k.html
"""
