"""Lines of files in encodings that Spark's text reader does not take, in many tasks.

A file is cut into ranges of bytes, one a task. Range k runs from the end of the first line that ends at or behind byte k * size to where
range k + 1 begins; a task finds both places itself, so nobody reads the file beforehand. Where a line ends can be told from bytes alone

* in encodings of one byte a character, EBCDIC among them: bytes that stand for a line feed or NEL;
* in those of several bytes whose line feed is no part of another character;
* in UTF-16 and UTF-32: whole units, counted from the byte order mark.

Files of a folder follow each other in order of path; short ones share a task. All others, which shift between states, and compressed files are one range. Either way a range is decoded in blocks: no file and no
range has to fit in memory, but a line has to.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .files import _hadoop, list_files
from .stores import qualified, store_of

BLOCK = 4 << 20
# Encodings of several bytes a character in which the byte 0x0A is always a line feed, by Python's names.
FEED_IS_A_BYTE = {"big5", "big5hkscs", "cp932", "cp949", "cp950", "euc_jis_2004", "euc_jisx0213", "euc_jp", "euc_kr", "gb18030", "gb2312", "gbk", "johab", "shift_jis", "shift_jis_2004", "shift_jisx0213", "utf-8"}
#: Line ends that str.splitlines knows, apart from a carriage return.
ENDS = "\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


@dataclass(frozen=True)
class Cuts:
    """How a file can be cut: behind any of `marks`, at a multiple of `width` bytes from `origin`; `codec` decodes what is in between."""

    codec: str
    marks: tuple[bytes, ...]
    width: int = 1
    origin: int = 0


@lru_cache
def _one_byte_a_character(codec: str) -> bool:
    """Whether each byte is one character, whatever stands beside it."""
    single = [bytes([b]).decode(codec, "replace") for b in range(256)]
    if any(len(c) != 1 for c in single):
        return False
    pairs = bytes(x for a in range(256) for b in range(256) for x in (a, b))
    return pairs.decode(codec, "replace") == "".join(single[x] for x in pairs)


@dataclass(frozen=True)
class Range:
    """The range k of n of a file of this size; without cuts the whole of it."""

    path: str
    size: int
    cuts: Cuts | None
    k: int = 0
    n: int = 1

    @property
    def bytes(self) -> int:
        return -(-self.size // self.n)


def cuts(encoding: str, head: bytes, ends: str = "\n\x85") -> Cuts | None:
    """The cuts of a file that begins with head, at the characters `ends`; None if it has to be read from its beginning."""
    codec = codecs.lookup(encoding).name
    if codec.startswith(("utf-16", "utf-32")):
        width = 2 if "16" in codec else 4
        if codec in ("utf-16", "utf-32"):
            little, big = (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE) if width == 2 else (codecs.BOM_UTF32_LE, codecs.BOM_UTF32_BE)
            origin = width if head.startswith((little, big)) else 0
            codec += "-be" if head.startswith(big) else "-le"
            return Cuts(codec, ("\n".encode(codec),), width, origin)
        return Cuts(codec, ("\n".encode(codec),), width)
    if codec == "utf-8-sig":
        return Cuts("utf-8", (b"\n",), origin=3 if head.startswith(codecs.BOM_UTF8) else 0)
    if codec in FEED_IS_A_BYTE:
        return Cuts(codec, (b"\n",))
    if codec.startswith(("iso2022", "hz", "utf-7")) or not _one_byte_a_character(codec):
        return None
    return Cuts(codec, tuple(bytes([b]) for b in range(256) if bytes([b]).decode(codec, "replace") in ends))


def _end_of_line(f, at: int, size: int, c: Cuts) -> int:
    """The first place at or behind `at` where a line has just ended, or the size."""
    at -= c.width
    f.seek(at)
    while at < size:
        block = f.read(min(BLOCK, size - at))
        if not block:
            break
        best = -1
        for mark in c.marks:
            i = block.find(mark)
            while i >= 0 and i % c.width:
                i = block.find(mark, i + 1)
            if i >= 0 and (best < 0 or i < best):
                best = i
        if best >= 0:
            return at + best + c.width
        at += len(block)
    return size


def _blocks(f, left: int | None) -> Iterator[bytes]:
    while left is None or left > 0:
        data = f.read(BLOCK if left is None else min(BLOCK, left))
        if not data:
            return
        left = None if left is None else left - len(data)
        yield data


def split_lines(blocks: Iterator[bytes], codec: str, feeds_only: bool) -> Iterator[list[str]]:
    """Lines of each block that end in it: as str.splitlines has them, or cut at line feeds only."""
    decoder = codecs.getincrementaldecoder(codec)()
    held: list[str] = []  # the line that goes on
    carry = ""

    def lines(text: str, last: bool) -> list[str]:
        parts = text.split("\n") if feeds_only else text.splitlines(keepends=True)
        if not feeds_only:
            ended = bool(parts) and parts[-1][-1] in ENDS + "\r"
            parts = [*((x.splitlines() or [""])[0] for x in parts), *([""] if ended or not parts else [])]
        held.append(parts[0])
        out = []
        if len(parts) > 1:
            out = ["".join(held), *parts[1:-1]]
            held[:] = [parts[-1]]
        if last and (rest := "".join(held)):
            out.append(rest)
        return out

    for data in blocks:
        text = carry + decoder.decode(data)
        # a line feed may follow
        carry = "\r" if text.endswith("\r") and not feeds_only else ""
        if out := lines(text[: len(text) - len(carry)], False):
            yield out
    if out := lines(carry + decoder.decode(b"", final=True), True):
        yield out


def _reachable(path: str) -> bool:
    try:
        store_of(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _head(store, path) -> bytes:
    stream = store.open(path)
    try:
        return bytes(stream.readNBytes(4))
    finally:
        stream.close()


def lines(spark: SparkSession, path: str, encoding: str, feeds_only: bool = False, split_bytes: int | None = None) -> DataFrame | None:
    """value: the lines of a file or of the files of a folder, in order of partitions and within them; blank ones too. A partition is a
    range, or some short files. None if executors cannot open them by themselves, or for a folder of CSV, whose files have headers."""
    path = qualified(spark, path)
    if not _reachable(path):
        return None
    p, store = _hadoop(spark, path)
    status = store.getFileStatus(p)
    if status.isDirectory() and feeds_only:
        return None
    files = list_files(spark, path) if status.isDirectory() else [(path, status.getLen())]
    if split_bytes is None:
        conf, size = spark._jsparkSession.sessionState().conf(), sum(n for _, n in files)
        split_bytes = min(conf.filesMaxPartitionBytes(), max(conf.filesOpenCostInBytes(), -(-size // spark.sparkContext.defaultParallelism)))
    marked = codecs.lookup(encoding).name in ("utf-16", "utf-32", "utf-8-sig")  # by a byte order mark

    def step(c: Cuts) -> int:
        return max(1, split_bytes // c.width) * c.width

    ranges: list[list[Range]] = []  # of each task
    held = 0
    for file, size in files:
        c = None if file.endswith(".gz") else cuts(encoding, _head(store, _hadoop(spark, file)[0]) if marked else b"", "\n" if feeds_only else "\n\x85")
        n = max(1, -(-(size - c.origin) // step(c))) if c else 1
        for k in range(n):
            r = Range(file, size, c, k, n)
            if not ranges or held + r.bytes > split_bytes:  # an empty file may be the first
                ranges.append([])
                held = 0
            ranges[-1].append(r)
            held += r.bytes

    def blocks(r: Range) -> Iterator[list[str]]:
        fs, at = store_of(r.path)
        if r.cuts is None:
            with fs.open_input_stream(at, compression="gzip" if r.path.endswith(".gz") else None) as f:
                yield from split_lines(_blocks(f, None), encoding, feeds_only)
            return
        with fs.open_input_file(at) as f:
            begin, end = (_end_of_line(f, r.cuts.origin + k * step(r.cuts), r.size, r.cuts) if 0 < k < r.n else r.size if k else r.cuts.origin for k in (r.k, r.k + 1))
            f.seek(begin)
            yield from split_lines(_blocks(f, end - begin), r.cuts.codec, feeds_only)

    def read(parts):
        for batch in parts:
            for k in batch.column(0).to_pylist():
                for r in ranges[k]:
                    for out in blocks(r):
                        yield pa.record_batch([pa.array(out, pa.string())], names=["value"])

    return spark.range(0, len(ranges), 1, max(1, len(ranges))).mapInArrow(read, "value string")
