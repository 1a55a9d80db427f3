"""Packing tokens into training sequences: bounded-space online packing.

Each partition keeps `open_windows` windows open. A document goes whole into the fullest window that can take it (best
fit). When none can, the fullest is closed: the head of the document fills its gap if that is at least `min_cut` tokens,
and the rest goes on as before. A document longer than a sequence is cut into full sequences first. What is open at the
end of a partition is merged with what neighbouring partitions left, cut freely, and the last part sequence of a merge
ends in pieces of powers of two, which need no padding.

Tokens of a text are those of the tokenizer for each of its words apart: it drops white space and its rules never join
text across it. Words met before come from a bounded table, found by a 64-bit hash.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed each; a text with the tokenizer's
control strings is encoded whole; an empty table gives no row. Extra columns are not read. A tokenizer that tells case
or joins text across white space is refused.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, pieces, stage, table, text_buffers

SEQUENCE = 4096
OPEN_WINDOWS = 64
MIN_CUT = 16
END_ID = 2
#: Pieces of text a worker remembers before it starts over.
MEMORY = 3_000_000
#: Partitions whose leftovers are merged by one task.
MERGE = 16
#: Windows of a partition stay within the same number space.
_SPACE = 1 << 32

_PIECE = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32())), ("left_over", pa.int64())]
)
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>, left_over long"


class Encoder:
    """Ids of texts. Pieces between ASCII blanks are encoded once and kept in sorted hash arrays of bounded size.

    A full stop or comma between an ASCII letter and a blank is a piece of its own, and A-Z are lower-cased first
    (unless "<|" occurs, as control strings are told by case); the tokenizer does both itself, and pieces repeat more.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.memory = memory
        self.forget()
        # what encode() relies on; a tokenizer that tells case or joins text across white space would get wrong ids
        got = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        parts = ["so", "is", "this", ".", "and", "that", ",", "it's", "12", "é"]
        if got(" So IS  this. AND\tthat, it's\n12 é") != [i for x in parts for i in got(x)]:
            raise ValueError(f"{path}: packing takes tokenizers that lower-case and split at white space only")

    def forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hash of a piece, in order, to its slot
        self.at, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)  # ids of slot i: ids[at[i]:at[i+1]]

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        plain = np.fromiter(map(str.isalpha, texts), bool, len(texts))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        lengths, found, n = [], [], int(plain.sum())
        for i in range(0, n, 2000):
            # a word of letters ends at its one token with the end mark, so many can go as one text
            part = order[i : min(i + 2000, n)]
            ids = np.array(self.tokenizer.encode(" ".join([texts[k] for k in part]), add_special_tokens=False).ids, np.int32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                lengths.append(np.diff(cut, prepend=0))
                found.append(ids)
            else:  # a letter that the pattern takes apart
                self._each([texts[k] for k in part], lengths, found)
        self._each([texts[k] for k in order[n:]], lengths, found)
        slots = len(self.at) - 1 + np.arange(len(order))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(lengths))])
        self.ids = np.concatenate([self.ids, *found])
        new = hashes[order]
        rank = np.argsort(new)
        where = np.searchsorted(self.keys, new[rank])
        self.keys, self.slots = np.insert(self.keys, where, new[rank]), np.insert(self.slots, where, slots[rank])

    def _each(self, texts: list[str], lengths: list, found: list) -> None:
        for i in range(0, len(texts), 2000):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 2000], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, got), np.int64, len(got)))
            found.append(np.array([x for ids in got for x in ids], np.int32))

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the n+1 offsets of each text in them."""
        base = int(offsets[0])
        raw, off = raw[base : int(offsets[-1])], offsets - base
        if b"<|" not in raw.tobytes():
            raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        w = Words(raw, off)
        if not len(w.start):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        last, before = raw[w.end - 1], raw[np.maximum(w.end - 2, 0)] | 32
        stop = ((last == 0x2E) | (last == 0x2C)) & (w.end - w.start > 1) & (before >= 97) & (before <= 122)
        cut = w.end[stop] - 1
        w.start = np.sort(np.concatenate([w.start, cut]))
        w.end = np.sort(np.concatenate([w.end, cut]))
        w.first = np.searchsorted(w.start, off)
        h = w.hash
        if len(self.keys) > self.memory:
            self.forget()
        slot = self._find(h)
        if (slot < 0).any():
            miss = np.flatnonzero(slot < 0)
            new, i = np.unique(h[miss], return_index=True)
            text = raw.tobytes()
            self.learn(new, [text[a:b] for a, b in zip(w.start[miss[i]].tolist(), w.end[miss[i]].tolist())])
            slot[miss] = self._find(h[miss])
        n = self.at[slot + 1] - self.at[slot]
        to = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.arange(to[-1]) + np.repeat(self.at[slot] - to[:-1], n)]
        return ids, to[w.first]

    def _find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[i] == h, self.slots[i], -1)


class Packer:
    """Windows of one partition. Closed sequences come out as rows of _PIECE."""

    def __init__(self, first: int, size: int = SEQUENCE, windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT, with_ids: bool = False):
        self.next, self.size, self.most, self.min_cut, self.with_ids = first, size, windows, min_cut, with_ids
        self.open: list[list] = []  # [tokens, [(doc_id, start, ids, doc_tokens)]]
        self.rows: list[tuple] = []

    def close(self, window: list) -> None:
        at = 0
        for doc_id, start, ids, total in window[1]:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at, ids if self.with_ids else None, None))
            at += len(ids)
        self.next += 1

    def add(self, doc_id, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        total = len(ids) if total is None else total
        while len(ids):
            if len(ids) >= self.size:
                self.close([self.size, [(doc_id, start, ids[: self.size], total)]])
                ids, start = ids[self.size :], start + self.size
                continue
            room = self.size - len(ids)
            best = None
            for w in self.open:
                if w[0] <= room and (best is None or w[0] > best[0]):
                    best = w
            if best is None and len(self.open) < self.most:
                best = [0, []]
                self.open.append(best)
            if best is not None:
                best[0] += len(ids)
                best[1].append((doc_id, start, ids, total))
                if best[0] == self.size:
                    self.open.remove(best)
                    self.close(best)
                return
            fullest = max(self.open, key=lambda w: w[0])
            gap = self.size - fullest[0]
            if gap >= self.min_cut:
                fullest[1].append((doc_id, start, ids[:gap], total))
                ids, start = ids[gap:], start + gap
            self.open.remove(fullest)
            self.close(fullest)

    def leftovers(self) -> list[tuple]:
        return [piece for w in sorted(self.open, key=lambda w: -w[0]) for piece in w[1]]


def _emit(rows: list[tuple]):
    for i in range(0, len(rows), 5000):
        columns = list(zip(*rows[i : i + 5000]))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE)], schema=_PIECE)


def pack(documents: DataFrame, tokenizer: str, size: int = SEQUENCE, windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; ids too if asked for.

    `tokenizer`: "package:file" or a path that every executor has.
    """

    def path() -> str:
        module, _, name = tokenizer.rpartition(":")
        return __import__(module).path(name) if module else tokenizer

    def first(parts):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encode, packer = _encoder(path()), Packer(task * _SPACE, size, windows, min_cut, with_ids)
        for batch in parts:
            names = batch.column(0).to_pylist()
            raw, off = text_buffers(batch.column(1))
            for i, j in pieces(off):
                ids, at = encode(raw, off[i : j + 1])
                for k in range(i, j):
                    packer.add(names[k], np.append(ids[at[k - i] : at[k - i + 1]], np.int32(end_id)))
                if len(packer.rows) >= 5000:
                    yield from _emit(packer.rows)
                    packer.rows = []
        rest = [(d, s, len(ids), None, total, k, None, ids, task) for k, (d, s, ids, total) in enumerate(packer.leftovers())]
        yield from _emit(packer.rows + rest)

    def merge(parts):
        packer, current = None, None
        for batch in parts:
            for x in batch.to_pylist():
                if x["group"] != current:
                    if packer:
                        _finish(packer, size)
                        yield from _emit(packer.rows)
                    current = x["group"]
                    packer = Packer((1 << 62) + current * _SPACE, size, 1, 1, with_ids)
                packer.add(x["doc_id"], np.array(x["ids"], np.int32), x["start"], x["doc_tokens"])
        if packer:
            _finish(packer, size)
            yield from _emit(packer.rows)

    packed = stage(documents.select("doc_id", "text").mapInArrow(first, _DDL), "packed")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    rest = packed.where(F.col("left_over").isNotNull()).withColumn("group", F.floor(F.col("left_over") / MERGE).cast("long"))
    # a group holds the open windows of MERGE partitions at most, whatever the input
    merged = rest.repartition("group").sortWithinPartitions("group", "left_over", "sequence_id").mapInArrow(merge, _DDL)
    return packed.where(F.col("left_over").isNull()).select(*columns).unionByName(merged.select(*columns))


def _finish(packer: Packer, size: int) -> None:
    """Close what is open as sequences of powers of two, largest first."""
    for window in packer.open:
        part = size
        pieces = window[1]
        left = window[0]
        while left:
            while part > left:
                part //= 2
            taken, now = [], part
            while now:
                doc_id, start, ids, total = pieces[0]
                taken.append((doc_id, start, ids[:now], total))
                if len(ids) > now:
                    pieces[0] = (doc_id, start + now, ids[now:], total)
                else:
                    pieces.pop(0)
                now -= len(taken[-1][2])
            packer.close([part, taken])
            left -= part
    packer.open = []


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


TOKENIZER = "public_tokenizers:word_bpe_49k.json"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), TOKENIZER)
