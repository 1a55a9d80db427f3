"""Periodic runs of words: maximal stretches that repeat with a period, found in linear space for each text.

A run is a stretch of consecutive words whose smallest period q has words q apart identical, of length >= max(least, 2 q),
which no neighbouring word extends. The texts of a piece of a batch are worked on together, every step on arrays:

1. words become numbers by Arrow's dictionary; ranks of 1, 2, 4, ... words are doubled until every suffix of a text stands alone.
   Only suffixes that are still tied are sorted again, so plain prose costs a few rounds. This is the suffix array; the ranks of
   each round are kept, and from them comes the LCP of neighbours, level by level.
2. The longest previous factor of a position is the larger LCP with the nearest suffixes in order, on either side, that start
   earlier. Pointers jump over suffixes that start later, until none is left.
3. Factors cut each text into LZ blocks. A run that touches a block's start b has a period below the two blocks' length, so
   for each such period p the words at b and at b + p, and at b - p and b, are extended to both sides (Main). Extensions are read
   from the ranks as well, so a period costs the logarithm of its run, not the run.
4. Any other run lies strictly inside a block and so within the block's earlier occurrence too: it is copied from the
   bucket of its start there, buckets in order, so that blocks which overlap their own source copy what was just copied.
5. A stretch found with several periods keeps the smallest.

Texts without a factor of least / 2 words have no run and end after step 2. A text is worked on whole, with about 60 bytes of
memory a word and 4 for each doubling that its longest repeat needs.

Null and empty texts have no words and no runs. Rows are independent of each other: repeated ids and rows each give their own
result. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, pieces, table, text_buffers, trimmed

LEAST = 12
#: Candidate periods that are extended at a time.
_SLICE = 1 << 20


class Suffixes:
    """Suffix array of several texts, which no comparison leaves, with the ranks of each doubling."""

    def __init__(self, key: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """key: a number for each word, different between texts and rising with them; begin and end: of its text, by word."""
        n = len(key)
        self.begin, self.end = begin, end
        self.sa = sa = np.argsort(key, kind="stable").astype(np.int32)
        head = np.ones(n, bool)
        head[1:] = key[sa[1:]] != key[sa[:-1]]
        slot = np.arange(n, dtype=np.int32)
        start = np.maximum.accumulate(np.where(head, slot, 0))
        rank = np.empty(n, np.int32)
        rank[sa] = start
        self.levels = [rank.copy()]
        parted = np.where(head, 0, -1).astype(np.int8)  # the level at which a suffix parts from the one before it
        while True:
            tied = ~head
            tied[:-1] |= tied[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            pos = sa[at]
            there = pos.astype(np.int64) + (1 << (len(self.levels) - 1))
            second = np.where(there < end[pos], rank[np.minimum(there, n - 1)].astype(np.int64) + 1, 0)
            group = start[at].astype(np.int64) * (n + 1)
            order = np.argsort(group + second, kind="stable")
            both = (group + second)[order]
            sa[at] = pos[order]
            fresh = np.ones(len(at), bool)
            fresh[1:] = both[1:] != both[:-1]
            parted[at[fresh & ~head[at]]] = len(self.levels)
            head[at] = fresh
            start[at] = np.maximum.accumulate(np.where(fresh, at, 0)).astype(np.int32)
            rank[sa[at]] = start[at]
            self.levels.append(rank.copy())
        self.lcp = self._lcp(parted)

    def _lcp(self, parted: np.ndarray) -> np.ndarray:
        """Words that a suffix and the one before it in order begin with."""
        lcp = np.where(parted > 0, 1 << np.maximum(parted.astype(np.int32) - 1, 0), 0).astype(np.int32)
        for level in range(int(parted.max(initial=0)) - 2, -1, -1):
            r = np.flatnonzero(parted >= level + 2)
            i, j = self.sa[r - 1] + lcp[r], self.sa[r] + lcp[r]
            inside = np.maximum(i, j) < self.end[self.sa[r]]
            r, i, j = r[inside], i[inside], j[inside]
            same = self.levels[level][i] == self.levels[level][j]
            lcp[r[same]] += 1 << level
        return lcp

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are the same from i and j on, i before j in one text; j may be its end."""
        out = np.zeros(len(i), np.int64)
        end = self.end[i]
        for level in range(len(self.levels) - 1, -1, -1):
            x = np.flatnonzero(j + out < end)
            same = self.levels[level][i[x] + out[x]] == self.levels[level][j[x] + out[x]]
            out[x[same]] += 1 << level
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are the same before i and before j."""
        out = np.zeros(len(i), np.int64)
        begin = self.begin[np.minimum(j, len(self.begin)) - 1]
        for level in range(len(self.levels) - 1, -1, -1):
            back = out + (1 << level)
            x = np.flatnonzero(i - back >= begin)
            same = self.levels[level][i[x] - back[x]] == self.levels[level][j[x] - back[x]]
            out[x[same]] += 1 << level
        return out

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word the length of the longest factor from there that also starts earlier, and where."""
        n, sa = len(self.sa), self.sa
        length, source = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for step in (-1, 1):
            low = self.lcp.copy() if step < 0 else np.append(self.lcp[1:], np.int32(0))
            to = np.clip(np.arange(n, dtype=np.int32) + step, 0, n - 1)
            open_ = np.flatnonzero((low > 0) & (sa[to] > sa))
            while len(open_):
                over = to[open_]
                least, beyond = np.minimum(low[open_], low[over]), to[over]
                low[open_], to[open_] = least, beyond
                open_ = open_[(least > 0) & (sa[beyond] > sa[open_])]
            longer = low > length[sa]
            length[sa[longer]], source[sa[longer]] = low[longer], sa[to[longer]]
        return length, source


def _touching(s: Suffixes, at: np.ndarray, spread: np.ndarray, least: int) -> np.ndarray:
    """(start, end, period) of the stretches that touch a boundary `at`, with a period of up to its spread."""
    half = -(-least // 2)
    level = max(0, (-(-half // 2)).bit_length() - 1)  # one of the two extensions has half of half the least length
    width = 1 << level
    ranks = s.levels[min(level, len(s.levels) - 1)]
    found = []
    edges = np.concatenate([[0], np.cumsum(spread)])
    for lo in range(0, int(edges[-1]), _SLICE):
        c = np.arange(lo, min(lo + _SLICE, int(edges[-1])))
        k = np.searchsorted(edges, c, "right") - 1
        b, p = at[k], c - edges[k] + 1
        begin, end = s.begin[b - 1], s.end[b - 1]
        for x, y in ((b, b + p), (b - p, b)):
            ok = (x >= begin) & (y <= end)
            u, v, first, last = x[ok], y[ok], begin[ok], end[ok]
            near = np.zeros(len(u), bool)
            f = np.flatnonzero(v + width <= last)
            near[f] = ranks[u[f]] == ranks[v[f]]
            f = np.flatnonzero(u - width >= first)
            near[f] |= ranks[u[f] - width] == ranks[v[f] - width]
            u, v = u[near], v[near]
            if len(u):
                start, stop = u - s.backward(u, v), v + s.forward(u, v)
                whole = stop - start >= np.maximum(least, 2 * (v - u))
                found.append(np.stack([start[whole], stop[whole], (v - u)[whole]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def runs_of(ids: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period), in this order, of the runs of texts: ids numbers words, text i has first[i] to first[i+1]."""
    none = np.zeros((0, 4), np.int64)
    if not len(ids):
        return none
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    begin, end = first[:-1][text].astype(np.int64), first[1:][text].astype(np.int64)
    s = Suffixes(text * (int(ids.max()) + 1) + ids, begin, end)
    length, source = s.previous_factors()
    if not (length >= -(-least // 2)).any():
        return none
    may = np.zeros(len(sizes), bool)  # texts with a factor that a run could have made
    may[text[length >= -(-least // 2)]] = True
    step, i, blocks = np.maximum(length, 1).tolist(), 0, []
    for t in np.flatnonzero(may).tolist():
        i, stop = int(first[t]), int(first[t + 1])
        while i < stop:
            blocks.append(i)
            i += step[i]
    at = np.array(blocks, np.int64)
    size = np.array([step[i] for i in blocks], np.int64)
    opens, closes = at == begin[at], at + size == end[at]
    joint = np.flatnonzero(~opens)
    bounds = np.concatenate([at[joint], (at + size)[closes]])
    spread = np.concatenate([size[joint] + size[joint - 1], size[closes]])
    touching = _touching(s, bounds, spread, least)
    buckets: dict[int, dict[int, int]] = {}
    for b, e, p in touching.tolist():
        ends = buckets.setdefault(b, {})
        ends[e] = min(p, ends.get(e, p))
    if buckets:
        long = np.flatnonzero((size >= least + 2) & (length[at] > 0))
        for b, m in zip(at[long].tolist(), size[long].tolist()):
            src = int(source[b])
            for x in range(src + 1, src + m - least):
                for e, p in list(buckets.get(x, {}).items()):
                    if e < src + m:
                        buckets.setdefault(x + b - src, {})[e + b - src] = p
    rows = [(b, e - b, p) for b, ends in buckets.items() for e, p in ends.items()]
    if not rows:
        return none
    out = np.array(rows, np.int64)
    out = out[np.lexsort((out[:, 2], out[:, 0]))]
    owner = text[out[:, 0]]
    return np.column_stack([owner, out[:, 0] - first[owner], out[:, 1], out[:, 2]])


def _joined(w: Words, kept: np.ndarray) -> list[str]:
    """The kept words of each text, with one space between."""
    size = w.end - w.start
    b, n = w.start[kept], size[kept] + 1
    at = np.concatenate([[0], np.cumsum(n)])
    raw = np.append(w.raw, np.uint8(0x20))
    out = raw[np.minimum(np.repeat(b - at[:-1], n) + np.arange(at[-1]), len(raw) - 1)]
    out[at[1:] - 1] = 0x20
    edge = at[np.concatenate([[0], np.cumsum(kept)])[w.first]]
    data = out.tobytes()
    return [data[i : max(i, j - 1)].decode() for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def runs(documents: DataFrame, keep: list[str] | None = None, least: int = LEAST) -> DataFrame:
    """The columns `keep` (doc_id alone if not given) of each row with n_words, runs (array of start, length and period, by start,
    then period) and collapsed_text: the text's words without those that a run holds after its first period, by one space each.
    Kept columns may have any name but those three."""
    if least < 2:
        raise ValueError("a run has two words at least")
    keep = keep or ["doc_id"]
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), F.col("text").alias("text"))

    def work(parts):
        for batch in parts:
            raw, off = text_buffers(batch.column(1))
            for i, j in pieces(off):
                w = Words(raw, off[i : j + 1])
                found = runs_of(w.encoded().indices.to_numpy(zero_copy_only=False).astype(np.int64), w.first, least)
                # words that some run holds after its first period: +1 where they begin, -1 where they end
                base = w.first[found[:, 0]]
                cover = np.zeros(len(w.start) + 1, np.int32)
                np.add.at(cover, base + found[:, 1] + found[:, 3], 1)
                np.add.at(cover, base + found[:, 1] + found[:, 2], -1)
                texts = _joined(w, np.cumsum(cover[:-1]) == 0)
                edges = pa.array(np.searchsorted(found[:, 0], np.arange(j - i + 1)).astype(np.int32))
                values = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], fields=list(_RUNS.value_type))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(w.first).astype(np.int64)), pa.ListArray.from_arrays(edges, values), pa.array(texts, pa.string())],
                    names=["kept", "n_words", "runs", "collapsed_text"],
                )

    ddl = f"kept {rows.schema['kept'].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text string"
    return rows.mapInArrow(trimmed(work), ddl).select("kept.*", "n_words", "runs", "collapsed_text")


def planted(documents: DataFrame) -> DataFrame:
    """doc_id and text, where the words of every tenth document (by the checksum of its id) go round in a period from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))

    def turned(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int"))), " "))

    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    # an array of one array, so that the words are taken once
    return documents.select("doc_id", F.when(h % 10 == 0, F.transform(F.array(words), turned)[0]).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(*(x for c in ("start", "length", "period") for x in (r[c].cast("string"), F.lit("\n" if c == "period" else ","))))), "")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("top.length") / (-F.col("top.period"))).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


#: A run of period q and L words is a chain of L - q - 5 equal stretches of six words, q apart: L - q is six or more.
SQL = r"""
WITH c AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS h
  FROM documents
), m AS (
  SELECT *, CAST(h // 10 AS BIGINT) AS g, len(w) AS n FROM c
), a AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM m
), d AS (
  SELECT doc_id, row, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) END AS w FROM a
), words AS (
  SELECT row, n, i, w[i + 1] AS word, hash(w[i + 1 : i + 6]) AS k, w[i + 1 : i + 6] AS six FROM d, unnest(range(n)) AS u(i)
), pairs AS (
  SELECT x.row, y.i - x.i AS q, x.i FROM words AS x JOIN words AS y ON x.row = y.row AND x.k = y.k AND x.six = y.six WHERE x.i < y.i AND y.i + 6 <= y.n
), chains AS (
  SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS chain FROM pairs
), stretches AS (
  SELECT row, min(i) AS s, max(i) + 6 + q AS e, q FROM chains GROUP BY row, q, chain HAVING max(i) - min(i) + 6 + q >= greatest(12, 2 * q)
), runs AS (
  SELECT row, s, e - s AS l, min(q) AS q FROM stretches GROUP BY row, s, e
), of_row AS (
  SELECT row, count(*) AS n_runs, arg_min({'s': s, 'l': l, 'q': q}, {'l': -l, 's': s, 'q': q}) AS top, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY row
), gone AS (
  SELECT DISTINCT row, i FROM (SELECT row, unnest(range(s + q, s + l)) AS i FROM runs)
), kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (row, i) GROUP BY row
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.q AS period, 1000 * top.l // top.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN of_row USING (row) LEFT JOIN kept USING (row)
"""
