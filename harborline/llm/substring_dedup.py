"""Substring deduplication: of each passage of `window` words or more that recurs, the first occurrence stays.

Words are [^\\x20\\x09-\\x0D]+, unchanged. A word goes if a window of `window` consecutive words that covers it also
starts earlier: in a smaller doc_id, or earlier in the same document. Windows are judged on the input.

1. Winnowing picks an anchor of 8 words for each window, by content alone. Windows in a row with one anchor are a
   segment, with a hash of all its words. Anchors met once cannot hold a repeat and are dropped.
2. Equal segments of an anchor are aggregated: all but the first are repeats as a whole.
3. Where an anchor has different segments they may still share windows. These, first occurrences only, are the
   reference shards, one for each anchor: a suffix automaton of the shard is built in order of occurrence, each segment
   streams through it for its matching statistics and spans that reach the threshold are repeats.
4. Anchors with more than SHARD segments would make a shard without bound (a passage that very many documents share,
   each with other words around it). For these, windows are aggregated by hash instead, which gives the same answer.
5. The spans of a document are merged and cut.

The shards of a whole corpus have no size bound, so they are not broadcast to all documents: segments are sent to the
shard of their anchor, which is the only one that can hold their windows. Each shuffle is of aggregates or feeds a join
that Spark splits where a key is hot.

Defined cases: null texts have no words; a null doc_id comes before all others; texts below `window` words are kept. A
document is an id and a text: rows that repeat both are one document, of which each is cut alike and none is the other's
repeat; rows that share an id (or have none) but not the text are documents of their own, in order of a hash of the text,
and spans are cut only from the text they were found in. Empty tables give no rows. Extra columns may have any name but
n_words, n_removed, kept_sha256 and kept_text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix, nameless, pieces, release, rolling, stage, table, text_buffers, trimmed

WINDOW = 20
ANCHOR = 8
#: Segments of an anchor that one automaton takes; more are compared by window hashes.
SHARD = 128
_FIRST = -(1 << 63)


class SuffixAutomaton:
    """A suffix automaton over words of several texts. Adding a text starts again at the root."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _extend(self, last: int, word) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            if length[last] + 1 == length[q]:
                return q
            return self._clone(last, word, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[cur] = q if length[p] + 1 == length[q] else self._clone(p, word, q)
        return cur

    def _clone(self, p: int, word, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = c
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = c
            p = link[p]
        return c

    def add(self, words) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def matching(self, words) -> list[int]:
        """For each place, the length of the longest run of words ending there that some added text has."""
        state, n, out = 0, 0, []
        nxt, link, length = self.next, self.link, self.length
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def long_spans(statistics: list[int], threshold: int) -> list[tuple[int, int]]:
    """Maximal runs (first window start, number of windows) whose matches reach the threshold."""
    out: list[tuple[int, int]] = []
    for end, n in enumerate(statistics):
        if n >= threshold:
            start = end - threshold + 1
            if out and out[-1][0] + out[-1][1] == start:
                out[-1] = out[-1][0], out[-1][1] + 1
            else:
                out.append((start, 1))
    return out


def segments(w: Words, window: int) -> tuple[np.ndarray, ...]:
    """Of some texts: anchor hash, hash of all words, text, first window start within the text, number of windows."""
    h, none = w.hash, np.zeros(0, np.int64)
    starts = len(h) - window + 1
    if starts <= 0:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    k = min(ANCHOR, window)
    gram = rolling(h, k)
    best, place = gram[:starts].copy(), np.zeros(starts, np.int32)
    for j in range(1, window - k + 1):
        other = gram[j : j + starts]
        better = other <= best
        np.copyto(best, other, where=better)
        place[better] = j
    place = place + np.arange(starts)
    doc = w.doc()
    ok = doc[:starts] == doc[window - 1 :]
    begin = ok.copy()
    begin[1:] &= ~ok[:-1] | (place[1:] != place[:-1]) | (doc[1:starts] != doc[: starts - 1])
    at = np.flatnonzero(begin)
    cut = np.concatenate([np.flatnonzero(begin | ~ok), [starts]])
    n = cut[np.searchsorted(cut, at, "right")] - at
    from .common import _powers

    up, down = _powers(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)])])
    whole = mix((total[at + n + window - 1] - total[at]) * down[at] + n.astype(np.uint64))
    return best[at], whole, doc[at], at - w.first[doc[at]], n


_SEG = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("doc", pa.int64()), ("u", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(_FIRST).cast("long"))


def _rows(documents: DataFrame, *more: Column) -> DataFrame:
    """text, doc and u, which together tell a document from all others, and more columns."""
    return documents.select(documents["text"].alias("text"), _key(documents["doc_id"]).alias("doc"), F.xxhash64(documents["text"]).alias("u"), *more)


def _segment_rows(documents: DataFrame, window: int) -> DataFrame:
    def run(parts):
        for batch in parts:
            ids, of = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            raw, off = text_buffers(batch.column(2))
            for i, j in pieces(off):
                a, c, doc, s, n = segments(Words(raw, off[i : j + 1]), window)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(ids[i + doc]), pa.array(of[i + doc]), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))], schema=_SEG)

    return documents.select("doc", "u", "text").mapInArrow(trimmed(run), "a long, c long, doc long, u long, s int, n int")


_REP = pa.schema([("a", pa.int64()), ("k", pa.int64()), ("doc", pa.int64()), ("u", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("words", pa.string())])


def _with_words(documents: DataFrame, reps: DataFrame, window: int) -> DataFrame:
    """Segments (a, k, doc, u, s, n) and their words, joined by spaces; as often as a document's row is repeated."""
    asked = reps.groupBy("doc", "u").agg(F.collect_list(F.struct("a", "k", "s", "n")).alias("asked"))
    rows = documents.join(asked, ["doc", "u"]).select("doc", "u", "text", "asked")

    def run(parts):
        for batch in parts:
            for at in range(batch.num_rows):
                doc, u, text, wanted = (batch.column(i)[at] for i in range(4))
                words = Words(*text_buffers(pa.array([text.as_py()], pa.string())))
                raw = words.raw.tobytes()
                out = []
                for x in wanted.as_py():
                    i, j = x["s"], x["s"] + x["n"] + window - 1
                    picked = b" ".join(raw[b:e] for b, e in zip(words.start[i:j].tolist(), words.end[i:j].tolist()))
                    out.append((x["a"], x["k"], doc.as_py(), u.as_py(), x["s"], x["n"], picked.decode()))
                for i in range(0, len(out), 4000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 4000]), _REP)], schema=_REP)

    return rows.mapInArrow(trimmed(run), "a long, k long, doc long, u long, s int, n int, words string")


_SPAN = pa.schema([("doc", pa.int64()), ("u", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])


def _by_automata(reps: DataFrame, window: int) -> DataFrame:
    """Repeats among the segments of each anchor; rows come with those of an anchor together, in order."""

    def run(parts):
        current, machine, last, out = None, None, None, []
        for batch in parts:
            for a, doc, u, s, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if a != current:
                    current, machine, last = a, SuffixAutomaton(), None
                if (doc, u, s) == last:
                    continue  # the row of a document again
                last = doc, u, s
                words = text.split(" ")
                out += [(doc, u, s + i, n) for i, n in long_spans(machine.matching(words), window)]
                machine.add(words)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SPAN)], schema=_SPAN)
                out = []

    ordered = reps.select("a", "doc", "u", "s", "words").repartition("a").sortWithinPartitions("a", "doc", "u", "s")
    return ordered.mapInArrow(trimmed(run), "doc long, u long, s int, n int")


def _by_windows(reps: DataFrame, window: int) -> DataFrame:
    """The same for anchors of very many segments, window by window."""

    def run(parts):
        for batch in parts:
            out = []
            for doc, u, s, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = text.split(" ")
                for i in range(len(words) - window + 1):
                    d = hashlib.blake2b(" ".join(words[i : i + window]).encode(), digest_size=16).digest()
                    out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), doc, u, s + i))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["x", "y", "doc", "u", "s"])

    rows = reps.select("doc", "u", "s", "words").mapInArrow(trimmed(run), "x long, y long, doc long, u long, s int")
    rows = stage(rows, "dedup-windows")
    first = stage(rows.groupBy("x", "y").agg(F.min(F.struct("doc", "u", "s")).alias("f"), F.count("*").alias("m")).where("m > 1").drop("m"), "dedup-windows-first")
    return rows.join(first, ["x", "y"]).where(F.struct("doc", "u", "s") != F.col("f")).select("doc", "u", "s", F.lit(1).alias("n"))


def repeats(documents: DataFrame, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """doc, u, s, n: runs of n windows from word s of document doc (doc_id; nulls as the smallest long), u (hash of its text) that
    start earlier elsewhere."""
    spark = documents.sparkSession
    rows = _rows(documents)
    found = _segment_rows(rows, window)
    # a table of its own: a join whose sides are both dealt anew can be split where an anchor is hot
    twice = stage(found.groupBy("a").agg(F.count("*").alias("m")).where("m > 1").select("a"), "dedup-twice")
    candidates = stage(found.join(twice, "a", "left_semi"), "dedup-candidates")
    release(spark)
    first = candidates.groupBy("a", "c").agg(F.min(F.struct("doc", "u", "s", "n")).alias("f"), F.count("*").alias("m"))
    first = stage(first.select("a", "c", "f.doc", "f.u", "f.s", "f.n", "m"), "dedup-first")
    copies = first.where("m > 1").select("a", "c", F.col("doc").alias("d0"), F.col("u").alias("u0"), F.col("s").alias("s0"))
    whole = candidates.join(copies, ["a", "c"]).where("doc != d0 or u != u0 or s != s0").select("doc", "u", "s", "n")
    several = stage(first.groupBy("a").agg(F.count("*").alias("k")).where("k > 1"), "dedup-several")
    reps = first.join(several, "a").select("a", "k", "doc", "u", "s", "n")
    reps = stage(_with_words(rows, reps, window), "dedup-shards")
    release(spark)
    partly = _by_automata(reps.where(F.col("k") <= shard), window).unionByName(_by_windows(reps.where(F.col("k") > shard), window))
    return stage(whole.unionByName(partly), "dedup-repeats")


def _kept(w: Words, spans: list[dict] | None, window: int) -> np.ndarray:
    n = len(w.start)
    edge = np.zeros(n + 1, np.int64)
    for x in spans or ():
        edge[min(x["s"], n)] += 1
        edge[min(x["s"] + x["n"] + window - 1, n)] -= 1
    return np.cumsum(edge[:-1]) == 0


def dedup(documents: DataFrame, window: int = WINDOW, keep: list[str] | None = None, shard: int = SHARD) -> DataFrame:
    """The kept columns (doc_id if none are named) and n_words, n_removed, kept_sha256 (kept words joined by one space) and kept_text.

    kept_text is the text itself if nothing is removed; else what is left of it between removed spans, joined by line feeds.
    """
    keep = keep or ["doc_id"]
    spans = repeats(documents, window, shard).groupBy("doc", "u").agg(F.collect_list(F.struct("s", "n")).alias("spans"))
    release(documents.sparkSession)
    rows = _rows(documents, F.struct(*(documents[f"`{c}`"] for c in keep)).alias("kept")).join(spans, ["doc", "u"], "left").select("kept.*", "text", "spans")
    names, kept_fields = list(keep), documents.select(*(documents[f"`{c}`"] for c in keep)).schema

    def run(parts):
        for batch in parts:
            out = []
            for text, found in zip(batch.column(len(names)), batch.column(len(names) + 1)):
                text = text.as_py()
                w = Words(*text_buffers(pa.array([text or ""], pa.string())))
                ok = _kept(w, found.as_py(), window)
                raw = w.raw.tobytes()
                digest = hashlib.sha256(b" ".join([raw[b:e] for b, e in zip(w.start[ok].tolist(), w.end[ok].tolist())])).hexdigest()
                rest = text
                if not ok.all():
                    edge = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
                    rest = b"\n".join(raw[w.start[i] : w.end[j - 1]] for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))).decode()
                out.append((len(ok), int((~ok).sum()), digest, rest))
            c = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string())],
                names=[*names, "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_fields)
    return nameless(rows).mapInArrow(trimmed(run), f"{fields}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS k FROM d, unnest(range(1, len(w) - 18)) AS u(i)
), ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win
), gone AS (
  SELECT DISTINCT doc_id, j FROM ranked, unnest(range(i, i + 20)) AS u(j) WHERE r > 1
), words AS (
  SELECT doc_id, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(j)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
