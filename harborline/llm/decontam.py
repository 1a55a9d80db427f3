"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts, run once over each document.

Normalising lower-cases A-Z, keeps words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ and joins them with one space; words keep
their byte offsets, so each hit maps back to characters of the original text. A window is `window` consecutive words of
an item, or all words of a shorter item.

Every window of an item holds one whole block of (window + 1) / 2 words that starts at a multiple of that many words. The
automaton has these blocks, a tenth of the text of all windows, and where one occurs the windows around it are looked up
by hash and compared word by word, at a cost that does not grow with the number of items that share the block.

The benchmark is a stated side whose size is checked first. Up to `max_pattern_bytes` of text one automaton scans the
documents, which are not shuffled. Beyond, items are dealt to shards within that bound, of which the driver holds one at
a time; each scans all documents in a job of its own, its hits are a table in the shared folder, and documents meet the
hits of all shards at the end. An item of more than ITEM_WORDS words is dealt as several that overlap.

Defined cases: null and word-less texts have no words, windows or hits; null item ids are left out of the lists but
their windows hit; repeated items count once for each distinct id; item ids may be strings or numbers; empty tables give
no rows or no hits; columns beyond those named are kept by `contamination(..., keep=...)` only when asked for, under any
name but n_words, n_hit, items, spans and clean_text; repeated rows are each scanned; texts of any length are scanned
whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, nameless, release, stage, table

WINDOW = 10
#: Text of the benchmark that one automaton may hold.
MAX_PATTERN_BYTES = 8 << 20
#: Words of an item that stand together in a shard.
ITEM_WORDS = 50_000

#: Each byte to itself if it is part of a word, A-Z to a-z, all else to a space. Bytes from 0x80 belong to words.
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class Machine:
    """The automaton of some items (id, text): blocks of longer items, and shorter items whole. Bytes stand as latin-1 characters.

    Where a block occurs, the windows around it are looked up among the hashes of all windows of the items, and compared word by
    word with one of equal hash. What a block costs there does not depend on how many items hold it."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        import ahocorasick

        self.window, self.block = window, (window + 1) // 2
        self.ids = [x[0] for x in items]
        self.known: dict[bytes, int] = {}
        patterns: dict[str, int] = {}
        size: list[int] = []  # words of each pattern
        blocks: set[int] = set()
        self.shorts: dict[int, list[int]] = {}  # items that are a pattern as a whole
        numbers, owner = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for k, (_, text) in enumerate(items):
            w = words(text)
            n = self.block if len(w) >= window else len(w)
            for i in range(0, len(w) - n + 1, n) if w else ():
                p = patterns.setdefault((b" " + b" ".join(w[i : i + n]) + b" ").decode("latin-1"), len(size))
                if p == len(size):
                    size.append(n)
                if len(w) >= window:
                    blocks.add(p)
                else:
                    self.shorts.setdefault(p, []).append(k)
            if len(w) >= window:
                numbers.append(np.fromiter((self.known.setdefault(x, len(self.known)) for x in w), np.int32, len(w)))
                owner.append(np.full(len(w), k, np.int32))
        self.size = np.array(size, np.int64)
        self.is_block, self.is_short = (np.isin(np.arange(len(size)), list(x)) for x in (blocks, self.shorts))
        self.numbers, owner = np.concatenate(numbers), np.concatenate(owner)
        start = np.arange(max(0, len(owner) - window + 1))
        start = start[owner[start] == owner[start + window - 1]]
        for self.seed in range(1, 100):
            h = self._hashes(self.numbers, start)
            order = np.argsort(h, kind="stable")
            self.keys, first = np.unique(h[order], return_index=True)
            self.place = start[order][first]  # one place of each distinct window
            if all((self.numbers[start[order] + j] == np.repeat(self.numbers[self.place + j], np.diff(np.append(first, len(order))))).all() for j in range(window)):
                break
        self.first, self.owner = np.append(first, len(order)), owner[start[order]]  # items of each distinct window
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, n in patterns.items():
            self.automaton.add_word(p, n)
        if patterns:
            self.automaton.make_automaton()

    def _hashes(self, numbers: np.ndarray, start: np.ndarray) -> np.ndarray:
        """A hash of the window of word numbers at each start."""
        h = np.full(len(start), self.seed, np.uint64)
        for j in range(self.window):
            h ^= numbers[start + j].astype(np.int64).view(np.uint64)
            mix(h)
        return h

    def scan(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges [i, j) of the words of a text, and the numbers of the items found."""
        if not w or not len(self.size):
            return [], set()
        found = np.array(list(self.automaton.iter(" " + b" ".join(w).decode("latin-1") + " ")), np.int64).reshape(-1, 2)
        if not len(found):
            return [], set()
        lengths = np.fromiter(map(len, w), np.int64, len(w))
        # words up to the end of the pattern, by the offset of each word in the line
        last, n = np.searchsorted(np.cumsum(lengths + 1) - lengths, found[:, 0], "right"), found[:, 1]
        short = self.is_short[n]
        spans = [(j - size, j) for j, size in zip(last[short].tolist(), self.size[n[short]].tolist())]
        items = {k for p in np.unique(n[short]).tolist() for k in self.shorts[p]}
        start = np.unique((last[self.is_block[n]] - self.block)[:, None] - np.arange(self.block))
        start = start[(start >= 0) & (start <= len(w) - self.window)]
        if len(start) and len(self.keys):
            numbers = np.fromiter((self.known.get(x, -1) for x in w), np.int32, len(w))
            h = self._hashes(numbers, start)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            same = self.keys[at] == h
            for j in range(self.window):
                same &= numbers[start + j] == self.numbers[self.place[at] + j]
            spans += [(i, i + self.window) for i in start[same].tolist()]
            for k in np.unique(at[same]).tolist():
                items.update(self.owner[self.first[k] : self.first[k + 1]].tolist())
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for i, j in sorted(spans):
        if out and i <= out[-1][1]:
            out[-1] = out[-1][0], max(j, out[-1][1])
        else:
            out.append((i, j))
    return out


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character ranges of the original text."""
    if not spans:
        return []
    raw = text.encode()
    inside = np.frombuffer(raw.translate(_FOLD), np.uint8) != 0x20
    edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[begin[i]]), int(chars[end[j - 1]])) for i, j in spans]


def _parts(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, text with items of more than ITEM_WORDS words as several that overlap by window - 1 words."""

    def run(batches):
        for batch in batches:
            ids, texts = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                w = words(text)
                for i in range(0, max(1, len(w) - window + 1), ITEM_WORDS):
                    ids.append(k)
                    texts.append(b" ".join(w[i : i + ITEM_WORDS + window - 1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(texts, pa.binary())], names=["item_id", "text"])

    return benchmark.mapInArrow(run, f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, text binary")


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(text: str | None, spans: list[tuple[int, int]], clean: bool) -> tuple:
    """n_words, n_hit, spans, clean_text of a text whose word ranges `spans` are hit."""
    spans = merged(spans)
    at = char_spans(text, spans) if spans else []
    rest = text
    if clean and at:
        rest = "".join(text[a:b] for a, b in zip([0, *(e for _, e in at)], [*(s for s, _ in at), len(text)]))
    return len(words(text)), sum(j - i for i, j in spans), [{"start": a, "end": b} for a, b in at], rest if clean else None


def contamination(documents: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, max_pattern_bytes: int = MAX_PATTERN_BYTES, clean: bool = False) -> DataFrame:
    """The kept columns and n_words, n_hit, items (distinct ids), spans (hit characters); with clean, the text without them."""
    kept = [documents[f"`{c}`"] for c in keep]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*kept).schema)
    kind = "string" if benchmark.schema["item_id"].dataType.simpleString() == "string" else "long"
    id_type = pa.string() if kind == "string" else pa.int64()
    schema = f"{fields}, n_words long, n_hit long, items array<{kind}>, spans array<struct<start: long, end: long>>, clean_text string"
    names = [*keep, "n_words", "n_hit", "items", "spans", "clean_text"]
    spark = documents.sparkSession
    items = benchmark.select(F.col("item_id").cast(kind).alias("item_id"), "text").where(F.col("text").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def rows(batch, found):
        """Of the kept columns and text of a batch, with hit ranges and ids of each text."""
        out = [(*_cut(text, spans, clean), ids) for text, (spans, ids) in zip(batch.column(len(keep)).to_pylist(), found)]
        c = list(zip(*out)) if out else [()] * 5
        made = [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[4], pa.list_(id_type)), pa.array(c[2], _SPANS), pa.array(c[3], pa.string())]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], names=names)

    def scanned(machine, text):
        spans, who = machine.scan(words(text))
        return spans, sorted({machine.ids[k] for k in who} - {None})

    if size <= max_pattern_bytes:
        shared = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])

        def whole(parts):
            machine = Machine(shared.value, window)
            for batch in parts:
                yield rows(batch, (scanned(machine, x.as_py()) for x in batch.column(len(keep))))

        return nameless(documents.select(*kept, "text")).mapInArrow(whole, schema)

    # more than one automaton holds: shards scan in turn
    n = int(2 * size // max_pattern_bytes + 1)
    parts_ = stage(_parts(items, window).withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "leaks-items")
    texts = documents.select(F.md5("text").alias("m"), "text").where("text is not null")
    hits = None
    for k in range(n):
        shared = spark.sparkContext.broadcast([(r["item_id"], r["text"].decode()) for r in parts_.where(F.col("shard") == k).select("item_id", "text").collect()])

        def some(parts, shared=shared):
            machine = Machine(shared.value, window)
            for batch in parts:
                out = []
                for m, text in zip(batch.column(0), batch.column(1)):
                    spans, ids = scanned(machine, text.as_py())
                    if spans:
                        out.append((m.as_py(), [{"start": i, "end": j} for i, j in merged(spans)], ids))
                c = list(zip(*out)) if out else [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], _SPANS), pa.array(c[2], pa.list_(id_type))], names=["m", "at", "ids"])

        got = stage(texts.mapInArrow(some, f"m string, at array<struct<start: long, end: long>>, ids array<{kind}>"), f"leaks-{k}")
        hits = got if hits is None else hits.unionByName(got)
        shared.unpersist()
        release(spark)
    # equal texts have equal hits; a table of its own, so that a join on a hot text can be split
    once = hits.dropDuplicates(["m", "at", "ids"]).groupBy("m").agg(F.flatten(F.collect_list("at")).alias("at"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    whole_rows = documents.select(F.md5("text").alias("m"), "text", F.struct(*kept).alias("kept"))
    met = whole_rows.join(stage(once, "leaks-hits"), "m", "left")

    def joined(parts):
        for batch in parts:
            at, ids = (batch.column(len(keep) + i).to_pylist() for i in (1, 2))
            yield rows(batch, (([(x["start"], x["end"]) for x in a or ()], sorted(who or ())) for a, who in zip(at, ids)))

    return nameless(met.select("kept.*", met["text"], met["at"], met["ids"])).mapInArrow(joined, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), n AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM n), d AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win FROM dw, ks, unnest(range(1, len(w) - k + 2)) AS u(i)
), hit AS (
  SELECT d.doc_id, d.i, d.k, n.item_id FROM d JOIN n ON d.win = n.win AND d.k = n.k
), hw AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, k FROM hit), unnest(range(i, i + k)) AS u(j) GROUP BY doc_id
), hi AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
