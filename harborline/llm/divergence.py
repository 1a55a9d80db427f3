"""How far the sources of a language differ in their words, and by which words.

Terms are runs of letters (A-Z lower-cased alone, anything beyond ASCII is a letter). Each language keeps the terms that at least
MIN_DOCS of its documents hold. A group, which is a source within a language, or the language as a whole, gives a kept term the
share p = 1 + floor(SCALE (count + 2) / (N + 2 V)), N the group's counts of kept terms and V their number. Two groups differ in a
term by f = floor((p - q)^2 / (p + q)). All of it is integer arithmetic.

Most terms of a corpus are rare, and share their counts with many others. So terms are grouped by their sparse vector of counts, one
entry for each source that has the term, and what pairs of sources add is worked out once for each distinct vector and multiplied
by the number of its terms. A vector adds to pairs of sources that it names only: what a pair sums to is split into

    V f(0, 0) + sum over x [f(x, 0) - f(0, 0)] + sum over y [f(0, y) - f(0, 0)] + sum over x, y [f(x, y) - f(x, 0) - f(0, y) + f(0, 0)],

x and y being the counts above nought of the one and the other, f(x, y) that of their shares; the sums in the middle go by the
distinct counts of each source. So the work is the pairs of entries within distinct vectors, and no source is paired with a term
that it lacks. Original terms are ranked for each group by their own f.

Counting is one pass: a task adds up its own terms before anything is shuffled, so a hot source costs no more than its vocabulary.
A row is a document, whatever its id. Null text, lang and source are read as ''. A language without kept terms has value 0 for all
its pairs; one with a single source has no pairs. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PIECE_BYTES, Words, pieces, stage, table, text_buffers, trimmed, unstage

SCALE = 1_000_000_000
MIN_DOCS = 10
TOP = 10
#: Different (group, term) pairs that a task holds at most before it gives them away.
HELD = 1 << 20
_COUNTED = ["lang", "source", "term", "count", "docs"]
#: Bytes that are no letter: ASCII but A-Z and a-z.
_NO_LETTER = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 terms)); the product is a decimal where it may leave 64 bits."""
    below = F.nullif(total + 2 * terms, F.lit(0))
    wide = F.call_function("div", (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), below.cast("decimal(20,0)"))
    return F.when(count < (1 << 62) // SCALE, F.call_function("div", (count + 2) * F.lit(SCALE).cast("long"), below)).otherwise(wide) + 1


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)): shares are below 2^30, so squares have 60 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _cut(raw: np.ndarray, lo: int, hi: int) -> int:
    """Where to cut a text that goes on to hi, some bytes after lo: behind a byte that is no letter."""
    at = min(hi, lo + PIECE_BYTES)
    while at < hi:
        found = np.flatnonzero(_NO_LETTER[raw[at : at + 4096]])
        if len(found):
            return at + int(found[0]) + 1
        at += 4096
    return hi


class _Tally:
    """Occurrences and texts of (group, term) in a task. What has been counted is added up as it grows, and given away when more
    than HELD pairs are different, so a task's memory is bounded and what it emits is little more than its vocabulary."""

    def __init__(self):
        self.groups: dict[tuple, int] = {}
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.parts: list[tuple] = []
        self.size = 0

    def group(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def add(self, groups: np.ndarray, terms: Words, seen: set | None = None) -> None:
        """groups: of each text. seen: terms that an earlier part of the one text here has held."""
        coded = terms.encoded()
        code, many = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
        doc, names = terms.doc(), coded.dictionary.to_pylist()
        once = np.unique(doc * many + code)
        keys, count = np.unique(groups[doc] * many + code, return_counts=True)
        held = np.zeros(len(keys), np.int64)
        np.add.at(held, np.searchsorted(keys, groups[once // many] * many + once % many), 1)
        if seen is not None:
            held *= np.array([n not in seen for n in names], bool)[keys % many]
            seen.update(names)
        ids = np.array([self.ids.setdefault(n, len(self.ids)) for n in names], np.int64)
        self.parts.append(((keys // many << 40) + ids[keys % many], count, held))
        self.size += len(keys)

    def folded(self) -> int:
        """Add up what is there; the number of different pairs."""
        if len(self.parts) > 1:
            keys, at = np.unique(np.concatenate([p[0] for p in self.parts]), return_inverse=True)
            self.parts = [(keys, *(np.bincount(at, np.concatenate([p[k] for p in self.parts])).astype(np.int64) for k in (1, 2)))]
        self.size = len(self.parts[0][0]) if self.parts else 0
        return self.size

    def emit(self):
        self.folded()
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        for keys, count, held in self.parts:
            names = pa.array(self.ids, pa.binary())
            for lo in range(0, len(keys), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                group, term = pa.array(keys[part] >> 40), names.take(pa.array(keys[part] & ((1 << 40) - 1))).cast(pa.string())
                yield pa.record_batch([langs.take(group), sources.take(group), term, pa.array(count[part]), pa.array(held[part])], names=_COUNTED)
        self.clear()


def counted(documents: DataFrame) -> DataFrame:
    """lang, source, term, count (occurrences) and docs (rows that hold it); a null term for every group, so that groups without
    terms are there. A long text is counted in parts, with the set of its terms, so memory does not grow with it but for that set."""
    read = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)

    def work(parts):
        tally = _Tally()
        for batch in parts:
            raw, off = text_buffers(batch.column(2))
            groups = np.array([tally.group(x, y) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.int64)
            for i, j in pieces(off):
                if off[j] - off[i] <= 2 * PIECE_BYTES:
                    tally.add(groups[i:j], Words(raw, off[i : j + 1], True, _NO_LETTER))
                else:
                    lo, seen = int(off[i]), set()
                    while lo < off[j]:
                        hi = _cut(raw, lo, int(off[j]))
                        tally.add(groups[i:j], Words(raw, np.array([lo, hi]), True, _NO_LETTER), seen)
                        lo = hi
                if tally.size > 2 * HELD and tally.folded() > HELD:
                    yield from tally.emit()
        yield from tally.emit()
        none = pa.array(np.zeros(len(tally.groups), np.int64))
        yield pa.record_batch([*(pa.array([g[k] for g in tally.groups], pa.string()) for k in (0, 1)), pa.nulls(len(none), pa.string()), none, none], names=_COUNTED)

    rows = documents.select(read("lang"), read("source"), F.col("text").alias("text"))
    each = rows.mapInArrow(trimmed(work), "lang string, source string, term string, count long, docs long")
    return each.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def divergence(documents: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: for each source of a language how far it is from each other one,
    and the `top` terms in which it is furthest above its language."""
    counts = stage(counted(documents), "term-counts")
    # sources of a language are numbered from 1 by name; kept terms carry their vector (number, count) in this order
    groups = counts.where("term is null").groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    groups = stage(groups, "sources")
    numbers = groups.select("lang", F.posexplode("sources").alias("at", "source")).select("lang", "source", (F.col("at") + 1).alias("at"))
    vectors = (
        counts.where("term is not null").join(numbers, ["lang", "source"]).groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("at", "count"))).alias("vector")).where(F.col("docs") >= min_docs)
    )
    vectors = stage(vectors.select("lang", "term", "vector"), "vectors")
    distinct = stage(vectors.groupBy("lang", "vector").agg(F.count("*").alias("terms")), "distinct-vectors")
    entries = distinct.select("lang", "terms", F.explode("vector").alias("e")).select("lang", "terms", "e.at", "e.count")
    histogram = stage(entries.groupBy("lang", "at", "count").agg(F.sum("terms").alias("terms")), "histogram")
    sums = histogram.groupBy("lang", "at").agg(F.sum(F.col("count") * F.col("terms")).alias("n"))
    kept = distinct.groupBy("lang").agg(F.sum("terms").alias("v"))
    totals = numbers.join(sums, ["lang", "at"], "left").join(kept, "lang", "left")
    totals = totals.groupBy("lang").agg(
        F.first(F.coalesce("v", F.lit(0))).alias("v"), F.sum("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("at", "source", F.coalesce("n", F.lit(0)).alias("n")))).alias("groups"),
    )
    # one row a language, with its sources in order and the share of a term that a source lacks
    totals = totals.withColumn("n", F.coalesce("n", F.lit(0)))
    full = lambda g: F.struct(g["at"].alias("at"), g["source"].alias("source"), g["n"].alias("n"), _share(F.lit(0), g["n"], F.col("v")).alias("zero"))
    totals = stage(totals.withColumn("groups", F.transform("groups", full)), "languages")
    out = _ranked(_pairs(distinct, histogram, totals), "pair").unionByName(_ranked(_terms(vectors, totals), "term", top))
    unstage(counts)
    return out


def _pairs(distinct: DataFrame, histogram: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item, value of each two sources of a language, both ways."""
    group = lambda at: F.get("groups", at - 1)
    later = lambda array, at: F.slice(array, at + 1, F.greatest(F.size(array) - at, F.lit(0)))
    ga, gb = F.col("x.zero"), F.col("y.zero")
    base = totals.select("lang", "v", "groups", F.explode("groups").alias("x")).select("lang", "v", "x", F.explode(later("groups", F.col("x.at"))).alias("y"))
    base = base.select("lang", F.col("x.at").alias("a"), F.col("y.at").alias("b"), F.coalesce(F.col("v") * _apart(ga, gb), F.lit(0)).alias("value"))
    one = histogram.join(totals, "lang").select("lang", "groups", "terms", "at", _share(F.col("count"), group(F.col("at"))["n"], F.col("v")).alias("p"), group(F.col("at"))["zero"].alias("z"))
    one = one.select("lang", "terms", "at", "p", "z", F.explode("groups").alias("y")).where("at != y.at")
    one = one.select("lang", F.least("at", "y.at").alias("a"), F.greatest("at", "y.at").alias("b"), (F.col("terms") * (_apart(F.col("p"), gb) - _apart(F.col("z"), gb))).alias("value"))
    filled = distinct.where(F.size("vector") > 1).join(totals, "lang")
    entry = lambda e, i: F.struct((i + 1).alias("i"), e["at"].alias("at"), _share(e["count"], group(e["at"])["n"], F.col("v")).alias("p"), group(e["at"])["zero"].alias("z"))
    filled = filled.select("lang", "terms", F.transform("vector", entry).alias("entries"))
    filled = filled.select("lang", "terms", "entries", F.explode("entries").alias("x")).select("lang", "terms", "x", F.explode(later("entries", F.col("x.i"))).alias("y"))
    px, zx, py, zy = (F.col(c) for c in ("x.p", "x.z", "y.p", "y.z"))
    two = filled.select("lang", F.col("x.at").alias("a"), F.col("y.at").alias("b"), (F.col("terms") * (_apart(px, py) - _apart(px, zy) - _apart(zx, py) + _apart(zx, zy))).alias("value"))
    sums = base.unionByName(one).unionByName(two).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("own"), F.col("b").alias("other")), F.struct(F.col("b").alias("own"), F.col("a").alias("other")))).alias("e"))
    name = lambda i: F.get("groups", F.col(i) - 1)["source"]
    return both.join(totals.select("lang", "groups"), "lang").select("lang", name("e.own").alias("source"), name("e.other").alias("item"), "value")


def _terms(vectors: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item, value of each kept term that a source has more often, by share, than its language."""
    group = lambda e: F.get("groups", e["at"] - 1)
    whole = F.aggregate("vector", F.lit(0).cast("long"), lambda n, e: n + e["count"])
    rows = vectors.join(totals, "lang").select("lang", F.col("term").alias("item"), "v", "groups", "vector", _share(whole, F.col("n"), F.col("v")).alias("q"))
    each = F.transform("vector", lambda e: F.struct(group(e)["source"].alias("source"), _share(e["count"], group(e)["n"], F.col("v")).alias("p")))
    rows = rows.select("lang", "item", "q", F.explode(F.filter(each, lambda e: e["p"] > F.col("q"))).alias("e"))
    return rows.select("lang", "e.source", "item", _apart(F.col("e.p"), F.col("q")).alias("value"))


def _ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    """Ranks of items by value, then name. Spark keeps the first `top` of a group within each task before it shuffles them."""
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = rows.withColumn("rank", rank)
    return (out.where(F.col("rank") <= top) if top is not None else out).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), c AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) GROUP BY ALL
), k AS (
  SELECT lang, term FROM (SELECT DISTINCT lang, doc, unnest(terms) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), f AS (
  SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), t AS (
  SELECT lang, source, sum(n) AS total FROM f GROUP BY ALL
), p AS (
  SELECT f.lang, f.source, f.term, f.n, CAST(1 + 1000000000 * (n + 2) // (total + 2 * v) AS HUGEINT) AS p FROM f JOIN t USING (lang, source) JOIN v ON v.lang = f.lang
), w AS (
  SELECT lang, sum(total) AS total FROM t GROUP BY lang
), l AS (
  SELECT lang, term, CAST(1 + 1000000000 * (n + 2) // (total + 2 * v) AS HUGEINT) AS q FROM (SELECT lang, term, sum(n) AS n FROM f GROUP BY ALL) JOIN w USING (lang) JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) AS s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE n > 0 AND p > q
), ranked AS (
  SELECT 'pair' AS part, *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT 'term', *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
