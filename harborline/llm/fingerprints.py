"""Document fingerprints, with DataFrame operations only: a homomorphic multiset hash over paragraphs.

A fingerprint is a sum of vectors, one for each paragraph (line) of a text, so the order of paragraphs does not matter
and a paragraph is inserted or deleted by adding or subtracting its vector. The vector of a paragraph has

* four 62-bit hashes of the paragraph, each from a seed of its own that comes before the text, so that paragraphs that
  meet in one do not meet in the others, summed modulo 2^62: equality,
* the counts of paragraphs and of pieces (up to four words of a line in a row, from its start),
* 60 counters of 31 bits, two to a number summed modulo 2^62: for each piece, 60 bits of its hash.

The counters tell likeness. With a bit as +1 or -1, the squared distance of two fingerprints is, on average, the
number of pieces that only one text has, so likeness is 1 - distance / (both norms), within 0 and 1; equal fingerprints
have likeness 1. A counter has room for 2^31 - 1 pieces, more than a text can have: it has fewer than 2^31 bytes.

Defined cases: null and empty texts are one empty paragraph with no piece; two texts without pieces have likeness 1 if
their fingerprints are equal, else 0; of equal ids the order is by text; one document alone is its own next; a null id
comes last; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table

SEEDS = (1, 2, 3, 4)
EQUAL_MASK = (1 << 62) - 1
LANES, LANE_BITS = 30, 31
LANE_MASK = (1 << 62) - 1
PICK = sum(1 << (LANE_BITS * i) for i in range(2))
PIECE = r"[^\s]+(?:[ \t]+[^\s]+){0,3}"

def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def equality(text: Column) -> Column:
    """Sums over the paragraphs of a text that is not null: e1 .. e4 and their number."""
    return F.aggregate(
        F.split(text, "\n"),
        F.struct(*(_long(0).alias(f"e{s}") for s in SEEDS), _long(0).alias("paragraphs")),
        lambda a, p: F.struct(
            *((a[f"e{s}"] + F.xxhash64(F.lit(s), p).bitwiseAND(_long(EQUAL_MASK))).bitwiseAND(_long(EQUAL_MASK)).alias(f"e{s}") for s in SEEDS),
            (a["paragraphs"] + 1).alias("paragraphs"),
        ),
    )


def counters(text: Column) -> Column:
    """Sums over the pieces of the paragraphs of a text that is not null: their number and c0 .. c29."""
    return F.aggregate(
        F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)),
        F.struct(_long(0).alias("pieces"), *(_long(0).alias(f"c{i}") for i in range(LANES))),
        lambda a, h: F.struct(
            (a["pieces"] + 1).alias("pieces"),
            *((a[f"c{i}"] + F.shiftrightunsigned(h, i).bitwiseAND(_long(PICK))).bitwiseAND(_long(LANE_MASK)).alias(f"c{i}") for i in range(LANES)),
        ),
    )


def _fields() -> list[tuple[str, str, int]]:
    return [*(("equal", f"e{s}", EQUAL_MASK) for s in SEEDS), ("equal", "paragraphs", 0), ("counts", "pieces", 0), *(("counts", f"c{i}", LANE_MASK) for i in range(LANES))]


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """a + b, or a - b with sign -1, of structs (equal, counts): paragraphs inserted or deleted. Keep "\\n" between them out of b."""
    parts: dict[str, list[Column]] = {"equal": [], "counts": []}
    for part, name, mask in _fields():
        x, y = a[part][name], b[part][name]
        if not mask:
            parts[part].append((x + y if sign > 0 else x - y).alias(name))
        else:
            parts[part].append((x + (y if sign > 0 else _long(mask) - y + 1)).bitwiseAND(_long(mask)).alias(name))
    return F.struct(F.struct(*parts["equal"]).alias("equal"), F.struct(*parts["counts"]).alias("counts"))


def as_text(equal: Column, counts: Column) -> Column:
    """Hexadecimal, with the counts in front."""
    parts = [equal["paragraphs"], counts["pieces"], *(equal[f"e{s}"] for s in SEEDS), *(counts[f"c{i}"] for i in range(LANES))]
    return F.lower(F.concat_ws("-", *(F.hex(x) for x in parts)))


def signs(counts: Column) -> Column:
    """The 60 sums of +1 and -1, as an array of doubles."""
    n = counts["pieces"]
    return F.flatten(F.transform(F.array(*(counts[f"c{i}"] for i in range(LANES))), lambda c: F.array(
        *((2 * F.shiftrightunsigned(c, lane * LANE_BITS).bitwiseAND(_long((1 << LANE_BITS) - 1)) - n).cast("double") for lane in range(2))
    )))


def likeness(equal_a: Column, signs_a: Column, equal_b: Column, signs_b: Column) -> Column:
    """0 to 1, from the fingerprints alone."""
    zero = F.lit(0.0)
    apart = F.aggregate(F.zip_with(signs_a, signs_b, lambda x, y: (x - y) * (x - y)), zero, lambda t, x: t + x)
    norms = F.aggregate(F.zip_with(signs_a, signs_b, lambda x, y: x * x + y * y), zero, lambda t, x: t + x)
    near = F.when(norms > 0, F.greatest(zero, F.least(F.lit(1.0), 1 - apart / norms))).otherwise(zero)
    return F.when(equal_a == equal_b, F.lit(1.0)).otherwise(near)


def _bucket(key: Column, cuts: list[int], step: int = 64) -> Column:
    """How many of the sorted cuts are at most key: first among every 64th, then among the 64 that follow."""
    below = lambda a: F.size(F.filter(a, lambda c: c <= key))
    if len(cuts) <= step:
        return below(F.array(*(_long(c) for c in cuts))) if cuts else F.lit(0)
    coarse = below(F.array(*(_long(c) for c in cuts[step - 1 :: step])))
    return coarse * step + below(F.slice(F.array(*(_long(c) for c in cuts)), coarse * step + 1, F.lit(step)))


def with_next(rows: DataFrame, buckets: int | None = None, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Columns (doc_id, text, ...) and `next`, a struct of all columns of the next row by descending doc_id (after the last: the first).
    more: adds columns to the rows once they are dealt, so that what it computes is computed once for each row.

    Rows are dealt to ranges of doc_id, as many as `buckets`. Each range is ordered on its own and has the first row of
    the range after it, if any, as its last; the driver sees one id of each range. No task sees more than its range.
    """
    spark = rows.sparkSession
    names = rows.columns
    key = F.coalesce("doc_id", _long(-(1 << 63)))
    n = buckets or 4 * shuffle_partitions(spark)
    cuts = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    rows = rows.withColumn("k_", key).withColumn("bucket_", _bucket(key, sorted(set(cuts or []))))
    firsts = sorted(tuple(r) for r in rows.groupBy("bucket_").agg(F.max("k_")).collect())
    after = [(b, firsts[i - 1][0], firsts[i - 1][1]) for i, (b, _) in enumerate(firsts)]
    heads = spark.createDataFrame(after, "to_ int, bucket_ int, k_ long")
    # at most one id of each range, so broadcast; of rows with equal ids the largest text comes first
    heads = rows.join(F.broadcast(heads), ["bucket_", "k_"]).withColumn("r_", F.row_number().over(Window.partitionBy("to_").orderBy(F.desc("text")))).where("r_ = 1")
    ends = heads.select(*names, "k_", F.col("to_").alias("bucket_"), F.lit(1).alias("end_"))
    both = rows.select(*names, "k_", "bucket_", F.lit(0).alias("end_")).unionByName(ends)
    if more:
        both = more(both)
        names = [c for c in both.columns if c not in ("k_", "bucket_", "end_")]
    order = Window.partitionBy("bucket_").orderBy("end_", F.desc("k_"), F.desc("text"))
    return both.withColumn("next", F.lead(F.struct(*names)).over(order)).where("end_ = 0").select(*names, "next")


def edited(text: Column, after: Column) -> Column:
    """The last half of the text replaced by as many code points from the start of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(after, F.lit(1), half))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = lambda df: df.withColumns({"equal": equality(F.col("text")), "counts": counters(F.col("text"))})
    both = with_next(rows, more=own).withColumn("edited", edited(F.col("text"), F.col("next.text")))
    both = both.withColumns({"edited_equal": equality(F.col("edited")), "edited_counts": counters(F.col("edited"))})
    both = both.withColumns({"own_signs": signs(F.col("counts")), "edited_signs": signs(F.col("edited_counts")), "next_signs": signs(F.col("next.counts"))})
    return both.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("equal"), F.col("counts")).alias("fingerprint"),
        as_text(F.col("edited_equal"), F.col("edited_counts")).alias("edited_fingerprint"),
        likeness(F.col("equal"), F.col("own_signs"), F.col("edited_equal"), F.col("edited_signs")).alias("near_edited"),
        likeness(F.col("equal"), F.col("own_signs"), F.col("next.equal"), F.col("next_signs")).alias("near_next"),
    )
