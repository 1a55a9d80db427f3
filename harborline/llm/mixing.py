"""A mix of sources by target weights, as a schedule of equal blocks of words.

Every source has a target of words. The schedule is a sequence of slots of one block each; slot k goes to the source into whose part
of the unit interval the k-th point of a low-discrepancy sequence falls, parts being as wide as targets. So every stretch of the
schedule holds each source in proportion, to within a few slots, without counting what went before. The points are those of the
golden ratio in whole numbers, k F(n-1) mod F(n) with Fibonacci numbers: exact, and the same on every machine.

The slots of a source are numbered, and its documents, in an order shuffled by a hash, are laid end to end and cut into blocks of
BLOCK words (the last of a pass is shorter); slot r of a source takes block r modulo their number, so a source that is taken
more than once starts anew with its first block. A source's slots end when its target is reached, its last slot being cut to fit;
where the points have left it some slots short, these follow at the end. So each source gives its target exactly (rounded
to a word), and as no target is above REPEATS times a source's size, no document is taken more often than that.

Targets: `share` times all words, dealt by weight; what a source cannot take (REPEATS times its size) is dealt to the others by
weight, until none is above.

Nothing goes through one task but the table of sources (a row each) and counts of stretches of the schedule. A hot source is spread: slots are
numbered within stretches of STRETCH slots, documents are laid out within buckets of their hash, and both are shifted by the sums before
them. Slots find their source by an equal join on cells of the unit interval.

Null and empty texts have no words and are never taken; a null source is a source, after the others. Rows that repeat an id are laid
out one by one. Sources without words have target 0. Everything is a function of the rows alone, so reruns agree. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

BLOCK = 1024
SHARE = 1.5
REPEATS = 2
WEIGHTS = (5, 2, 1)
STRETCH = 1 << 16
#: Cells of the unit interval by which slots meet sources.
CELLS = 1024
#: Hexadecimal digits of the hash by which documents of a source are laid out apart.
DIGITS = 3
#: F(46) and F(45).
_WHOLE, _STEP = 1836311903, 1134903170


def _div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, order (a hash that shuffles)."""
    return documents.select("doc_id", "source", words(F.col("text")).alias("size"), F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("order"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, at (number by name, null last), source_size, weight, target, of a table with source and size.

    Sources are filled in order of repeats * size / weight: the first that takes its part of the rest without reaching its limit
    fixes the words a weight stands for, for it and all after it.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row a source: small beside the documents, and these windows are over all of them
    rows = rows.withColumn("at", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int")).cast("long"))
    limit = F.col("source_size") * repeats
    order = Window.orderBy((limit / F.col("weight")).asc(), "at")
    rows = rows.withColumns({"total": F.sum("source_size").over(Window.partitionBy()), "limit": limit})
    rows = rows.withColumns({"before": F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    rest = F.lit(share) * F.col("total") - F.col("before")
    rows = rows.withColumn("level", F.when(rest * F.col("weight") < F.col("limit") * F.col("left"), F.struct(F.col("limit") / F.col("weight"), "at", rest.alias("rest"), F.col("left").alias("left"))))
    rows = rows.withColumn("level", F.min("level").over(Window.partitionBy()))
    target = F.least(F.col("level.rest") * F.col("weight") / F.col("level.left"), F.col("limit").cast("double"))
    return rows.select("source", F.col("at").cast("long").alias("at"), "source_size", "weight", F.coalesce(target, F.col("limit").cast("double")).alias("target"))


def schedule(plan: DataFrame, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """slot, at (source), rank, block, start, length: the slots in order, each taking `length` words from `start` of the source's words.

    plan: rows of targets(). rank counts a source's slots from 0; start counts words from the beginning of the first pass.
    """
    spark = plan.sparkSession
    size = F.col("source_size")
    plan = plan.where("target >= 0.5").select("at", size, F.least(F.floor(F.col("target") + 0.5).cast("long"), size * repeats).alias("take"))
    plan = plan.withColumn("blocks", _div(size + (block - 1), block)).withColumn("rest", F.col("take") % size)
    plan = plan.withColumn("slots", _div(F.col("take"), size) * F.col("blocks") + _div(F.col("rest") + (block - 1), block))
    plan = stage(plan.select("at", "source_size", "take", "blocks", "slots", F.sum("slots").over(Window.orderBy("at")).alias("upto"), F.sum("slots").over(Window.partitionBy()).alias("total")), "mix-plan")
    total = (plan.agg(F.max("total")).first()[0]) or 0
    # part of the interval of each source, by its slots; and the cells that it meets
    edge = lambda upto: _div(upto.cast("decimal(20,0)") * F.lit(_WHOLE).cast("decimal(10,0)"), F.col("total").cast("decimal(20,0)"))
    width = -(-_WHOLE // CELLS)
    parts = plan.select("at", edge(F.col("upto") - F.col("slots")).alias("lo"), edge(F.col("upto")).alias("hi")).where("lo < hi")
    parts = parts.withColumn("cell", F.explode(F.sequence(_div(F.col("lo"), width), _div(F.col("hi") - 1, width))))
    slots = spark.range(total).select(F.col("id").alias("slot"), (F.col("id") % _WHOLE * _STEP % _WHOLE).alias("point"))
    slots = slots.withColumn("cell", _div(F.col("point"), width)).join(parts, "cell").where("point >= lo and point < hi")
    slots = stage(slots.select("slot", "at", _div(F.col("slot"), STRETCH).alias("stretch")), "mix-slots")
    before = Window.partitionBy("at").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = slots.groupBy("at", "stretch").agg(F.count("*").alias("n"))
    shifts = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranked = slots.withColumn("rank", F.row_number().over(Window.partitionBy("at", "stretch").orderBy("slot")) - 1).join(shifts, ["at", "stretch"])
    ranked = ranked.select("slot", "at", (F.col("rank") + F.col("shift")).alias("rank"))
    # slots that the points left a source short of: few, as the points are even
    given = counts.groupBy("at").agg(F.sum("n").alias("given"))
    short = plan.join(given, "at", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < slots")
    # at the end they take turns by rank: their numbers leave gaps, their order does not depend on anything else
    late = short.select("at", F.explode(F.sequence("given", F.col("slots") - 1)).alias("rank"))
    late = late.select((F.row_number().over(Window.orderBy("rank", "at")) - 1 + total).alias("slot"), "at", "rank")
    all_ = ranked.unionByName(late).join(plan, "at").where("rank < slots")
    place = F.col("rank") % F.col("blocks")
    start = _div(F.col("rank"), F.col("blocks")) * size + place * block
    whole = F.least(F.lit(block), size - place * block)
    return all_.select("slot", "at", "rank", place.alias("block"), start.alias("start"), F.least(whole, F.col("take") - start).cast("long").alias("length"))


def laid_out(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of sizes with at, source_size, target and offset: words of the source before the document, in shuffled order."""
    rows = sizes.join(plan.select(F.col("source").alias("its"), "at", "source_size", "target"), sizes["source"].eqNullSafe(F.col("its"))).drop("its")
    rows = rows.withColumn("bucket", F.substring("order", 1, DIGITS))
    sums = rows.groupBy("at", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("shift", F.coalesce(F.sum("n").over(Window.partitionBy("at").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    before = Window.partitionBy("at", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(before), F.lit(0))).join(sums, ["at", "bucket"])
    return rows.withColumn("offset", F.col("within") + F.col("shift")).drop("within", "shift", "bucket")


def mix(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each piece of a document that the mix takes, and one with a null slot for a document that it does not take:
    doc_id, size, source_size, target, offset (of the document in its source), slot, begin, taken: words from `begin` of the document.
    Slots in order, and pieces by begin within a slot, are the mix."""
    sizes = stage(sized(documents), "mix-sizes")
    plan = stage(targets(sizes), "mix-targets")
    slots = schedule(plan, block)
    docs = laid_out(sizes, plan)
    last = F.col("offset") + F.greatest(F.col("size"), F.lit(1)) - 1
    pieces = docs.withColumn("block", F.explode(F.sequence(_div(F.col("offset"), block), _div(last, block))))
    slots = slots.select(F.col("at").alias("its"), F.col("block").alias("b"), "slot", "length")
    pieces = pieces.join(slots, (pieces["at"] == slots["its"]) & (pieces["block"] == slots["b"]) & (pieces["size"] > 0), "left")
    start = F.greatest(F.col("offset"), F.col("block") * block)
    stop = F.least(F.col("offset") + F.col("size"), F.col("block") * block + F.col("length"))
    taken = F.when(F.col("slot").isNotNull(), F.greatest(stop - start, F.lit(0))).otherwise(0)
    return pieces.select("doc_id", "source", "size", "source_size", "target", "offset", "slot", (start - F.col("offset")).alias("begin"), taken.cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = mix(table(spark, sf_dir, "documents"))
    # a row of documents is known by its place in its source; rows without words share one, and are counted
    key = ["source", "offset", "doc_id", "size", "source_size", "target"]
    some = pieces.where("size > 0").groupBy(*key).agg(F.sum("taken").alias("taken"))
    return some.select("doc_id", "size", "source_size", "target", "taken").unionByName(pieces.where("size = 0").select("doc_id", "size", "source_size", "target", "taken"))


#: What the schedule comes to: of a source's words, laid end to end twice, those before its target.
SQL = r"""
WITH s AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents
), g AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][k % 3 + 1] AS weight, 2 * source_size AS cap, sum(source_size) OVER () AS total FROM g
), r AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w
), l AS (
  SELECT CAST(1.5 AS DOUBLE) * total - before AS words, rest FROM r WHERE (CAST(1.5 AS DOUBLE) * total - before) * weight < cap * rest ORDER BY cap / weight, k LIMIT 1
), t AS (
  SELECT source, source_size, coalesce(least((SELECT words FROM l) * weight / (SELECT rest FROM l), CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM r
), d AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, least(CAST(floor(t.target + 0.5) AS BIGINT), 2 * t.source_size) AS take,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY o, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, take - before)) + greatest(0, least(size, take - source_size - before)) AS BIGINT) AS taken FROM d
"""
