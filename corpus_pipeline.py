"""A training-data pipeline of five stages over `documents`: toxicity, near duplicates, repeated passages, benchmark
leaks, packing. Each stage works on all rows that the one before it kept, and takes effect on them:

* toxicity: documents that the network predicts to be toxic go;
* near_duplicates: of each group that the Jaccard join links, the document with the smallest id stays;
* repeated_passages: words of passages that start earlier are cut; a document of which nothing is left goes;
* benchmark_leaks: words inside benchmark windows are cut; a document of which no word is left goes;
* packing: pieces of sequences, as the packing operator returns them.

Documents with a null text or without words pass the first four stages unchanged. A null id is never a near duplicate;
such a document is scored, cut of passages and leaks as any other. Rows that repeat an id stay or go together as near
duplicates; everything else is judged by each row's own text, and rows that repeat id and text are one document. Extra
columns are kept up to the last stage, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm import decontam, jaccard_join, packing, substring_dedup, toxicity
from harborline.llm.common import stage, table


def _masked(docs: DataFrame) -> DataFrame:
    """docs with its other columns under names that no operator uses."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else f"extra_{i}_") for i, c in enumerate(docs.columns)))


def _restored(kept: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs again, with the text (and n_chars, where there is one) that a stage has left."""
    out = []
    for i, c in enumerate(docs.columns):
        own = F.col(c if c in ("doc_id", "text") else f"extra_{i}_")
        if c == "text":
            own = F.col(text)
        elif c == "n_chars" and text != "text":
            own = F.when(F.col("text").eqNullSafe(F.col(text)), own).otherwise(F.length(text).cast(docs.schema[c].dataType))
        out.append(own.alias(c))
    return kept.select(*out)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    rows = _masked(docs)
    return _restored(toxicity.score(rows, net, rows.columns).where("predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _masked(docs)
    others = jaccard_join.components(rows).where("component_id != doc_id").select("doc_id").distinct()
    return _restored(rows.join(others, "doc_id", "left_anti"), docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _masked(docs)
    kept = substring_dedup.dedup(rows, keep=rows.columns)
    return _restored(kept.where("n_removed = 0 or n_removed < n_words"), docs, "kept_text")


def cut_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _masked(docs)
    kept = decontam.contamination(rows, table(spark, sf_dir, "benchmark"), rows.columns, clean=True)
    return _restored(kept.where("n_hit = 0 or n_hit < n_words"), docs, "clean_text")


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("benchmark_leaks", cut_benchmark_leaks),
    ("packing", pack_tokens),
]

#: SQL can express neither the network nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
