"""Read models over audit records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.audit import STATES

LISTED = ["filename", "content_hash", "state", "attempt_count", "row_count", "error_message", "source_type", "source_name", "producer", "external_run_id", "source_range", "manifest_record_count", "quarantined_row_count", "quarantine_path", "run_id", "created_at", "updated_at"]


def by_state(records: DataFrame) -> DataFrame:
    """state, files: all four states, also those without a file."""
    states = records.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return states.join(records.groupBy("state").agg(F.count("*").alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).cast("long").alias("files"))


def recent_failures(records: DataFrame, top: int = 10) -> DataFrame:
    return records.where("state = 'FAILED'").orderBy(F.desc("updated_at"), "content_hash").limit(top).select("filename", "content_hash", "attempt_count", "error_message", "updated_at")


def quarantined(records: DataFrame) -> DataFrame:
    return records.agg(F.coalesce(F.sum("quarantined_row_count"), F.lit(0)).alias("quarantined_rows"))


def overview(records: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("state") == s).alias(s.lower()) for s in STATES]
    return records.agg(F.count("*").alias("total"), *counts, F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"), F.coalesce(F.sum("quarantined_row_count"), F.lit(0)).alias("quarantined_rows"))


def listing(records: DataFrame) -> DataFrame:
    return records.select(*LISTED).orderBy(F.desc("updated_at"), "content_hash")
