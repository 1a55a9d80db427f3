"""Queues to complete files, by Structured Streaming.

A stream of (topic, partition, offset, value), of Kafka or of a log in a folder, is cut into micro-batches of at most batch_size
messages of a partition; each becomes one NDJSON file with a manifest that names its offsets. Executors write the files, one task each; the
driver gives them their names. Spark's checkpoint moves on after a batch's files are promoted, so a crash repeats a batch at most,
under the same names: offsets name the file, and replacing it with itself changes nothing.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.json import is_object
from ..plans import manifest as manifests
from ..plans.config import ConfigError
from ..sources.promote import slug
from ..sources.sink import Staged, stage_files
from ..sources.stores import store_lock
from .log import read_log

SCHEMA = "topic string, partition int, offset long, value binary"


@dataclass(frozen=True)
class Plan:
    name: str
    inbox: str
    staging: str
    checkpoint: str
    topic: str = ""
    brokers: str = ""
    log: str = ""  # folder of a log, in place of a topic of Kafka
    batch_size: int = 1000
    batch_timeout_seconds: float = 30.0
    max_per_trigger: int | None = None  # messages that one batch of the stream takes at most
    compress: bool = False


def parse_plan(raw: dict) -> Plan:
    missing = [k for k in ("name", "inbox", "staging", "checkpoint") if not raw.get(k)]
    if missing:
        raise ConfigError(f"a materialize plan requires {', '.join(missing)}")
    plan = Plan(**{k: raw[k] for k in Plan.__dataclass_fields__ if k in raw})
    if plan.batch_size < 1 or plan.batch_timeout_seconds <= 0:
        raise ConfigError("batch_size and batch_timeout_seconds are positive")
    return plan


def kafka(spark: SparkSession, plan: Plan) -> DataFrame:
    """The topic as a stream, from its start. Needs Spark's Kafka package on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", plan.brokers).option("subscribe", plan.topic).option("startingOffsets", "earliest").option("failOnDataLoss", "true")
    if plan.max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", plan.max_per_trigger)
    return reader.load().select("topic", "partition", "offset", "value")


def source(spark: SparkSession, plan: Plan) -> DataFrame:
    """The stream that a plan names."""
    return read_log(spark, plan.log) if plan.log else kafka(spark, plan)


def cut(messages: DataFrame, batch_size: int, stretch: int = 1 << 16) -> DataFrame:
    """Adds cut, from 0: the micro-batch of a message within its partition, by offset.

    Messages are numbered within stretches of offsets and shifted by the counts before, so a hot partition is many tasks' work."""
    near = messages.withColumn("_stretch", F.floor(F.col("offset") / stretch))
    counts = near.groupBy("topic", "partition", "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("topic", "partition").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    order = Window.partitionBy("topic", "partition", "_stretch").orderBy("offset")
    numbered = near.withColumn("_at", F.row_number().over(order) - 1).join(shifts, ["topic", "partition", "_stretch"])
    return numbered.select(*(F.col(f"`{c}`") for c in messages.columns), F.floor((F.col("_at") + F.col("_shift")) / batch_size).cast("long").alias("cut"))


def decoded(messages: DataFrame) -> DataFrame:
    """Adds line, the JSON text of the object in value. A message that is not one fails its micro-batch, and so the query."""
    text = F.decode("value", "UTF-8")
    v = F.try_parse_json(text)
    where = F.concat_ws(" ", F.lit("not a JSON object:"), "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return messages.withColumn("line", F.when(is_object(v), F.to_json(v)).otherwise(F.raise_error(where)))


def materialize_batch(batch: DataFrame, plan: Plan, clock=lambda: datetime.now(UTC)) -> list[str]:
    """Files of one trigger, in order of topic, partition and offset. No message passes the driver."""
    batch = batch.persist()  # it is counted and then written
    try:
        key = F.to_json(F.struct("topic", "partition", "cut"))
        rows = decoded(cut(batch, plan.batch_size)).select(key.alias("key"), F.col("offset").alias("mark"), "line")
        with store_lock(batch.sparkSession, plan.staging, slug(plan.name)):
            job = stage_files(rows, plan.staging, plan.compress)
            places = {f.key: json.loads(f.key) for f in job.files}
            job.files.sort(key=lambda f: (places[f.key]["topic"], places[f.key]["partition"], f.first))

            def target(f: Staged) -> tuple[str, str]:
                topic, partition = places[f.key]["topic"], places[f.key]["partition"]
                span = {"topic": topic, "partition": partition, "start_offset": f.first, "end_offset": f.last}
                name = "-".join(slug(x) for x in (plan.name, topic, partition, f.first, f.last)) + ".ndjson" + (".gz" if plan.compress else "")
                now, run = clock().isoformat(), str(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(span, sort_keys=True)))
                return f"{plan.inbox.rstrip('/')}/{name}", manifests.emit("harborline.materialize", plan.name, run, "harborline", "log" if plan.log else "kafka", f.lines, span, now, now)

            return job.publish(target)
    finally:
        batch.unpersist()


def start(stream: DataFrame, plan: Plan, drain: bool = True, progress: Callable[[int, list[str]], None] | None = None) -> StreamingQuery:
    """drain: take what is there now and end. Otherwise go on, with a batch every batch_timeout_seconds."""
    def each(batch: DataFrame, number: int) -> None:
        paths = materialize_batch(batch, plan)
        if progress:
            progress(number, paths)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", plan.checkpoint)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=f"{plan.batch_timeout_seconds} seconds")
    return writer.start()


def drain(stream: DataFrame, plan: Plan) -> list[str]:
    """All files of what the stream holds now."""
    paths: list[str] = []
    start(stream, plan, True, lambda _, p: paths.extend(p)).awaitTermination()
    return paths


def follow(stream: DataFrame, plan: Plan, stop: threading.Event, progress: Callable[[int, list[str]], None] | None = None) -> None:
    """Materialise until stop is set, then finish what has come in by then."""
    query = start(stream, plan, False, progress)
    try:
        while not stop.wait(0.2):
            if not query.isActive:
                query.awaitTermination()  # raises what ended it
                return
        query.processAllAvailable()
    finally:
        query.stop()
