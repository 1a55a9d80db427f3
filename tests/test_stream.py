"""Queues to files: the log in a folder, the sink of staged files, drains and continuous runs over both."""

import gzip
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from harborline.plans import manifest
from harborline.sources import sink
from harborline.sources.stores import Locked, store_lock
from harborline.streaming import log, materialize


def send(spark, folder, begin, end, topic="t", partitions=2, segment=4, bad=()):
    rows = [(topic, i % partitions, i // partitions, bytearray(b"[1]" if i in bad else json.dumps({"i": i, "s": "a\nb"}).encode())) for i in range(begin, end)]
    log.append_log(spark.createDataFrame(rows, log.SCHEMA), folder, segment)


def plan(tmp_path, **more):
    return materialize.parse_plan({"name": "q", "inbox": str(tmp_path / "in"), "staging": str(tmp_path / "st"), "checkpoint": str(tmp_path / "cp"), "log": str(tmp_path / "log")} | more)


def files(tmp_path):
    return {p.name: [json.loads(x)["i"] for x in p.read_text().splitlines()] for p in sorted((tmp_path / "in").glob("*.ndjson"))}


def test_drain_and_resume(spark, tmp_path):
    folder = str(tmp_path / "log")
    send(spark, folder, 0, 21)
    p = plan(tmp_path, batch_size=4)
    names = [x.rsplit("/", 1)[1] for x in materialize.drain(materialize.source(spark, p), p)]
    assert names == ["q-t-0-0-3.ndjson", "q-t-0-4-7.ndjson", "q-t-0-8-10.ndjson", "q-t-1-0-3.ndjson", "q-t-1-4-7.ndjson", "q-t-1-8-9.ndjson"]
    got = files(tmp_path)
    assert got["q-t-0-4-7.ndjson"] == [8, 10, 12, 14] and sorted(sum(got.values(), [])) == list(range(21))
    side = manifest.parse((tmp_path / "in" / ("q-t-0-8-10.ndjson" + manifest.SUFFIX)).read_text())
    assert side.record_count == 3 and json.loads(side.source_range) == {"topic": "t", "partition": 0, "start_offset": 8, "end_offset": 10}
    assert materialize.drain(materialize.source(spark, p), p) == []
    send(spark, folder, 21, 24)
    send(spark, folder, 0, 2, topic="other/ü")
    more = [x.rsplit("/", 1)[1] for x in materialize.drain(materialize.source(spark, p), p)]
    assert more == ["q-other-0-0-0.ndjson", "q-other-1-0-0.ndjson", "q-t-0-11-11.ndjson", "q-t-1-10-11.ndjson"]
    assert not [x for x in (tmp_path / "st").iterdir()]  # no job, no lock


def test_a_batch_again_gives_the_same_files(spark, tmp_path):
    send(spark, str(tmp_path / "log"), 0, 10)
    first, second = plan(tmp_path), plan(tmp_path, checkpoint=str(tmp_path / "cp2"))
    materialize.drain(materialize.source(spark, first), first)
    before = files(tmp_path)
    materialize.drain(materialize.source(spark, second), second)  # as after a crash before the checkpoint moved on
    assert files(tmp_path) == before and len(before) == 2


def test_bad_message_leaves_nothing(spark, tmp_path):
    send(spark, str(tmp_path / "log"), 0, 30, bad={17})
    p = plan(tmp_path, batch_size=2)
    with pytest.raises(Exception, match="not a JSON object"):
        materialize.drain(materialize.source(spark, p), p)
    assert not (tmp_path / "in").exists() and not list((tmp_path / "st").iterdir())


def test_continuous(spark, tmp_path):
    folder, p, stop, seen = str(tmp_path / "log"), plan(tmp_path, batch_timeout_seconds=0.2), threading.Event(), []
    send(spark, folder, 0, 6)
    worker = threading.Thread(target=materialize.follow, args=(materialize.source(spark, p), p, stop, lambda n, paths: seen.extend(paths)))
    worker.start()
    for end in (6, 10):
        deadline = time.time() + 60
        while time.time() < deadline and sorted(sum(files(tmp_path).values(), [])) != list(range(end)):
            time.sleep(0.2)
        assert sorted(sum(files(tmp_path).values(), [])) == list(range(end))
        if end == 6:
            send(spark, folder, 6, 10)
    stop.set()
    worker.join(60)
    assert not worker.is_alive() and len(seen) == 4


def test_gone_messages_fail_the_stream(spark, tmp_path):
    folder, p = tmp_path / "log", plan(tmp_path)
    send(spark, str(folder), 0, 8, partitions=1)
    materialize.drain(materialize.source(spark, p), p)
    send(spark, str(folder), 8, 16, partitions=1)
    for f in sorted((folder / "t" / "0").glob("*.parquet"))[:3]:
        f.unlink()
    with pytest.raises(Exception, match="gone"):
        materialize.drain(materialize.source(spark, p), p)


def test_half_a_segment_is_read_once(spark, tmp_path):
    reader = log._Reader(str(tmp_path / "log"))
    send(spark, reader.folder, 0, 8, partitions=1, segment=100)
    (part,) = reader.partitions({"t/0": 3}, {"t/0": 6})
    assert [x for b in reader.read(part) for x in b.column(2).to_pylist()] == [3, 4, 5]
    assert reader.partitions({"t/0": 8}, reader.latestOffset()) == [] and reader.initialOffset() == {}


def test_cuts_do_not_depend_on_stretches(spark):
    df = spark.createDataFrame([("t", i % 2, i * i, bytearray()) for i in range(60)], log.SCHEMA)
    one, many = (sorted(map(tuple, materialize.cut(df, 7, n).collect())) for n in (1 << 16, 50))
    assert one == many and max(r[-1] for r in one) == 4


def test_sink_stages_names_and_discards(spark, tmp_path):
    rows = spark.range(5000).select(F.format_string("k%02d", F.col("id") % 20).alias("key"), F.col("id").alias("mark"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("line")).repartition(6)
    job = sink.stage_files(rows, str(tmp_path / "st"), compress=True)
    assert [(f.key, f.lines, f.first, f.last) for f in job.files] == [(f"k{k:02d}", 250, k, 4980 + k) for k in range(20)]
    paths = job.publish(lambda f: (f"{tmp_path}/out/{f.key}.gz", '{"m": 1}' if f.key == "k00" else None))
    assert gzip.open(paths[3], "rt").read().splitlines() == [f"é{i}" for i in range(3, 5000, 20)]
    assert (tmp_path / "out" / ("k00.gz" + manifest.SUFFIX)).read_text() == '{"m": 1}' and not list((tmp_path / "st").iterdir())
    failing = rows.withColumn("line", F.when(F.col("mark") == 4321, F.raise_error(F.lit("no"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="no"):
        sink.stage_files(failing, str(tmp_path / "st"))
    assert not list((tmp_path / "st").iterdir())
    assert sink.stage_files(rows.limit(0), str(tmp_path / "st")).files == []


def test_locks(spark, tmp_path):
    with store_lock(spark, str(tmp_path), "s"), pytest.raises(Locked), store_lock(spark, str(tmp_path), "s"):
        pass
    assert not list(tmp_path.glob(".s.lock"))


def test_short_segments_share_a_task(spark, tmp_path, monkeypatch):
    """As many tasks as messages ask for, whatever the length of segments; none is left out."""
    monkeypatch.setattr(log, "TASK_MESSAGES", 40)
    reader = log._Reader(str(tmp_path / "log"))
    send(spark, reader.folder, 0, 400, segment=3)
    parts = reader.partitions({"t/0": 5}, reader.latestOffset())
    assert len(parts) == 10 and sum(len(p.names) for p in parts) == 66 + 67  # the first segment is behind the stream
    got = sorted((p.partition, x) for p in parts for b in reader.read(p) for x in b.column(2).to_pylist())
    assert got == [(0, i) for i in range(5, 200)] + [(1, i) for i in range(200)]
