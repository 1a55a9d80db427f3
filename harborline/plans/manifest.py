"""Source manifests: sidecars `<file>.manifest.json` in the shape of an OpenLineage run event."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSIONS = ("1",)
SUFFIX = ".manifest.json"
#: Why a manifest is refused.
MISSING, NOT_JSON, BAD_VERSION, NO_FIELD, BAD_RANGE, BAD_SHAPE = "missing", "malformed_json", "unsupported_version", "missing_required_field", "invalid_source_range", "invalid_shape"


class ManifestError(ValueError):
    def __init__(self, category: str, detail: str):
        super().__init__(f"{category}: {detail}")
        self.category = category


@dataclass(frozen=True)
class Manifest:
    namespace: str
    name: str
    run_id: str | None
    version: str
    producer: str | None = None
    source_type: str | None = None
    source_range: str | None = None
    started_at: str | None = None
    finished_at: str | None = None
    record_count: int | None = None
    payload: str | None = None

    def fields(self) -> dict:
        """As columns of an audit record."""
        return {
            "source_type": self.source_type, "source_name": f"{self.namespace}/{self.name}", "producer": self.producer, "external_run_id": self.run_id, "source_range": self.source_range,
            "manifest_payload": self.payload, "manifest_version": self.version, "manifest_started_at": self.started_at, "manifest_finished_at": self.finished_at, "manifest_record_count": self.record_count,
        }


def parse(text: str) -> Manifest:
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise ManifestError(NOT_JSON, str(e)) from e
    if not isinstance(raw, dict):
        raise ManifestError(BAD_SHAPE, "a manifest is an object")
    own = (raw.get("run") or {}).get("facets", {}).get("harborline", {}) if isinstance(raw.get("run"), dict) else {}
    version = str(raw.get("manifest_version") or own.get("manifest_version") or "1")
    if version not in VERSIONS:
        raise ManifestError(BAD_VERSION, version)
    job = raw.get("job")
    if not isinstance(job, dict) or not job.get("namespace") or not job.get("name"):
        raise ManifestError(NO_FIELD, "job.namespace and job.name are required")
    count = own.get("record_count", raw.get("record_count"))
    if count is not None and (not isinstance(count, int) or isinstance(count, bool) or count < 0):
        raise ManifestError(BAD_SHAPE, f"record_count {count!r}")
    span = _range(raw, own)
    return Manifest(
        job["namespace"], job["name"], (raw.get("run") or {}).get("runId"), version, raw.get("producer"), own.get("source_type", raw.get("source_type")),
        span if span is None or isinstance(span, str) else json.dumps(span, sort_keys=True), own.get("started_at", raw.get("started_at")), own.get("finished_at", raw.get("eventTime")), count, text,
    )


def _range(raw: dict, own: dict) -> dict | str | None:
    """The source range of the run or of the first input that has one. Ranges of inputs are objects; the run's may be text."""
    spans = [own[k] if k in own else raw[k] for k in ("source_range",) if k in own or k in raw]
    if any(x is not None and not isinstance(x, (dict, str)) for x in spans):
        raise ManifestError(BAD_RANGE, f"source_range {spans[0]!r}")
    inputs = raw.get("inputs") or []
    if not isinstance(inputs, list) or not all(isinstance(i, dict) for i in inputs):
        raise ManifestError(BAD_SHAPE, "inputs is an array of objects")
    facets = [i.get("facets") if isinstance(i.get("facets"), dict) else {} for i in inputs]
    found = [f["_sourceRange"] for f in facets if "_sourceRange" in f]
    if bad := [x for x in found if not isinstance(x, dict)]:
        raise ManifestError(BAD_RANGE, f"_sourceRange {bad[0]!r}")
    return next((x for x in [*spans, *found] if x is not None), None)


def emit(namespace: str, name: str, run_id: str, producer: str, source_type: str, record_count: int, source_range: dict | str | None, started_at: str, finished_at: str) -> str:
    """The text of a manifest for a file that has just been made."""
    own = {"manifest_version": "1", "source_type": source_type, "record_count": record_count, "source_range": source_range, "started_at": started_at, "finished_at": finished_at}
    return json.dumps({"eventType": "COMPLETE", "eventTime": finished_at, "producer": producer, "job": {"namespace": namespace, "name": name}, "run": {"runId": run_id, "facets": {"harborline": own}}}, sort_keys=True)


_DDL = "namespace string, name string, run_id string, version string, producer string, source_type string, source_range string, started_at string, finished_at string, record_count long, payload string"


def read(spark: SparkSession, directory: str) -> DataFrame:
    """path (of the file it belongs to), category (null if it is taken) and detail of why it is not, and manifest (its fields), of all
    sidecars of a directory, in one job."""

    def work(parts):
        import pyarrow as pa

        kind = pa.struct([(f.name, pa.int64() if f.name == "record_count" else pa.string()) for f in Manifest.__dataclass_fields__.values()])
        for batch in parts:
            out = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    fields = asdict(parse(data.decode()))
                    out.append((path, None, None, {k: v if v is None or k == "record_count" else str(v) for k, v in fields.items()}))
                except ManifestError as e:
                    out.append((path, e.category, str(e), None))
                except UnicodeDecodeError as e:
                    out.append((path, NOT_JSON, f"{NOT_JSON}: {e}", None))
            path, category, detail, fields = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(category, pa.string()), pa.array(detail, pa.string()), pa.array(fields, kind)], names=["path", "category", "detail", "manifest"])

    sides = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").option("recursiveFileLookup", "true").load(directory)
    of = F.expr(f"left(path, length(path) - {len(SUFFIX)})")
    return sides.select(of.alias("path"), "content").mapInArrow(work, f"path string, category string, detail string, manifest struct<{_DDL.replace(' ', ': ').replace(',: ', ', ')}>")


def attached(files: DataFrame, directory: str) -> DataFrame:
    """files with category, detail and manifest of their sidecars; a file without one has the category 'missing'."""
    found = files.join(read(files.sparkSession, directory).withColumn("there", F.lit(True)), "path", "left")
    missing = F.col("there").isNull()
    return found.withColumns({"category": F.when(missing, MISSING).otherwise(F.col("category")), "detail": F.when(missing, F.concat(F.lit(f"{MISSING}: "), F.col("path"), F.lit(SUFFIX))).otherwise(F.col("detail"))}).drop("there")
