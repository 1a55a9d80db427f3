"""Registration: what is in a directory, by content, against what the audit store knows."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import Index, hashed, listing
from . import manifest as manifests
from .audit import Audit
from .config import Pipeline

log = logging.getLogger("harborline")


@dataclass(frozen=True)
class Candidate:
    path: str
    name: str
    size: int
    content_hash: str


@dataclass
class Registration:
    candidates: list[Candidate] = field(default_factory=list)
    new: int = 0
    skipped: int = 0  # failed for good
    refused: dict[str, str] = field(default_factory=dict)  # path to why its manifest was refused


def found(spark: SparkSession, directory: str, config: Pipeline, index: Index | None = None, epoch: str = "") -> DataFrame:
    """path, name, size, content_hash of the files that may have to be loaded, with category, detail and manifest of their sidecars
    if the policy asks for them. With an index, files that have not changed are not read, and loaded content is not among them."""
    files = listing(spark, directory, config.file_pattern)
    files = index.unloaded(index.hashes(files), epoch) if index else hashed(files)
    files = files.select("path", "name", "size", "content_hash")
    return files if config.source_manifest == "disabled" else manifests.attached(files, directory)


def register(spark: SparkSession, audit: Audit, directory: str, config: Pipeline, index: Index | None = None) -> Registration:
    """Files with the same content are one candidate each but one record. The manifest policy is checked on every run, not only on the
    first. Listing, hashes, what is loaded and manifests meet in one plan; what comes to the driver is a row for each file that may have
    to be claimed, which is then one transaction of the audit store."""
    out = Registration()
    epoch = audit.epoch()
    rows = found(spark, directory, config, index, epoch).orderBy("path").collect()
    known = audit.known(r["content_hash"] for r in rows)
    if index:
        index.loaded(sorted(h for h, state in known.items() if state == "COMMITTED"), epoch)
    for r in rows:
        h, state = r["content_hash"], known.get(r["content_hash"])
        if state not in (None, "PENDING"):
            if state == "FAILED" and (audit.get(h)["attempt_count"] or 0) >= config.retry_cap:
                out.skipped += 1
            continue
        m, refusal = None, None
        if config.source_manifest != "disabled":
            if r["category"] is None:
                m = manifests.Manifest(**r["manifest"].asDict())
            elif config.source_manifest == "required":
                refusal = r["detail"]
            elif r["category"] != manifests.MISSING:
                log.warning("manifest of %s ignored: %s", r["path"], r["detail"])
        if state is None and audit.insert_pending(r["name"], h, directory, **(m.fields() if m else {})):
            out.new += 1
        known[h] = "PENDING"
        if refusal is not None:
            out.refused[r["path"]] = refusal
            audit.failed(h, f"source manifest {refusal}")
            continue
        out.candidates.append(Candidate(r["path"], r["name"], r["size"], h))
    return out
