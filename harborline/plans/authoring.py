"""Making configurations without a user interface: a draft from a sample file, edits, a report of how file and configuration
agree, and a pipeline folder that the registry lists. Nothing here opens a destination, an audit store or a key."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import infer, validate
from ..operators.destinations import KINDS
from ..sources.readers import ERROR, ROW, Scan, scan, window
from . import registry
from .config import TYPES, WRITE_MODES, ConfigError, Pipeline, parse
from .run import open_scan

#: What a report looks at, in this order; the first three do not need the file.
AREAS = ("config", "encryption", "write_mode", "parser", "tolerance", "strict")
OPERATION_VALUES = {"insert": ["insert"], "update": ["update"], "delete": ["delete"]}


@dataclass(frozen=True)
class Draft:
    """A configuration in the making: its mapping, what inference saw of each source, and what has been acknowledged.
    Each edit returns a new draft, so that one that is refused changes nothing."""

    raw: dict[str, Any]
    evidence: dict[str, infer.Inferred] = field(default_factory=dict)
    acknowledged: frozenset[str] = frozenset()

    def column(self, dest: str) -> dict[str, Any]:
        for c in self.raw["columns"]:
            if c["dest"] == dest:
                return c
        raise ConfigError(f"the draft has no column {dest!r}")

    def _free(self, dest: str) -> None:
        if any(c["dest"] == dest for c in self.raw["columns"]):
            raise ConfigError(f"the draft has a column {dest!r} already")

    def edit(self, dest: str, /, **changes: Any) -> Draft:
        """Fields of one column anew; None takes a field out."""
        if changes.get("type", "string") not in TYPES:
            raise ConfigError(f"Unknown column type {changes['type']!r}; choose one of {', '.join(TYPES)}")
        if changes.get("dest", dest) != dest:
            self._free(changes["dest"])
        raw = copy.deepcopy(self.raw)
        at = [c["dest"] for c in raw["columns"]].index(self.column(dest)["dest"])
        raw["columns"][at] = {k: v for k, v in (raw["columns"][at] | changes).items() if v is not None}
        return replace(self, raw=raw)

    def repeat(self, dest: str, to: str) -> Draft:
        """The source of dest a second time, as column `to`, without keys: one encrypted and one hashed, for instance."""
        self._free(to)
        again = {k: v for k, v in self.column(dest).items() if k not in ("encrypt", "hash")} | {"dest": to}
        return self.set(columns=[*self.raw["columns"], again])

    def drop(self, dest: str) -> Draft:
        gone = self.column(dest)
        return self.set(columns=[c for c in self.raw["columns"] if c is not gone])

    def set(self, **blocks: Any) -> Draft:
        """Top-level blocks anew; None takes a block out."""
        return replace(self, raw=copy.deepcopy({k: v for k, v in (self.raw | blocks).items() if v is not None}))

    def write(self, mode: str, keys: list[str] | None = None, sequence_by: str = "", operation_column: str = "operation", operations: dict[str, list[str]] | None = None) -> Draft:
        """The write mode; changes need keys and a column that orders them."""
        if mode not in WRITE_MODES:
            raise ConfigError(f"Unknown write_mode {mode!r}; choose one of {', '.join(WRITE_MODES)}")
        block = {"keys": list(keys or []), "sequence_by": sequence_by, "operation_column": operation_column, "operations": operations or OPERATION_VALUES}
        return self.set(write_mode=mode, cdc=block if mode == "cdc" else None)

    def connect(self, kind: str, /, **settings: str) -> Draft:
        if kind not in KINDS:
            raise ConfigError(f"Unknown connector {kind!r}; choose one of {', '.join(KINDS)}")
        return self.set(connector={"type": kind} | {k: v for k, v in settings.items() if v != ""})

    def unsure(self) -> list[infer.Inferred]:
        """Columns whose type inference did not settle and nobody has acknowledged."""
        sources = {c["source"] for c in self.raw["columns"]}
        return [e for s, e in self.evidence.items() if s in sources and e.confidence != "high" and s not in self.acknowledged]

    def acknowledge(self, *sources: str) -> Draft:
        if unknown := sorted(set(sources) - set(self.evidence)):
            raise ConfigError(f"nothing was inferred of {', '.join(unknown)}")
        return replace(self, acknowledged=self.acknowledged | set(sources))

    def config(self) -> Pipeline:
        return parse(self.raw)

    def yaml(self) -> str:
        import yaml

        return yaml.safe_dump(self.raw, sort_keys=False, allow_unicode=True)


def from_sample(spark: SparkSession, path: str, table: str, kind: str, encoding: str = "utf-8", sheet: str | int | None = None, rows: int = infer.SAMPLE) -> Draft:
    """A draft with a column of the inferred type for each source. All are required until someone relaxes them."""
    if kind == "fixed_width":
        raise ConfigError("a fixed-width file does not say where its columns are: give them to from_layout")
    found = infer.infer_parquet(spark.read.parquet(path).schema) if kind == "parquet" else infer.infer(scan(spark, path, kind, encoding, sheet=sheet), rows)
    raw: dict[str, Any] = {"format": kind, "dest_table": table, "write_mode": "append"}
    if encoding != "utf-8":
        raw["encoding"] = encoding
    if kind == "excel":
        raw["excel"] = {"sheet": 0 if sheet is None else sheet}
    raw["columns"] = [{"source": c.name, "dest": c.name, "type": c.type, "required": True} for c in found]
    return Draft(raw, {c.name: c for c in found})


def from_layout(table: str, columns: list[dict[str, Any]]) -> Draft:
    """A draft of a fixed-width file from source, type, start and width of its columns, checked as a layout."""
    draft = Draft({"format": "fixed_width", "dest_table": table, "write_mode": "append", "columns": [{"dest": c["source"], "required": True} | c for c in columns]})
    draft.config()
    return draft


def reopen(path: str | Path) -> Draft:
    """The draft of a configuration that was saved before."""
    import yaml

    draft = Draft(yaml.safe_load(Path(path).read_text()) or {})
    draft.config()
    return draft


@dataclass(frozen=True)
class Finding:
    area: str
    ok: bool
    message: str
    row: int | None = None
    column: str | None = None


@dataclass(frozen=True)
class Report:
    findings: list[Finding]
    drift: list[dict[str, Any]] = field(default_factory=list)
    rows: int = 0
    failing_cells: int = 0

    @property
    def ok(self) -> bool:
        return all(f.ok for f in self.findings)

    def of(self, area: str) -> list[Finding]:
        return [f for f in self.findings if f.area == area]


def _structure(config: Pipeline) -> list[Finding]:
    out = [Finding("config", True, "the configuration is whole")]
    kept = [f"{c.dest}: {k}" for c in config.columns for k in ("encrypt", "hash") if getattr(c, k)]
    out.append(Finding("encryption", True, "keys are named for " + ", ".join(kept) if kept else "no column has a key"))
    dests = [c.dest for c in config.columns]
    if twice := sorted({d for d in dests if dests.count(d) > 1}):
        out.append(Finding("write_mode", False, f"more than one column goes to {', '.join(twice)}"))
    else:
        out.append(Finding("write_mode", True, f"write_mode {config.write_mode} has what it needs"))
    return out


def examine(spark: SparkSession, path: str, config: Pipeline | dict[str, Any], rows: int | None = None, shown: int = 100) -> Report:
    """How a file and a configuration agree, in all areas; the rows from the first are looked at, all if rows is None.

    Counts are of every row; findings name the first `shown` failing cells and say how many there are. A configuration that does
    not parse, or a file that cannot be read, ends the report there."""
    if not isinstance(config, Pipeline):
        try:
            config = parse(config)
        except (ConfigError, TypeError, AttributeError, KeyError) as e:
            return Report([Finding("config", False, str(e))])
    out = _structure(config)
    try:
        whole = open_scan(spark, path, config)
        part = window(whole, 1, rows)
        broken = part.df.where(F.col(ERROR).isNotNull()).orderBy(ROW).select(ROW, ERROR).first()
    except Exception as e:  # whatever keeps a reader from the file is the finding
        return Report([*out, Finding("parser", False, str(e).split("\n\nJVM stacktrace")[0])])
    if broken:
        return Report([*out, Finding("parser", False, str(broken[1]), broken[0])])
    out.append(Finding("parser", True, f"the file reads as {config.format}"))
    return _examine_rows(part, config, out, shown)


def _examine_rows(part: Scan, config: Pipeline, out: list[Finding], shown: int) -> Report:
    fit = validate.tolerance(part.names, config.columns)
    lost = [*fit.missing, *([config.cdc.operation_column] if config.cdc and config.cdc.operation_column not in part.names else [])]
    out += [Finding("tolerance", False, f"the file has no column {c!r}", column=c) for c in lost]
    if not lost:
        out.append(Finding("tolerance", True, f"undeclared columns are left out: {', '.join(fit.extra)}" if fit.extra else "every column is declared"))
    total, bad = part.df.count(), validate.failures(part, config.columns)
    cells = bad.count()
    out += [Finding("strict", False, r["error"], r["row_number"], r["column"]) for r in bad.orderBy("row_number", "column").limit(shown).collect()]
    if cells > shown:
        out.append(Finding("strict", False, f"{cells - shown} more cells fail"))
    if not cells:
        out.append(Finding("strict", True, f"all of {total} rows load"))
    return Report(out, [r.asDict() for r in validate.drift(part, config.columns).orderBy("column").collect()], total, cells)


def notes(draft: Draft, name: str, sample: str, at: datetime) -> str:
    """What someone who runs the pipeline needs to know, as Markdown."""
    c = draft.config()
    keys = sorted({getattr(x, k).key for x in c.columns for k in ("encrypt", "hash") if getattr(x, k)})
    lines = [f"# {name}", "", f"Authored: {at.isoformat(timespec='seconds')}", f"Sample: {sample}", f"Loads {c.format} into {c.dest_table} ({c.write_mode}).", ""]
    lines += ["Keys to provide:", *(f"* {k}" for k in keys), ""] if keys else []
    sure = [draft.evidence[s] for s in sorted(draft.acknowledged)]
    lines += ["Types acknowledged:", *(f"* {e.name}: {e.type}, {e.confidence}, {e.null_count} of {e.rows} null" for e in sure), ""] if sure else []
    return "\n".join([*lines, "Run: `python -m harborline run --registry registry.yaml --pipeline " + name + "`", ""])


def save(workspace: str | Path, draft: Draft, sample: str, audit_db: str | None = None, name: str | None = None, overwrite: bool = False, at: datetime | None = None) -> Path:
    """Write the draft as a pipeline folder with notes and list it in registry.yaml. Types that are unsure have to be acknowledged
    first. With overwrite, an existing folder gets its configuration and notes anew and the registry stays as it is."""
    if open_ := draft.unsure():
        raise ConfigError(f"acknowledge the types of {', '.join(e.name for e in open_)} first")
    text = draft.yaml()
    draft.config()
    slug = registry.slug(name or draft.raw["dest_table"])
    workspace = Path(workspace)
    folder = workspace / "pipelines" / slug
    if overwrite and folder.exists():
        (folder / "pipeline.yaml").write_text(text)
    elif folder.exists():
        raise registry.RegistryError(f"there is a folder {folder} already")
    else:
        place = audit_db or "${" + slug.replace("-", "_").upper() + "_AUDIT_DB}"
        registry.add(workspace / registry.FILE, {"id": slug, "dir": f"pipelines/{slug}/incoming", "config": f"pipelines/{slug}/pipeline.yaml", "audit_db": place})
        registry.create(workspace / "pipelines", slug, text)
    (folder / "NOTES.md").write_text(notes(draft, slug, sample, at or datetime.now(UTC)))
    return folder
