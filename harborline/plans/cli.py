"""Command line: python -m harborline COMMAND. Exit codes: 0 done, 1 something failed, 2 the question is ambiguous."""

from __future__ import annotations

import argparse
import contextlib
import json
import signal
import sys
import threading
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession

from ..operators import infer, quarantine, validate
from ..operators.compact import compact
from ..operators.destinations import destination
from ..operators.schema import HASH
from ..operators.store import Table
from ..sources import fetch, readers
from ..sources.files import format_of
from . import config as configs
from . import authoring, export, log, registry, trace
from .audit import Audit
from ..streaming import materialize
from .run import health, open_scan, run


def session() -> SparkSession:
    return SparkSession.builder.appName("harborline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _scan(spark: SparkSession, args) -> readers.Scan:
    if args.config:
        c = configs.load(args.config)
        return open_scan(spark, args.file, c)
    return readers.scan(spark, args.file, format_of(args.file, args.format), args.encoding, sheet=int(args.sheet) if args.sheet and args.sheet.isdigit() else args.sheet)


def preview_table(names: list[str], rows: list[list[str | None]], width: int = 30) -> str:
    short = lambda v: "" if v is None else v if len(v) <= width else v[: width - 1] + "…"
    cells = [[short(n) for n in names], *([short(v) for v in r] for r in rows)]
    wide = [max(len(r[i]) for r in cells) for i in range(len(names))]
    return "\n".join(" | ".join(v.ljust(w) for v, w in zip(r, wide)).rstrip() for r in cells)


def preview(scan: readers.Scan, start_row: int, rows: int) -> list[list[str | None]]:
    part = readers.window(scan, start_row, rows)
    return [list(r) for r in part.df.orderBy(readers.ROW).select(*(v.text.alias(f"c{i}") for i, v in enumerate(part.values.values()))).collect()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="harborline")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple) -> None:
        s = sub.add_parser(name)
        for flags, options in arguments:
            s.add_argument(*flags, **options)

    store = (("--audit-db",), {})
    listed = [(("--registry",), {}), (("--pipeline",), {})]  # names the store instead
    sample = [(("--file",), {"required": True}), (("--format",), {}), (("--encoding",), {"default": "utf-8"}), (("--sheet",), {}), (("--config",), {})]
    command("run", (("--dir",), {}), (("--config",), {}), (("--audit-db",), {}), (("--warehouse",), {}), (("--registry",), {}), (("--pipeline",), {}), (("--log-format",), {"choices": log.FORMATS}), (("--trace",), {}))
    command("inspect", *sample, (("--rows",), {"type": int, "default": infer.SAMPLE}))
    command("preview", *sample, (("--rows",), {"type": int, "default": 10}), (("--start-row",), {"type": int, "default": 1}))
    command("validate", *[(f, o | ({"required": True} if f == ("--config",) else {})) for f, o in sample], (("--json",), {"action": "store_true"}), (("--shown",), {"type": int, "default": 100}))
    command("report", *[(f, o | ({"required": True} if f == ("--config",) else {})) for f, o in sample if f in (("--file",), ("--config",))], (("--rows",), {"type": int}), (("--shown",), {"type": int, "default": 100}))
    command("draft", *[a for a in sample if a[0] != ("--config",)], (("--table",), {"required": True}), (("--rows",), {"type": int, "default": infer.SAMPLE}), (("--workspace",), {}), (("--acknowledge",), {"action": "append", "default": []}))
    command("browse", (("--workspace",), {"required": True}))
    command("status", (("--audit-db",), {"action": "append"}), *listed)
    command("lineage", store, *listed, (("reference",), {}), (("--dest-table",), {}))
    flag = {"action": "store_true"}
    command("requeue", store, *listed, (("reference",), {"nargs": "?"}), (("--all",), flag), (("--dry-run",), flag), (("--yes",), flag), (("--retry-cap",), {"type": int}))
    command("export-audit", store, *listed, (("--out",), {"required": True}))
    command("serve", store, *listed, (("--port",), {"type": int, "default": 8080}))
    command("compact", (("--dir",), {"required": True}), (("--out",), {"required": True}), (("--max-files",), {"type": int, "default": 1000}), (("--gzip",), {"action": "store_true"}), (("--delete-source",), {"action": "store_true"}))
    command("redrop-quarantine", (("--sidecar",), {"required": True}), (("--out",), {"required": True}))
    command("healthcheck", store, *listed, (("--table",), {}), (("--config",), {}), (("--warehouse",), {}))
    source = [(("--config",), {"required": True}), (("--source",), {"required": True}), (("--dry-run",), {"action": "store_true"})]
    command("fetch", *source, (("--inbox",), {}), (("--staging",), {}), (("--cursors",), {}), (("--gzip",), {"action": "store_true"}))
    command("materialize", *source, (("--continuous",), {"action": "store_true"}))
    return p


#: Commands on an audit store, which a registry's pipeline names as well as an option does.
_ON_STORE = ("status", "lineage", "requeue", "export-audit", "serve", "healthcheck")


def _named(args) -> dict:
    """Settings of the registry's pipeline, taken over into args: its audit store, and what of config and warehouse is not given."""
    if bool(args.registry) != bool(args.pipeline) and not (args.command == "status" and args.registry):
        raise registry.RegistryError("--registry and --pipeline go together")
    if not args.registry:
        if not args.audit_db:
            raise registry.RegistryError(f"{args.command} needs --audit-db, or --registry and --pipeline")
        return {}
    if args.audit_db:
        raise registry.RegistryError("either --audit-db or --registry, not both")
    entries = registry.load(args.registry)
    if args.pipeline is None:  # status of all
        args.audit_db = {e.id: e.audit_db for e in entries.values()}
        return {}
    e = registry.resolve(entries, args.pipeline)
    args.audit_db = {e.id: e.audit_db} if args.command == "status" else e.audit_db
    if args.command == "healthcheck":
        args.config, args.warehouse = args.config or e.config, args.warehouse or e.warehouse
    return {"dest_table": configs.load(e.config).dest_table, "retry_cap": configs.load(e.config).retry_cap} if args.command in ("lineage", "requeue") else {}


def _requeue(args, cap: int, say) -> int:
    audit = Audit(args.audit_db)
    if args.all == (args.reference is not None) or (args.dry_run and args.yes) or ((args.dry_run or args.yes) and not args.all):
        print("requeue takes a reference, or --all with --dry-run to list or --yes to do it", file=sys.stderr)
        return 1
    if not args.all:
        what, hashes = audit.requeue(args.reference, cap)
        say({what: hashes})
        return {"requeued": 0, "ambiguous": 2}.get(what, 1)
    terminal = audit.terminal(cap)
    if args.yes:
        say({"requeued": audit.requeue_all(cap)})
    else:
        say({"would_requeue": len(terminal)} | ({"files": [{k: r[k] for k in ("filename", "content_hash", "error_message")} for r in terminal]} if args.dry_run else {}))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    own: dict = {}
    if args.command in _ON_STORE:
        try:
            own = _named(args)
        except (registry.RegistryError, configs.ConfigError, OSError) as e:
            print(e, file=sys.stderr)
            return 1
    spark = session()
    say = lambda x: print(json.dumps(x, indent=2, default=str))
    if args.command == "run":
        if args.registry:
            e = registry.resolve(registry.load(args.registry), args.pipeline)
            args.dir, args.config, args.audit_db, args.warehouse = e.dir, e.config, e.audit_db, e.warehouse or args.warehouse
        if not all((args.dir, args.config, args.audit_db)):
            print("run needs --dir, --config and --audit-db, or --registry and --pipeline", file=sys.stderr)
            return 1
        c = configs.load(args.config)
        if not args.warehouse and not c.connector:
            print("run needs --warehouse where the configuration names no connector", file=sys.stderr)
            return 1
        tell = log.reporter(args.log_format) if args.log_format else None
        with open(args.trace, "a", encoding="utf-8") if args.trace else contextlib.nullcontext() as spans:
            out = run(spark, args.dir, c, Audit(args.audit_db), args.warehouse or "", progress=trace.tracer(spans, tell) if spans else tell)
        say(asdict(out))
        return int(out.failed > 0)
    if args.command == "inspect":
        kind = format_of(args.file, args.format)
        found = infer.infer_parquet(spark.read.parquet(args.file).schema) if kind == "parquet" else infer.infer(_scan(spark, args), args.rows)
        print(infer.as_yaml(found))
        for c in found:
            print(f"# {c.name}: {c.type}, {c.confidence}, {c.null_count} of {c.rows} null{''.join('; ' + n for n in c.notes)}")
    elif args.command == "preview":
        s = _scan(spark, args)
        print(preview_table(s.names, preview(s, args.start_row, args.rows)))
    elif args.command == "validate":
        c = configs.load(args.config)
        s = open_scan(spark, args.file, c)
        found = validate.failures(s, c.columns)
        bad, total = found.select("row_number").distinct().count(), s.df.count()
        fit = validate.tolerance(s.names, c.columns)
        missing, verdict = fit.missing, None
        if c.quarantine and bad:
            verdict = "exceeded" if c.quarantine.exceeded(bad, total) else "quarantined"
        shown = [r.asDict() for r in found.orderBy("row_number", "column").limit(args.shown).collect()]
        if args.json:
            drift = [r.asDict() for r in validate.drift(s, c.columns).orderBy("column").collect()]
            say({"rows": total, "failing_rows": bad, "failures": shown, "all_shown": len(shown) < args.shown, "missing_columns": missing, "undeclared_columns": fit.extra, "drift": drift, "quarantine": verdict})
            return int(bad > 0 or bool(missing))
        for r in shown:
            print(f"row {r['row_number']}: {r['error']}")
        if len(shown) == args.shown:
            print(f"... the first {args.shown}; --shown takes more")
        print(f"{bad} of {total} rows fail" + (f"; missing columns: {', '.join(missing)}" if missing else ""))
        if verdict:
            print("over the quarantine threshold" if verdict == "exceeded" else "would be quarantined")
        return int(bad > 0 or bool(missing))
    elif args.command == "report":
        import yaml

        found = authoring.examine(spark, args.file, yaml.safe_load(Path(args.config).read_text()), args.rows, args.shown)
        say({"ok": found.ok} | asdict(found))
        return int(not found.ok)
    elif args.command == "draft":
        sheet = int(args.sheet) if args.sheet and args.sheet.isdigit() else args.sheet
        made = authoring.from_sample(spark, args.file, args.table, format_of(args.file, args.format), args.encoding, sheet, args.rows).acknowledge(*args.acknowledge)
        for e in made.unsure():
            print(f"# {e.name}: {e.type}, {e.confidence}, {e.null_count} of {e.rows} null{''.join('; ' + n for n in e.notes)}", file=sys.stderr)
        print(made.yaml() if not args.workspace else authoring.save(args.workspace, made, args.file))
    elif args.command == "browse":
        say({"pipelines": [asdict(r) for r in registry.browse(Path(args.workspace, registry.FILE))], "unlisted": registry.discover(args.workspace)})
    elif args.command == "status":
        say(export.status_all(spark, args.audit_db if isinstance(args.audit_db, dict) else {p: p for p in args.audit_db}))
    elif args.command == "lineage":
        what, rows = Audit(args.audit_db).lineage(args.reference)
        if into := args.dest_table or own.get("dest_table"):
            rows = [r | {"destination": {"table": into, "query": f"SELECT * FROM {into} WHERE {HASH} = '{r['content_hash']}'"}} for r in rows]
        say(rows)
        return {"found": 0, "missing": 1, "ambiguous": 2}[what]
    elif args.command == "requeue":
        return _requeue(args, args.retry_cap if args.retry_cap is not None else own.get("retry_cap", 3), say)
    elif args.command == "export-audit":
        Path(args.out).write_text(export.page(spark, Audit(args.audit_db)))
    elif args.command == "serve":
        export.serve(spark, Audit(args.audit_db), args.port).serve_forever()
    elif args.command == "compact":
        say(compact(spark, args.dir, args.out, args.max_files, args.gzip, args.delete_source))
    elif args.command == "redrop-quarantine":
        from ..sources.promote import write_staged

        out = Path(args.out)
        write_staged(out.parent, out.name, (r["value"] for r in quarantine.redrop(spark, args.sidecar).toLocalIterator()))
    elif args.command == "healthcheck":
        table = Table(spark, args.table) if args.table else None
        if args.config:
            c = configs.load(args.config)
            table = destination(spark, c.connector, c.dest_table, args.warehouse or "")
        out = health(spark, Audit(args.audit_db), table)
        say(out)
        return int(not all(x["ok"] for x in out.values()))
    elif args.command == "fetch":
        raw = fetch.load_sources(args.config).get(args.source)
        if raw is None:
            print(f"no source {args.source!r} in {args.config}", file=sys.stderr)
            return 1
        raw = fetch.settings(raw)
        source, place = fetch.parse_source(raw), {k: getattr(args, k) or raw.get(k) for k in ("inbox", "staging", "cursors")}
        if args.dry_run:
            say({"source": source.name, "url": source.url, "kind": source.kind} | place)
            return 0
        if not all(place.values()):
            print("fetch needs inbox, staging and cursors, as options or in the source", file=sys.stderr)
            return 1
        say(fetch.run_fetch(spark, source, fetch.http, place["inbox"], place["staging"], fetch.CursorStore(place["cursors"]), args.gzip or bool(raw.get("gzip"))))
    elif args.command == "materialize":
        raw = fetch.load_sources(args.config).get(args.source)
        if raw is None:
            print(f"no source {args.source!r} in {args.config}", file=sys.stderr)
            return 1
        plan = materialize.parse_plan(raw)
        if args.dry_run:
            say(asdict(plan))
            return 0
        stream = materialize.source(spark, plan)
        if args.continuous:
            stop = threading.Event()
            signal.signal(signal.SIGTERM, lambda *_: stop.set())
            signal.signal(signal.SIGINT, lambda *_: stop.set())
            materialize.follow(stream, plan, stop, lambda _, paths: say({"paths": paths}))
        else:
            say({"paths": materialize.drain(stream, plan)})
    return 0
