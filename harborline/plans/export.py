"""Reports of the audit store: status as text, and a page that stands alone."""

from __future__ import annotations

import html
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from ..operators import audit_views
from .audit import Audit


def status(spark: SparkSession, audit: Audit) -> dict:
    records = audit.frame(spark)
    return {
        "by_state": {r["state"]: r["files"] for r in audit_views.by_state(records).collect()},
        "recent_failures": [r.asDict() for r in audit_views.recent_failures(records).collect()],
        "quarantined_rows": audit_views.quarantined(records).first()[0],
    }


def status_all(spark: SparkSession, stores: dict[str, str]) -> dict[str, dict]:
    """Status of several audit stores, each on its own; one that cannot be read does not hide the others."""
    out = {}
    for name, path in stores.items():
        try:
            audit = Audit(path)
            out[name] = status(spark, audit)
            audit.close()
        except Exception as e:
            out[name] = {"error": str(e)}
    return out


def page(spark: SparkSession, audit: Audit) -> str:
    records = audit.frame(spark)
    total = audit_views.overview(records).first().asDict()
    rows = audit_views.listing(records).collect()
    cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"
    head = "".join(f"<th>{c}</th>" for c in audit_views.LISTED)
    body = "".join(f"<tr>{''.join(cell(v) for v in r)}</tr>" for r in rows)
    sums = "".join(f"<li>{k}: {v}</li>" for k, v in total.items())
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>Audit</title><style>td,th{{padding:4px;border:1px solid #ccc}}table{{border-collapse:collapse}}</style></head><body><h1>Audit</h1><ul>{sums}</ul><table><tr>{head}</tr>{body}</table></body></html>"


def serve(spark: SparkSession, audit: Audit, port: int = 8080) -> ThreadingHTTPServer:
    """A server on localhost that makes the page anew for each request; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            data = page(spark, audit).encode()
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
