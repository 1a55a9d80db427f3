"""API sources: pages of JSON records into complete files, resumed by a cursor.

Sources page by number, by "starting_after" while has_more, or come as one document whose newer records are kept. Pages are read by
executors (api.py) into the staging folder, once; from there the sink writes the files and the largest cursor is taken. The cursor
moves last, so a crash before it fetches the same records again. The transport is a callable (url, params, headers) -> Response, so
that tests need no network.
"""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path
from typing import Any
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans import manifest as manifests
from ..plans.config import ConfigError
from .promote import slug, staged_name
from .sink import stage_files
from .stores import delete_folder, qualified, store_lock

KINDS = ("http", "edgar", "stripe")


@dataclass(frozen=True)
class Response:
    status: int
    body: Any
    headers: dict[str, str] = field(default_factory=dict)


Transport = Callable[[str, dict, dict], Response]


class FetchError(RuntimeError):
    pass


@dataclass(frozen=True)
class Source:
    name: str
    url: str
    kind: str = "http"
    records_path: str = ""
    cursor_field: str = ""
    cursor_param: str = ""  # set: the server filters; else records are compared here
    id_field: str = "id"
    page_size: int = 100
    page_param: str = "page"
    per_page_param: str = "per_page"
    pages_path: str = ""  # where the first page's document names the number of pages, if a Link header does not
    query: dict = field(default_factory=dict)
    headers: dict[str, str] = field(default_factory=dict)
    retries: int = 3
    backoff_s: float = 1.0


#: Other names of settings, and the services' own conventions.
_ALIASES = {"type": "kind", "record_path": "records_path", "watched_directory": "inbox", "staging_dir": "staging"}
_STRIPE = {"records_path": "data", "cursor_field": "created", "cursor_param": "created[gt]"}
_SETTINGS = ("records_path", "cursor_field", "cursor_param", "id_field", "page_size", "page_param", "per_page_param", "pages_path", "query", "headers", "retries", "backoff_s")


def settings(raw: dict) -> dict:
    """A source's entry under one set of names: cursor: {field, param} and the like are spelled out."""
    out = {_ALIASES.get(k, k): v for k, v in raw.items()}
    cursor = out.pop("cursor", None) or {}
    if not isinstance(cursor, dict):
        raise ConfigError("cursor: names a field, and a param if the server filters")
    out = {f"cursor_{k}": v for k, v in cursor.items()} | out
    if out.get("state_dir"):
        out.setdefault("cursors", f"{out['state_dir']}/cursors.json")
    for k in ("query", "headers"):
        if not isinstance(out.get(k) or {}, dict):
            raise ConfigError(f"{k}: is a mapping")
    return out


def parse_source(raw: dict) -> Source:
    raw = settings(raw)
    kind = raw.get("kind", "http")
    if kind not in KINDS:
        raise ConfigError(f"Unknown source {kind!r}; choose one of {', '.join(KINDS)}")
    url, headers, known = raw.get("url", ""), dict(raw.get("headers") or {}), {}
    if kind == "edgar":
        missing = [k for k in ("cik", "concept", "unit", "user_agent", "cursor_field") if not raw.get(k)]
        if missing:
            raise ConfigError(f"an edgar source requires {', '.join(missing)}")
        digits = str(raw["cik"]).upper().removeprefix("CIK")
        if not digits.isdigit() or len(digits) > 10:
            raise ConfigError(f"cik: {raw['cik']!r} is no company number")
        # one concept of one company; records lie by unit of measure. The service turns away callers that do not name themselves
        path = f"CIK{digits.zfill(10)}/{quote(str(raw.get('taxonomy', 'us-gaap')), safe='')}/{quote(str(raw['concept']), safe='')}"
        url = url or f"https://data.sec.gov/api/xbrl/companyconcept/{path}.json"
        headers.setdefault("User-Agent", str(raw["user_agent"]))
        known = {"records_path": f"units.{raw['unit']}"}
        raw.pop("cursor_param", None)  # the service does not filter
    if kind == "stripe":
        url = url or f"{str(raw.get('api_base', 'https://api.stripe.com')).rstrip('/')}/v1/{str(raw.get('resource', 'charges')).strip('/')}"
        if raw.get("stripe_version"):
            headers.setdefault("Stripe-Version", str(raw["stripe_version"]))
        known = dict(_STRIPE)
    if raw.get("credential_env"):
        headers.setdefault("Authorization", f"Bearer env:{raw['credential_env']}")
    if not raw.get("name") or not url:
        raise ConfigError("a source requires name: and url:")
    known |= {k: raw[k] for k in _SETTINGS if raw.get(k) is not None} | {"headers": headers}
    return Source(name=raw["name"], url=url, kind=kind, **known)


def load_sources(path: str) -> dict[str, dict]:
    """The sources of a file by name: a `sources:` list."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text()) or {}
    out = {s.get("name"): s for s in raw.get("sources", [])}
    if not out or None in out:
        raise ConfigError(f"{path} names no sources:")
    return out


def http(url: str, params: dict, headers: dict) -> Response:
    """A transport over the standard library; header values may name environment variables as env:NAME or Bearer env:NAME, which
    are looked up where the request is made, so that no secret is in a plan."""
    from urllib.error import HTTPError
    from urllib.parse import urlencode
    from urllib.request import Request, urlopen

    real = {"Accept": "application/json"} | {k: re.sub(r"^(Bearer |)env:(\w+)$", lambda m: m[1] + os.environ[m[2]], v) for k, v in headers.items()}
    whole = f"{url}{'&' if '?' in url else '?'}{urlencode(params)}" if params else url
    try:
        with urlopen(Request(whole, headers=real), timeout=60) as r:
            return Response(r.status, json.loads(r.read()), dict(r.headers))
    except HTTPError as e:
        return Response(e.code, None, dict(e.headers))


def dotted(value: Any, path: str) -> Any:
    for part in path.split(".") if path else []:
        value = value.get(part) if isinstance(value, dict) else None
    return value


def records_of(body: Any, path: str) -> list[dict]:
    """The array at a dotted path; none if there is nothing there."""
    found = dotted(body, path)
    if found is None:
        return []
    if not isinstance(found, list):
        raise FetchError(f"no array at {path or 'the top'}")
    return found


def ask(source: Source, transport: Transport, params: dict, sleep: Callable[[float], None] = time.sleep) -> Response:
    """One request; when the server limits rates it is asked again after the time that it names."""
    for attempt in range(source.retries + 1):
        r = transport(source.url, dict(source.query) | params, source.headers)
        head = {k.lower(): v for k, v in r.headers.items()}
        if 200 <= r.status < 300:
            return r
        limited = r.status in (403, 429) and ("retry-after" in head or head.get("x-ratelimit-remaining") == "0" or r.status == 429)
        if not limited or attempt == source.retries:
            raise FetchError(f"{source.url}: status {r.status}")
        try:
            wait = float(head["retry-after"])
        except (KeyError, ValueError):
            wait = source.backoff_s * 2**attempt
        sleep(wait)
    raise FetchError(source.url)


def page_params(source: Source, number: int, cursor: str | None) -> dict:
    return {source.page_param: number, source.per_page_param: source.page_size} | ({source.cursor_param: cursor} if cursor else {})


def last_page(source: Source, first: Response) -> int | None:
    """How many pages there are, if the first says so: by a Link header with rel="last", or where pages_path points."""
    link = {k.lower(): v for k, v in first.headers.items()}.get("link", "")
    for part in link.split(","):
        if 'rel="last"' in part and (m := re.search(rf"[?&]{re.escape(source.page_param)}=(\d+)", part)):
            return int(m[1])
    named = dotted(first.body, source.pages_path) if source.pages_path else None
    return int(named) if named is not None else None


def pages(source: Source, transport: Transport, cursor: str | None = None, begin: int = 1, end: int | None = None, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[int, list[dict]]]:
    """(number, records after the cursor) of pages begin to end, or to the last one."""
    if source.kind == "stripe":
        # newest first, so a run asks for what is newer than the cursor and walks back to it; where it stopped is no place to go on from
        number, after = 1, None
        while True:
            params = {"limit": source.page_size} | ({source.cursor_param: cursor} if cursor else {}) | ({"starting_after": after} if after else {})
            body = ask(source, transport, params, sleep).body
            if not isinstance(body, dict):
                raise FetchError(f"{source.url}: no JSON object")
            page = records_of(body, source.records_path)
            yield number, page
            after = page[-1].get(source.id_field) if page and isinstance(page[-1], dict) else None
            if not body.get("has_more") or not after:
                return
            number += 1
    if not source.cursor_param:
        found = records_of(ask(source, transport, {}, sleep).body, source.records_path)
        yield 1, [r for r in found if cursor is None or ((v := dotted(r, source.cursor_field)) is not None and str(v) > cursor)]
        return
    number = begin
    while end is None or number <= end:
        page = records_of(ask(source, transport, page_params(source, number, cursor), sleep).body, source.records_path)
        yield number, page
        if len(page) < source.page_size:
            return
        number += 1


def cursor_of(source: Source, record: dict) -> str | None:
    value = dotted(record, source.cursor_field) if source.cursor_field else None
    return None if value is None else str(value)


def fetch(source: Source, transport: Transport, cursor: str | None = None, sleep: Callable[[float], None] = time.sleep) -> tuple[list[dict], str | None]:
    """Records after the cursor and the new cursor, in this process: for a look at a source. Runs go through executors."""
    out = [r for _, page in pages(source, transport, cursor, sleep=sleep) for r in page]
    seen = [v for r in out if (v := cursor_of(source, r)) is not None]
    return out, max([*([cursor] if cursor is not None else []), *seen], default=None)


class CursorStore:
    """Cursors of sources in one JSON file, replaced whole."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def all(self) -> dict[str, str]:
        return json.loads(self.path.read_text()) if self.path.exists() else {}

    def get(self, source: str) -> str | None:
        return self.all().get(source)

    def set(self, source: str, value: str) -> None:
        temporary = self.path.with_name(self.path.name + ".tmp")
        self.path.parent.mkdir(parents=True, exist_ok=True)
        temporary.write_text(json.dumps(self.all() | {source: value}, sort_keys=True))
        os.replace(temporary, self.path)


#: Records of a file, at most, but for its last page.
FILE_RECORDS = 1_000_000


def run_fetch(
    spark: SparkSession, source: Source, transport: Transport, inbox: str | Path, staging: str | Path, cursors: CursorStore, compress: bool = False, clock=lambda: datetime.now(UTC), file_records: int = FILE_RECORDS, pages_per_task: int = 10,
) -> dict:
    """Fetch, stage, publish, then advance the cursor: the largest value of cursor_field, as text, never below the old one."""
    from .api import read_api

    inbox, staging = str(inbox).rstrip("/"), str(staging).rstrip("/")
    with store_lock(spark, staging, slug(source.name)):
        began, old = clock(), cursors.get(source.name)
        raw = qualified(spark, f"{staging}/.fetch-{uuid.uuid4().hex}")
        try:
            read_api(spark, source, transport, old, pages_per_task).write.parquet(raw)
            got = spark.read.parquet(raw)
            n, top = got.agg(F.count("*"), F.max("cursor")).first()
            if not n:
                return {"status": "skipped", "records": 0, "paths": [], "cursor": old}
            ended = clock()
            new = max((c for c in (old, top) if c is not None), default=None)
            per_file = max(1, file_records // source.page_size)
            rows = got.select(F.format_string("%05d", F.floor((F.col("page") - 1) / per_file)).alias("key"), (F.col("page") * F.lit(1 << 32) + F.col("at")).alias("mark"), F.col("record").alias("line"))
            job, run = stage_files(rows, staging, compress), str(uuid.uuid4())
            name = staged_name(source.name, old or "start", new or "end", ended.strftime("%Y%m%dT%H%M%SZ"), compress)
            stem, dot, ending = name.partition(".ndjson")

            def target(f):
                side = manifests.emit("harborline.fetch", source.name, run, "harborline", source.kind, f.lines, {"from": old, "to": new}, began.isoformat(), ended.isoformat())
                return f"{inbox}/{name if len(job.files) == 1 else f'{stem}-{f.key}{dot}{ending}'}", side

            paths = job.publish(target)
        finally:
            delete_folder(raw)
        if new is not None:
            cursors.set(source.name, new)
    return {"status": "fetched", "records": n, "paths": paths, "cursor": new}
