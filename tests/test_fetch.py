"""API sources through executors: pages side by side or in a chain, cursors that move last, the services' own conventions."""

import json
import re

import pytest
from pyspark.sql import functions as F

from harborline.plans import manifest
from harborline.plans.config import ConfigError
from harborline.queries import _paged
from harborline.sources import fetch
from harborline.sources.api import Api, _Reader, read_api


def server(folder, records, counted=True):
    """Numbered pages of records newer than `since`; every request leaves a file."""

    def transport(url, params, headers):
        import uuid

        (folder / f"{params.get('page')}-{uuid.uuid4().hex}").touch()
        newer = [r for r in records if r["t"] > params.get("since", "")]
        size = params["per_page"]
        link = {"link": f'<{url}?page=2>; rel="next", <{url}?x=1&page={-(-len(newer) // size)}>; rel="last"'} if counted else {}
        return fetch.Response(200, newer[(params["page"] - 1) * size : params["page"] * size], link)

    return transport


def rows(n, begin=0):
    return [{"t": f"{i:05d}", "x": "é\n"} for i in range(begin, n)]


@pytest.mark.parametrize("n", [0, 1, 10, 95, 100])
@pytest.mark.parametrize("counted", [True, False])
def test_every_page_is_read_once(spark, tmp_path, n, counted):
    source = fetch.parse_source({"name": "s", "url": "u", "page_size": 10, "cursor": {"param": "since", "field": "t"}})
    df = read_api(spark, source, server(tmp_path, rows(n), counted), pages_per_task=3)
    assert df.rdd.getNumPartitions() == (-(-max(1, -(-n // 10)) // 3) if counted else 1)
    for f in tmp_path.iterdir():
        f.unlink()
    got = [(json.loads(r["record"])["t"], r["cursor"], r["page"]) for r in df.collect()]
    assert sorted(got) == [(f"{i:05d}", f"{i:05d}", i // 10 + 1) for i in range(n)]
    asked = sorted(int(f.name.split("-")[0]) for f in tmp_path.iterdir())
    want = list(range(1, n // 10 + 2))  # a last page that is full is followed by an empty one; the count itself takes a look at the first
    assert asked in (want, [1, *want])


def test_pages_that_come_meanwhile_are_read(tmp_path):
    source = fetch.parse_source({"name": "s", "url": "u", "page_size": 10, "cursor": {"param": "since", "field": "t"}})
    last = _Reader(source, server(tmp_path, rows(55)), None, 2).partitions()[-1]
    assert sum(b.num_rows for b in _Reader(source, server(tmp_path, rows(78)), None, 2).read(last)) == 78 - 10 * (last.begin - 1)
    assert Api.name() == "harborline_api"


def test_runs_follow_each_other(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    source = fetch.parse_source({"name": "my source", "url": "u", "page_size": 10, "cursor": {"param": "since", "field": "t"}})
    cursors = fetch.CursorStore(tmp_path / "cursors.json")
    go = lambda n: fetch.run_fetch(spark, source, server(tmp_path / "asked", rows(n)), tmp_path / "in", tmp_path / "st", cursors, file_records=20, pages_per_task=2)
    first = go(45)
    assert (first["records"], first["cursor"], len(first["paths"])) == (45, "00044", 3)
    assert go(45) == {"status": "skipped", "records": 0, "paths": [], "cursor": "00044"}
    second = go(47)
    assert second["records"] == 2 and len(second["paths"]) == 1 and cursors.get("my source") == "00046"
    lines = [json.loads(x)["t"] for p in first["paths"] + second["paths"] for x in open(p, encoding="utf-8").read().split("\n") if x]
    assert lines == [f"{i:05d}" for i in range(47)] and not list((tmp_path / "st").iterdir())
    side = manifest.parse(open(second["paths"][0] + manifest.SUFFIX).read())
    assert side.record_count == 2 and json.loads(side.source_range) == {"from": "00044", "to": "00046"}


def test_a_fetch_that_fails_moves_nothing(spark, tmp_path):
    def transport(url, params, headers):
        return fetch.Response(500 if params["page"] == 3 else 200, [{"t": "1"}] * 10, {"link": '<u?page=4>; rel="last"'})

    source = fetch.parse_source({"name": "s", "url": "u", "page_size": 10, "cursor": {"param": "since", "field": "t"}})
    cursors = fetch.CursorStore(tmp_path / "cursors.json")
    with pytest.raises(Exception, match="status 500"):
        fetch.run_fetch(spark, source, transport, tmp_path / "in", tmp_path / "st", cursors)
    assert cursors.get("s") is None and not (tmp_path / "in").exists() and not list((tmp_path / "st").iterdir())


def stripe(records, calls=None):
    """Lists run from new to old; each page says whether there is more."""

    def transport(url, params, headers):
        if calls is not None:
            calls.append(params)
        some = [r for r in sorted(records, key=lambda r: -r["created"]) if r["created"] > int(params.get("created[gt]", 0))]
        ids = [r["id"] for r in some]
        at = ids.index(params["starting_after"]) + 1 if "starting_after" in params else 0
        return fetch.Response(200, {"object": "list", "data": some[at : at + params["limit"]], "has_more": at + params["limit"] < len(some)})

    return transport


def charges(n):
    return [{"id": f"ch_{i}", "created": 1_700_000_000 + i} for i in range(n)]


def test_lists_from_new_to_old_give_only_what_is_newer(spark, tmp_path):
    source = fetch.parse_source({"name": "charges", "type": "stripe", "resource": "charges", "credential_env": "KEY", "page_size": 4, "stripe_version": "2024-01-01", "query": {"expand[]": "data.customer"}})
    assert source.url == "https://api.stripe.com/v1/charges" and source.headers == {"Authorization": "Bearer env:KEY", "Stripe-Version": "2024-01-01"}
    cursors = fetch.CursorStore(tmp_path / "cursors.json")
    go = lambda n: fetch.run_fetch(spark, source, stripe(charges(n)), tmp_path / "in", tmp_path / "st", cursors)
    assert go(10)["records"] == 10 and cursors.get("charges") == "1700000009"
    assert go(10)["status"] == "skipped"
    second = go(13)
    assert [json.loads(x)["id"] for x in open(second["paths"][0])] == ["ch_12", "ch_11", "ch_10"] and second["cursor"] == "1700000012"
    calls = []
    fetch.fetch(source, stripe(charges(10), calls), "1700000002")
    assert [c.get("starting_after") for c in calls] == [None, "ch_6"] and all(c["created[gt]"] == "1700000002" and c["expand[]"] == "data.customer" for c in calls)


def test_company_concepts():
    raw = {"name": "e", "type": "edgar", "cik": 320193, "concept": "AccountsPayableCurrent", "unit": "USD", "user_agent": "me me@example.org", "cursor": {"field": "filed"}}
    source = fetch.parse_source(raw)
    assert source.url == "https://data.sec.gov/api/xbrl/companyconcept/CIK0000320193/us-gaap/AccountsPayableCurrent.json" and source.headers["User-Agent"] == "me me@example.org"
    body = {"units": {"USD": [{"filed": "2023-01-01"}, {"filed": "2024-01-01"}], "EUR": [{"filed": "2025-01-01"}]}}
    assert fetch.fetch(source, lambda *_: fetch.Response(200, body), "2023-06-01") == ([{"filed": "2024-01-01"}], "2024-01-01")
    for missing in ("cik", "concept", "unit", "user_agent", "cursor"):
        with pytest.raises(ConfigError, match=missing.replace("cursor", "cursor_field")):
            fetch.parse_source({k: v for k, v in raw.items() if k != missing})
    with pytest.raises(ConfigError, match="company number"):
        fetch.parse_source(raw | {"cik": "apple"})


def test_settings_by_either_name():
    got = fetch.settings({"type": "http", "record_path": "a.b", "watched_directory": "in", "staging_dir": "st", "state_dir": "s", "cursor": {"field": "t", "param": "since"}})
    assert got == {"kind": "http", "records_path": "a.b", "inbox": "in", "staging": "st", "state_dir": "s", "cursors": "s/cursors.json", "cursor_field": "t", "cursor_param": "since"}
    with pytest.raises(ConfigError):
        fetch.settings({"headers": "x"})


def test_served_pages_are_numbered_by_many_tasks(spark):
    records = spark.range(0, 300_000, 3, 6).select(F.col("id").alias("mark"), F.col("id").cast("string").alias("record"))
    paged = _paged(records, 100)
    # a row for each 65,536 marks may go to one task, the records may not
    alone = re.findall(r"Exchange SinglePartition.*\n\W*(\w+)", paged._jdf.queryExecution().executedPlan().toString())
    assert set(alone) <= {"HashAggregate"}
    assert paged.where(F.col("page") != F.floor(F.col("mark") / 300) + 1).count() == 0 and paged.count() == 100_000
