"""Every engine query against its SQL, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from harborline.queries import ORACLE_SQL, QUERIES

TABLES = Path(os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not TABLES.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in TABLES.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    yield con
    con.close()


def plain(value):
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) or type(value).__name__ == "Decimal" else None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, oracle, name):
    df = QUERIES[name](spark, str(TABLES))
    got = oracle.execute(ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    rows = lambda it: sorted((tuple(map(plain, r)) for r in it), key=repr)
    assert rows(df.select(*(f"`{c}`" for c in names)).collect()) == rows(got.fetchall())


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
