"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from cairnlight.plans.queries import QUERIES, SQL, flagship
from tests.properties import PROPERTIES

BASE = os.environ.get("CAIRNLIGHT_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(BASE):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{BASE}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, BASE)
    rows = df.collect()
    if name not in SQL:  # then a property must be stated
        PROPERTIES[name](rows, db)
        return
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in rows)
    cur = db.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in sorted(cols)]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def test_flagship(spark):
    r = flagship(spark, BASE).first()
    assert r.queries > 0 and 0 <= r.recall_at_3 <= 1
