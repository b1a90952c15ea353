"""Every query of the core against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from compare import rows_of
from loomspan.plans import catalogue

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")


def check(spark, name, query, sql):
    rows = query(spark, TABLES)
    got = rows_of(rows.columns, [tuple(r) for r in rows.collect()])
    if sql is None:
        return
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{TABLES}/{f}'")
    cur = con.execute(sql)
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall()), name


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    check(spark, name, catalogue.queries()[name], catalogue.oracles().get(name))


def test_every_sql_has_its_query():
    assert set(catalogue.oracles()) <= set(catalogue.queries())
