"""Each registered query against its SQL on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

from linkmill.plans import catalog, lookups, records, steps

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def shape(columns, rows):
    def cell(v):
        if v is None or v != v:
            return None
        return f"{float(v):.7g}" if isinstance(v, (float, Decimal)) else str(v)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(cell(row[i]) for i in order) for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES | records.QUERIES | lookups.QUERIES | steps.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = got.collect()
    want = con.execute(catalog.SQL[name])
    assert shape(got.columns, rows) == shape([x[0] for x in want.description], want.fetchall())
