"""Every query with an oracle against DuckDB on the smallest tables."""

import duckdb
import pytest

from pagemill import catalog

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    assert got, "no rows"
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        at = [want.columns.index(c) for c in cols]
        assert len(want.columns) == len(cols)
        assert got == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall())))
