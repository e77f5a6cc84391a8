"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from seqloom.plans import catalog



def rows(frame, columns):
    plain = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x
    return sorted(tuple(str(plain(x)) for x in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, sf_dir, db, name):
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), db.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
    assert len(got) or name == "unresolved_genes"
