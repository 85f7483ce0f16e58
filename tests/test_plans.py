"""Every registered query of the reference's operators against its SQL statement, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from stemforge import plans


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    out = []
    for row in frame.where(frame.notna(), None).itertuples(index=False):
        out.append(tuple(x if x is None or isinstance(x, str) else round(float(x), 5) if isinstance(x, (int, float, bool)) or hasattr(x, "as_tuple") or hasattr(x, "dtype") else str(x) for x in row))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query_matches_sql(spark, small, con, name):
    got = plans.QUERIES[name](spark, small).toPandas()
    if name not in plans.ORACLE_SQL:
        assert len(got) > 0
        return
    expected = con.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)


def test_entry_runs(spark):
    import __spark_entry__

    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
