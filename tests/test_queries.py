"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _norm(frame):
    import pandas as pd

    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        if type(x).__name__ in ("bool", "bool_"):
            return bool(x)
        return round(float(x), 9) if hasattr(x, "item") or isinstance(x, (int, float)) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from assay.sources.bindings import TABLES

    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _names():
    from assay.plans import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", _names())
def test_query(spark, duck, name):
    from assay.plans import ORACLE_SQL, QUERIES

    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert _norm(got) == _norm(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert {r["arm"] for r in e.entry(spark).collect()} == {"T", "G"}
    assert set(e.oracle_sql()) <= set(e.queries())
