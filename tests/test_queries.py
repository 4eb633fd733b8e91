"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomery import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float) or hasattr(v, "quantize"):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got or name.startswith("k06")
        return
    found = duck.sql(sql)
    columns = found.columns
    assert sorted(columns) == names
    want = sorted((tuple(norm(v) for _, v in sorted(zip(columns, r, strict=True), key=lambda x: x[0])) for r in found.fetchall()), key=repr)
    assert got == want
