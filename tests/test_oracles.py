"""Every registered evaluation query against its SQL, on whole tables."""

import math

import duckdb
import pytest

from evalloom.plans.oracles import ORACLES
from evalloom.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    names = ", ".join(f'"{c}"' for c in cols)
    assert got == sorted((tuple(norm(v) for v in r) for r in con.sql(f"SELECT {names} FROM ({ORACLES[name]})").fetchall()), key=repr)
