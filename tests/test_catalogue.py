"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from strophe import catalogue

SF = "/root/testdata/sf0.001"
#: Folds and whole pipelines without SQL; test_sequence.py, test_tokenize.py and test_tasks.py test them, all but the report (its counters) against sequential versions.
TESTED_ELSEWHERE = {"greedy_select", "calibrate", "tokenize", "tokenization_report"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def canon(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    return f"{float(v):.6g}" if math.isfinite(float(v)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    if name not in catalogue.SQL:
        assert name in TESTED_ELSEWHERE and got
        return
    rel = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want and got
