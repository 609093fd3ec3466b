"""Driver contract: entry smoke, registry/oracle coverage and a DuckDB
comparison of every SQL-checked query on the smallest driver tables."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from refbank.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
ROWS_ONLY = {"run_batch", "learn_cycle"}


def _own(keys):
    """Keys of this package; the corpus operators have tests of their own."""
    return {k: v for k, v in keys.items() if k in REGISTRY}


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["input_id", "rank", "id", "source", "confidence"]
    assert df.count() > 0


def test_every_query_has_oracle_or_is_rows_only():
    q, o = _own(E.queries()), _own(E.oracle_sql())
    assert set(q) - set(o) == ROWS_ONLY
    assert set(o) <= set(q)


@pytest.mark.parametrize("key", sorted(_own(E.oracle_sql())))
def test_query_matches_duckdb(spark, con, key):
    sdf = E.queries()[key](spark, SF)
    res = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert digest(sdf.columns, [tuple(r) for r in sdf.collect()]) == digest(dcols, res.fetchall())
