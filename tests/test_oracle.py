"""Every registered query against its DuckDB oracle on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_ORACLE

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (2, v)
    if hasattr(v, "asDict"):
        v = v.asDict(recursive=True)
    if isinstance(v, dict):
        return (3, repr(sorted((k, _norm(x)) for k, x in v.items())))
    if isinstance(v, (list, tuple)):
        return (3, repr([_norm(x) for x in v]))
    return (4, str(v))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_ORACLE}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF_ORACLE)
    cols = sorted(sdf.columns)
    srows = sorted(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    # the oracle texts name the sf0.01 folder where they read files directly
    res = con.execute(entry.oracle_sql()[name].replace("/root/testdata/sf0.01", SF_ORACLE))
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    drows = sorted(tuple(_norm(dict(zip(dcols, r))[c]) for c in cols) for r in res.fetchall())
    assert len(srows) == len(drows)
    assert srows == drows


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_oracle_runs(spark, name):
    df = entry.queries()[name](spark, SF_ORACLE)
    assert df.count() >= 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["Ano", "Mes", "Categoria"]
