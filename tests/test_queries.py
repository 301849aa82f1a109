"""Every registered query of the engine against the same in DuckDB, and its types."""

import glob
import math
import os

import duckdb
import pytest

from lattica.plans import all as plans

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "float": "FLOAT", "int": "INTEGER"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ("", "")
    return (type(v).__name__, repr(round(v, 9)) if isinstance(v, float) else str(v))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, sf, name):
    df = plans.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in plans.SQL:
        assert rows
        return
    rel = duck.sql(plans.SQL[name])
    assert columns == sorted(rel.columns)
    kinds = dict(df.dtypes)
    assert {c: TYPES[kinds[c]] for c in columns} == {c: str(t) for c, t in zip(rel.columns, rel.types, strict=True)}
    expected = sorted(tuple(plain(dict(zip(rel.columns, r, strict=True))[c]) for c in columns) for r in rel.fetchall())
    assert rows == expected


def test_entry_without_training_data_operators(monkeypatch):
    """The rest imports and registers when the optional subpackage is gone."""
    import builtins
    import importlib

    import __spark_entry__ as entry

    real = builtins.__import__

    def gone(name, *a, **k):
        if name.startswith("corpus_pipeline") or name.startswith("lattica.llm"):
            raise ImportError(name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", gone)
    importlib.reload(entry)
    names = set(entry.queries())
    monkeypatch.undo()
    importlib.reload(entry)
    assert names == set(plans.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_box_reaches_the_scan(spark, sf):
    df = plans.QUERIES["points_in_bounds_by_feature"](spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(event_id,100)" in plan[plan.index("PushedFilters") :]
    assert "struct<event_id:bigint,event_type:string,value:double>" in plan[plan.index("ReadSchema") :]
