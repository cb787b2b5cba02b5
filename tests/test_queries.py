"""Every query of the core runs, and gives what SQL gives over the same tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from voxloom.plans import oracle, queries

def plain(v):
    if v is None or v != v:
        return None
    return float(f"{v:.9g}") if isinstance(v, float) else v if not isinstance(v, float) or not math.isnan(v) else None


def tables(folder):
    db = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return db


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, name):
    df = queries.queries()[name](spark, data)
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    sql = oracle.oracle_sql().get(name)
    if sql:
        found = tables(data).execute(sql)
        names = [d[0] for d in found.description]
        order = [names.index(c) for c in sorted(names)]
        expected = [tuple(plain(r[i]) for i in order) for r in found.fetchall()]
        assert sorted(names) == sorted(df.columns) and sorted(got, key=repr) == sorted(expected, key=repr)


def test_entry(spark):
    assert {"source", "kept", "median_error"} <= set(entry.entry(spark).columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_never_imports_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/voxloom/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "voxloom.llm" not in open(path, encoding="utf-8").read(), path
