import glob
import os

import duckdb
import pytest

from voxloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, name):
    df = queries.queries()[name](spark, data)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    if name.endswith("_found"):
        assert len(got) == len(set(got)) > 0
    sql = queries.oracle_sql().get(name)
    if sql:
        db = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        order = [names.index(c) for c in sorted(names)]
        assert sorted(names) == sorted(df.columns) and sorted(got, key=repr) == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)
