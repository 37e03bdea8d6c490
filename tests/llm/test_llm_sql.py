import glob
import os

import duckdb
import pytest

from gapline.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    rel = con.execute(ORACLES[name])
    names = [c[0] for c in rel.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (r for r in got.select(*names).collect()))) == sorted("Row(" + ", ".join(f"{n}={v!r}" for n, v in zip(names, r)) + ")" for r in rel.fetchall())
