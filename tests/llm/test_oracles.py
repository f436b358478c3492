import os

import duckdb
import pytest

from tidewell.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    d = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        path = f"{SF}/{t}.parquet"
        d.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = d.sql(ORACLES[name])
    names = list(found.columns)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(found.fetchall())


def test_thirteen_operators_and_the_pipeline():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
