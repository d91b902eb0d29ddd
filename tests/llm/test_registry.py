import os

import duckdb
import pytest

from kinlink.llm import registry

SF = "/root/testdata/sf0.001"


def values(df):
    return sorted((tuple(str(v) for v in r) for r in df[sorted(df.columns)].round(9).astype(object).itertuples(index=False)))


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)


def test_ten_queries_in_order():
    assert [k.split("_")[0] for k in registry.queries()] == [f"op{n}" for n in range(1, 11)]
