"""Registered training-data queries against their SQL on the smallest data set."""

import duckdb
import pytest

from gleaner.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(result.fetchall(), key=repr)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_returns_every_row(spark, name):
    df = QUERIES[name](spark, SF)
    table, key = {"op7": ("pages", "page_id"), "op12": ("conversations", "conv_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    assert df.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().count()
    assert all("<" not in f.dataType.simpleString() for f in df.schema)
