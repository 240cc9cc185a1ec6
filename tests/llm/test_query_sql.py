"""The registered queries that SQL can express, on the smallest tables, against DuckDB."""

from numbers import Number

import duckdb
import pandas as pd
import pytest

from panelyard.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(df):
    one = lambda v: "~" if pd.isna(v) else f"{float(v):.6f}" if isinstance(v, Number) and not isinstance(v, bool) else str(v)
    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert normal(got) == normal(want)


def test_null_ids_by_sql(spark, duck, tmp_path):
    """Rows without an id, in groups with and without one that has an id."""
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(5, text), (None, text), (None, text + " more"), (None, "only this one here"), (None, "only this one here"), (3, "another"), (None, None), (None, "")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got, want = queries.op5_jaccard_join(spark, str(tmp_path)).toPandas(), con.execute(queries.OP5_SQL).df()
    assert normal(got) == normal(want) and len(got) == len(rows)
