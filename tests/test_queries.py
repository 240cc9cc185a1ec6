"""Every query with SQL, on the smallest tables, against DuckDB."""

from numbers import Number

import duckdb
import pandas as pd
import pytest

from panelyard.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {n for n in registry.ORACLE_SQL if n.startswith("alpha_")} - {"alpha_001", "alpha_012", "alpha_026", "alpha_029", "alpha_048", "alpha_081", "alpha_096", "alpha_101"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)

    def one(v):
        if pd.isna(v):
            return "~"
        if isinstance(v, Number) and not isinstance(v, bool):
            return f"{float(v) + 0.0:.6f}"
        return str(v)[:19].removesuffix(" 00:00:00")

    return sorted(tuple(one(v) for v in row) for row in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE_SQL) - SLOW))
def test_against_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and normal(got) == normal(want)
