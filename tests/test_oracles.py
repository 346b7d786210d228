"""Every query that has SQL, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(v) if isinstance(v, float) else str(v)


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return list(df.columns), sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, con, sf, name):
    assert rows(plans.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(plans.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["grey_plane", "dct_plane"])
def test_rounding_on_a_border(spark, tmp_path, name):
    """Item 2782 has a grey of exactly 100, times 0.7310585 the middle between two roundings to four places."""
    pd.DataFrame({"vec_id": [2782]}).to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert rows(plans.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(plans.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
