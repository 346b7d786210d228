"""The corpus operators that SQL can express, against DuckDB on the tables and on a table of odd texts."""

import os

import duckdb
import pytest

from tessera.llm import queries

ODD = [
    (None, None), (1, ""), (1, ""), (2, "Under the MIT License under the MIT license."), (3, "CC BY-NC, cc by nc CC-BY-NC-SA"), (4, "APACHE LICENSE VERSION 2 éİ K"),
    (5, "cc by nc nd; gnu general public license version 3\nall rights reserved"), (6, "x " * 5000 + "under the mit license"), (7, "# $ % a a a a a a a a a a a a a"), (8, "line\nline\n \n\nline"), (9, "The of and to in is you that it he"),
]
TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|> <\\|x <\\\\|y"), (1, 2, "assistant", None), (2, 1, "assi\\st\nant", "a"), (2, 0, None, "b"), (3, 0, "assistant", ""), (4, 0, "user", "\U0001f600é"),
    (None, 0, "user", "no id"), (1, 0, "user", "hi"), (1, 0, "user", "ha"),
]


def plain(v):
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return v


def same(spark_rows, con, sql):
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = [plain(dict(zip(names, r))) for r in result.fetchall()]
    got = [plain(r) for r in spark_rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_tables(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    same(queries.QUERIES[name](spark, sf).collect(), con, queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_odd_rows(spark, tmp_path, name):
    spark.createDataFrame(ODD, "doc_id long, text string").coalesce(1).write.parquet(os.path.join(tmp_path, "documents.parquet"))
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(os.path.join(tmp_path, "conversations.parquet"))
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    same(queries.QUERIES[name](spark, str(tmp_path)).collect(), con, queries.ORACLE_SQL[name])
