"""Operators that SQL can express, against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from gistmill.llm import queries


@pytest.mark.parametrize("name", ["op11_conversation_prefix_trie", "op12_spelling_variants"])
def test_sql_gives_the_same_rows(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    got, want = queries.queries()[name](spark, data), con.execute(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in want.description)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    assert rows and rows == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)
