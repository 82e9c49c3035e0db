"""Every registered query against its SQL, on the smallest tables."""

import hashlib
import os
import re
import unicodedata
from collections import Counter
from html import unescape
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from gistmill.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if hasattr(x, "tolist") and getattr(x, "ndim", 0):
            return str([plain(y) for y in x.tolist()])
        if isinstance(x, list):
            return str([plain(y) for y in x])
        if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
            return "null"
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


#: Queries that SQL does not give, and the tests that hold them against something else.
ELSEWHERE = {
    "distinct_claims": "tests/test_functions.py", "page_text": "tests/test_functions.py", "top_terms": "tests/test_queries.py", "retrieval_hits_context": "tests/test_queries.py",
    "nearest_in_cells": "tests/test_retrieval.py", "verifier_extraction_metrics": "tests/test_experiment.py", "verifier_evidence_metrics": "tests/test_experiment.py", "verifier_calls": "tests/test_experiment.py",
}


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(SQL) == set(ELSEWHERE)
    assert all((Path(__file__).parents[1] / p).exists() for p in ELSEWHERE.values())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in ELSEWHERE:
        assert len(got)
    else:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_names_are_unique_and_entry_works(spark):
    import __spark_entry__ as entry

    assert set(SQL) <= set(QUERIES)
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_dice_of_whole_turns(spark, tmp_path):
    same = "ab" * 150
    turns = [(1, 0, same + "xyz" * 100), (1, 1, same + "uvw" * 100), (2, 0, ""), (2, 1, "")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r["dice"] for r in QUERIES["dice_turns"](spark, str(tmp_path)).collect()}
    a, b = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for _, _, t in (x[:3] for x in turns[:2]))
    assert got == {1: round(2 * (a & b).total() / (a.total() + b.total()), 6), 2: 1.0}


def test_context_of_ranked_hits(spark, tmp_path):
    text = lambda *lines: "\n".join(lines)
    docs = [
        (1, text("red mill wheel", "x " * 390), "en"), (2, text("other", "y " * 395, "red mill wheel"), "en"), (3, text("red mill", "red mill " * 60), "en"),
        (4, "nothing alike here", "en"), (5, "red mill wheel", "de"), (6, "wheel " * 400, "en"), (7, text("red", "red mill wheel " * 100), "en"),
    ]
    rows = [(i, t, lang, "s", len(t)) for i, t, lang in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["lang"]: r["context"] for r in QUERIES["retrieval_hits_context"](spark, str(tmp_path)).collect()}
    assert got["de"] == "[来源: s | red mill wheel]\nred mill wheel"
    parts = got["en"].split("\n\n---\n\n")
    chunks = [p.split("]\n", 1)[1] for p in parts]
    # the best hit is whole, though over 100 characters, and the lines of low doc_ids that are not alike are no hits
    assert parts[0].startswith("[来源: s | red]\n") and len(chunks[0]) > 1400
    assert sum(map(len, chunks)) <= 2000 and "nothing" not in got["en"]


def test_distinct_claims_by_the_plain_fold(spark, data, duck):
    quotes = duck.execute(SQL["rule_claims"]).df().sort_values(["conv_id", "start"])
    got = {r["conv_id"]: list(r["quotes"]) for r in QUERIES["distinct_claims"](spark, data).collect()}
    want: dict[int, list[str]] = {}
    for conv, quote in zip(quotes["conv_id"], quotes["quote"], strict=True):
        kept = want.setdefault(int(conv), [])
        if not any(len(set(quote) & set(k)) / len(set(quote) | set(k)) > 0.8 for k in kept):
            kept.append(quote)
    assert got == want


def test_page_text_by_plain_python(spark, data, duck):
    got = {r["page_id"]: r["digest"] for r in QUERIES["page_text"](spark, data).collect()}
    for i, html in duck.execute("SELECT page_id, html FROM pages WHERE html IS NOT NULL").fetchall():
        text = unicodedata.normalize("NFKC", unescape(re.sub(r"<[^>]+>", "", html)))
        assert got[i] == hashlib.md5(text.encode()).hexdigest()


def test_top_terms_are_frequent(spark, data, duck):
    exact: dict[str, Counter] = {}
    for lang, text in duck.execute("SELECT lang, text FROM documents WHERE text IS NOT NULL").fetchall():
        exact.setdefault(lang, Counter()).update(re.split(r"\s+", text))
    for r in QUERIES["top_terms"](spark, data).collect():
        most = [n for _, n in exact[r["lang"]].most_common(6)]
        assert exact[r["lang"]][r["item"]] >= most[-1] * 0.9
