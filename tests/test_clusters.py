"""Greedy clusters in rounds against the loop that they stand for."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gistmill.operators import claims as C


def loop(rows):
    out, groups = {}, {}
    for by, key, title in rows:
        groups.setdefault(by, []).append((key, {w for w in (title or "").lower().split() if len(w) >= 3}))
    for by, items in groups.items():
        items.sort()
        found = []  # (words of the seed, members)
        for key, words in items:
            for seed, members in found:
                if seed & words:
                    members.append(key)
                    break
            else:
                found.append((words, [key]))
        if len(items) <= 3:
            found = [(set(), [k for k, _ in items])]
        if len(found) > 8:
            order = sorted(range(len(found)), key=lambda i: (-len(found[i][1]), i))
            rank = {i: min(n, 7) for n, i in enumerate(order)}
        else:
            rank = {i: i for i in range(len(found))}
        for i, (_, members) in enumerate(found):
            for k in members:
                out[by, k] = rank[i]
    return out


def got(spark, rows):
    df = spark.createDataFrame(rows, "g string, k int, t string")
    return {(r["g"], r["k"]): r["cluster"] for r in C.seed_clusters(df, "g", "k", "t").collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_titles(spark, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range([6, 30, 90][seed])] + ["of", "a"]
    rows = [(rng.choice("abcd"), k, " ".join(rng.sample(words, rng.randrange(0, 4))) or None) for k in range(150)] + [("few", 1000, "x"), ("few", 1001, "y"), ("few", 1002, None)]
    rng.shuffle(rows)
    assert got(spark, rows) == loop(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.lists(st.sampled_from(["one", "two", "three", "four", "five"]), max_size=3)), min_size=1, max_size=14))
def test_any_titles(spark, items):
    rows = [(g, k, " ".join(w)) for k, (g, w) in enumerate(items)]
    assert got(spark, rows) == loop(rows)


def test_a_chain_of_titles_and_no_rows(spark):
    rows = [("g", k, f"link{k} link{k + 1}") for k in range(12)]
    assert got(spark, rows) == loop(rows)
    assert C.seed_clusters(spark.createDataFrame([], "g string, k int, t string"), "g", "k", "t").count() == 0
