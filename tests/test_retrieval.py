"""The inverted file against exact search, and retrieval that falls back on words."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gistmill.functions import vectors as X
from gistmill.operators import retrieval as R
from gistmill.plans import QUERIES
from gistmill.session import load


def made(n, dims=16, seed=3, groups=12):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dims))
    return [(int(i), [float(v) for v in middle[i % groups] + rng.normal(scale=0.4, size=dims)]) for i in range(n)]


def exact(rows, queries, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, v in queries:
        q = np.array(v, np.float32).astype(float)
        s = np.round(x @ (q / np.linalg.norm(q)), 9)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [int(ids[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["key"])
    return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = made(3000)
    path = str(tmp_path_factory.mktemp("index"))
    df = spark.createDataFrame(rows, "id long, v array<double>")
    return R.Index.build(df, path, "id", "v", cells=40), rows, df


def test_all_cells_are_exact_and_some_reach_the_recall(spark, index):
    ix, rows, df = index
    asked = df.where("id % 50 = 0")
    want = exact(rows, [r for r in rows if r[0] % 50 == 0], 10)
    assert found(ix.search(asked, "id", "v", 10, 40, part=100, asked=7)) == want
    got = found(ix.search(asked, "id", "v", 10, 10))
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / sum(map(len, want.values())) >= 0.9


def test_fewer_probes_read_fewer_files(spark, index):
    ix, _, df = index
    asked = df.where("id = 0")
    cells = R.usable(asked, "id", "v").mapInArrow(R._nearest_cells(ix.middle, 3), "key long, vector array<float>, cells array<int>").first()["cells"]
    some = ix.vectors(sorted(cells))
    assert {r["cell"] for r in some.select("cell").distinct().collect()} == set(cells)
    pruned = some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "cell" in pruned and "IN" in pruned
    # all cells have files of their own, so what is read falls with the probes
    read = lambda frame: {f for r in frame.select(F.input_file_name().alias("f")).distinct().collect() for f in [r["f"]]}
    assert 0 < len(read(some)) < len(read(ix.vectors())) / 5


def test_odd_vectors_added_rows_and_empty_tables(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    ix = R.Index.build(df, f"{tmp_path}/a", "id", "v", cells=5)
    assert found(ix.search(df, "id", "v", 3, 9)) == {1: [7, 7, 2], 2: [1, 7, 7], 7: [1, 2]}
    ix.add(spark.createDataFrame([(9, [2.0, 0.1])], "id long, v array<double>"), "id", "v")
    assert found(ix.search(df.where("id = 1"), "id", "v", 3, 9)) == {1: [7, 7, 9]}
    assert ix.search(df.where("id = 4"), "id", "v").count() == 0
    empty = R.Index.build(df.where("false"), f"{tmp_path}/b", "id", "v")
    assert empty.search(df, "id", "v").count() == 0


def test_recall_of_the_registered_query(spark, data):
    got = {(r["query_id"], r["vec_id"]) for r in QUERIES["nearest_in_cells"](spark, data).collect()}
    want = {(r["query_id"], r["vec_id"]) for r in QUERIES["nearest_in_all_cells"](spark, data).collect()}
    assert len(got & want) / len(want) >= 0.9


def test_embedding_hook(spark):
    rows = spark.createDataFrame([(1, "Alpha beta"), (2, None), (3, "alpha  BETA")], "id long, t string")
    got = {r["id"]: r["embedding"] for r in R.embedded(rows, "t", batch=2).collect()}
    assert got[1] == got[3] and len(got[1]) == 384 and abs(sum(x * x for x in got[1]) - 1) < 1e-6 and not any(got[2])
    own = R.embedded(rows, "t", lambda texts: np.array([[len(t), 1] for t in texts])).select("embedding").collect()
    assert [r[0] for r in own] == [[10, 1], [0, 1], [11, 1]]


def test_queries_without_hits_fall_back_on_words(spark):
    rows = spark.createDataFrame([(1, "Slow CI", "x"), (2, "other", "ci is slow"), (3, None, None), (4, "[a|b]", "slow")], "id long, title string, body string")
    hits = spark.createDataFrame([("q1", 1, 9, 0.5)], "query_id string, rank int, key long, score double")
    asked = spark.createDataFrame([("q1", "slow"), ("q2", "CI"), ("q3", "none such"), ("q4", "slow")], "query_id string, word string")
    got = R.with_fallback(hits, rows, asked, "id", F.col("title"), F.col("body"), most=2)
    assert sorted((r["query_id"], r["rank"], r["key"], r["score"]) for r in got.collect()) == [("q1", 1, 9, 0.5), ("q2", 1, 1, None), ("q2", 2, 2, None), ("q4", 1, 1, None), ("q4", 2, 2, None)]
    assert rows.select(R.need_link(F.col("title")).alias("l")).where("id = 4").first()["l"] == "[[02-需求池/(a-b)|(a-b)]]"


def test_vectors_within_rows_are_those_of_the_shuffled_ones(spark, data):
    d = load(spark, data, "documents").where("text IS NOT NULL").select("lang", "doc_id", "text", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    asked = d.groupBy("lang").agg(F.min_by("title", "doc_id").alias("asked"))
    got = R.nearest_texts(d.select("lang", "doc_id", "text"), "text", asked, "asked", "lang", 20, 0.1)
    whole = X.hash_embedding(d.withColumn("key", F.struct("lang", "doc_id")), "key", "text").select("key.lang", "key.doc_id", "bucket", "weight")
    want = X.nearest_sparse(whole, X.hash_embedding(asked, "lang", "asked"), "doc_id", "lang", 20, 0.1)
    rounded = lambda rows: sorted((r["lang"], r["doc_id"], round(r["score"], 6)) for r in rows.collect())
    assert rounded(got) == rounded(want) and got.count()
