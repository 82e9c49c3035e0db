"""Steps that must not be done over again, or grow faster than their texts."""

import random
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from gistmill.functions import text as T
from gistmill.operators import analysis as A
from gistmill.operators import experiment as X
from gistmill.operators import joins as J
from gistmill.operators import models as M
from gistmill.operators import retrieval as R


def counting(spark, column):
    """The column through a function that counts its calls, and the count."""
    calls = spark.sparkContext.accumulator(0)

    def same(x):
        calls.add(1)
        return x

    return F.udf(same, "string")(column), calls


def test_pain_point_takes_time_in_proportion():
    old = re.compile(r"(?i)[^.\n]*\b(?:cannot|can't|fails?|slow|broken|missing)\b[^.\n]*")
    rng = random.Random(3)
    for _ in range(2000):
        t = "".join(rng.choice(["slow", "fails", "can't", "Broken", "a", " ", ".", "\n", "x", "'"]) for _ in range(rng.randint(0, 25)))
        m = old.search(t)
        assert M._pain(t) == (m[0] if m else "")
    began = time.perf_counter()
    assert M.rule_extractor(["word " * 40_000])[0]["pain_point"] == ""
    assert time.perf_counter() - began < 2


def test_strip_takes_white_space_of_all_kinds(spark):
    texts = [a + "x \t y" + b for a in ("", T.WHITE, "\x1c", "﻿") for b in ("", T.WHITE[::-1], "\n", "​")] + ["", T.WHITE, " \x85　"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", T.strip(F.col("t")).alias("got"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("want")).collect():
        assert r["got"] == r["want"]


def test_a_discussion_is_judged_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"title {i}", f"a discussion of number {i} " * 5) for i in range(20)], "id long, title string, content string")
    content, calls = counting(spark, F.col("content"))
    contexts = spark.createDataFrame([(1, "c")], "id long, context string")
    gold = spark.createDataFrame([(1, "yes", "", "", "", "", "", "")], "id long, present string, " + ", ".join(f"{c} string" for c in (*X.TEXTS, *X.MOODS)))
    hook = lambda texts: ['{"title": "t"}'] * len(texts)
    got = X.discussion_experiment(rows.withColumn("content", content), contexts, gold, X.Store(spark, f"{tmp_path}/store"), hook)
    assert len(got.collect()) == 60 and calls.value == 20


def test_claims_of_a_report_are_folded_once(spark, tmp_path):
    source = "array(named_struct('platform', 'github', 'title', 't', 'content', 'c'))"
    rows = spark.range(20).selectExpr("cast(id AS string) AS id", "concat('body of number ', id, '. More of 7.') AS report_body", f"{source} AS sources")
    quote, calls = counting(spark, F.concat(F.lit("quote of "), F.col("id")))
    rule = F.array(F.struct(quote.alias("quote"), F.lit("s").alias("section")))
    got = X.verifier_experiment(rows, X.Store(spark, f"{tmp_path}/store"), M.claims_as_json, M.checks_as_json, M.consistency_by_words, rule)
    assert len(got["extraction"].collect()) == 60 and len(got["evidence"].collect()) == 80 and calls.value == 20


def test_inputs_are_taken_a_few_at_a_time():
    rows = pa.record_batch({"fingerprint": list("abcde"), "input": list("vwxyz")})
    got = X._asking(lambda inputs: [x.upper() for x in inputs], 2)(iter([rows]))
    assert [b.to_pydict()["result"] for b in got] == [["V", "W"], ["X", "Y"], ["Z"]]


def test_chunks_stay_where_they_are_scored(spark):
    rows = spark.createDataFrame([(i, "en", "red mill " * i) for i in range(1, 5)], "id long, lang string, chunk string")
    asked = spark.createDataFrame([("en", "mill"), ("de", "")], "lang string, asked string").groupBy("lang").agg(F.min("asked").alias("asked"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sizes that the planner cannot tell
    try:
        got = R.nearest_texts(rows, "chunk", asked, "asked", "lang", 2)
        assert "SortMergeJoin" not in got._jdf.queryExecution().sparkPlan().toString()
        assert [(r["id"], r["score"]) for r in got.orderBy("id").collect()] == [(1, 0.707106781), (2, 0.707106781)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_titles_of_any_length_are_looked_up(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeß\U0001f600") for _ in range(rng.randint(1, 4)))
    docs = [(f"{i:02}.md", " ".join(word() for _ in range(rng.randint(1, 4)))) for i in range(60)] + [("long.md", " ".join(word() for _ in range(60_000)))]
    asked = [w for _ in range(30) if (w := word())] + ["ab cd e", "nothing at all"]
    began = time.perf_counter()
    got = {r["title"]: (r["filename"], r["tier"]) for r in J.by_title(spark.createDataFrame([(a,) for a in asked], "title string"), spark.createDataFrame(docs, "filename string, title string")).collect()}
    assert time.perf_counter() - began < 60
    want = {}
    for a in asked:
        found = [(2 if a == t else 3, f) for f, t in docs if a == t or a in t or t in a]
        if found:
            want[a] = min(found)[::-1]
    assert got == want


def test_rows_of_one_file_are_asked_in_many_tasks(spark, tmp_path):
    spark.range(400).selectExpr("concat('o/', id) AS full_name", "'d' AS description", "'l' AS language", "1 AS stars").coalesce(1).write.parquet(f"{tmp_path}/p")
    got = A.asked(spark.read.parquet(f"{tmp_path}/p"), "full_name", F.col("full_name"), lambda texts: texts)
    assert got.count() == 400 and got.rdd.getNumPartitions() == 4
