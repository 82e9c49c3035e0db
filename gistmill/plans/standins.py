"""Views of the given tables in the shape that the operators work on, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load

#: Usage records made of events: the number in props gives tokens, the user the model and the cached part.
USAGE = """usage AS (SELECT event_id, ts AS created_at, event_type AS call_type, user_id,
  CASE user_id % 3 WHEN 0 THEN 'deepseek-v4-pro' WHEN 1 THEN 'deepseek-v4-flash' ELSE 'other' END AS model,
  k * 100 AS input_tokens, k * 10 AS output_tokens, k * (user_id % 5) * 20 AS cached_tokens, k * 110 AS total_tokens, value / 1000 AS cost
  FROM (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events))"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    model = F.when(F.col("user_id") % 3 == 0, "deepseek-v4-pro").when(F.col("user_id") % 3 == 1, "deepseek-v4-flash").otherwise("other")
    e = load(spark, sf_dir, "events").withColumn("k", k)
    return e.select("event_id", F.col("ts").alias("created_at"), F.col("event_type").alias("call_type"), "user_id", model.alias("model"), (F.col("k") * 100).alias("input_tokens"), (F.col("k") * 10).alias("output_tokens"), (F.col("k") * (F.col("user_id") % 5) * 20).alias("cached_tokens"), (F.col("k") * 110).alias("total_tokens"), (F.col("value") / 1000).alias("cost"))


#: Needs made of documents: the first line is the title, source the platform, the length of the text the sentiment.
NEEDS = """needs AS (SELECT doc_id, source AS platform, lang, split_part(text, chr(10), 1) AS title, text AS body, n_chars,
  CASE WHEN n_chars % 4 = 0 THEN 'strong' WHEN n_chars % 4 = 1 THEN 'moderate' WHEN n_chars % 4 = 2 THEN 'mild' ELSE NULL END AS sentiment FROM documents)"""


def needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    mood = F.when(F.col("n_chars") % 4 == 0, "strong").when(F.col("n_chars") % 4 == 1, "moderate").when(F.col("n_chars") % 4 == 2, "mild")
    return load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("platform"), "lang", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("body"), "n_chars", mood.alias("sentiment"))


#: Gold and predicted presence made of labels: quality is gold, a rule on the length the prediction.
JUDGED = """judged AS (SELECT l.doc_id, d.source AS platform, d.lang AS content_type, CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS gold,
  CASE WHEN d.n_chars < 200 THEN 'error' WHEN d.n_chars % 5 < 4 THEN 'yes' ELSE 'no' END AS predicted,
  CASE WHEN l.toxic = 1 THEN 'negative' ELSE 'neutral' END AS g_sentiment, CASE WHEN d.n_chars % 7 = 0 THEN 'negative' ELSE 'neutral' END AS p_sentiment,
  CASE WHEN d.n_chars % 2 = 0 THEN 'calm' ELSE 'upset' END AS g_emotion, CASE WHEN d.n_chars % 3 = 0 THEN 'calm' ELSE 'upset' END AS p_emotion,
  d.n_chars, l.toxic FROM labels l JOIN documents d USING (doc_id))"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents"), "doc_id")
    n = F.col("n_chars")
    pick = lambda c, a, b: F.when(c, a).otherwise(b)
    return j.select(
        "doc_id", F.col("source").alias("platform"), F.col("lang").alias("content_type"), pick(F.col("quality") == 1, "yes", "no").alias("gold"),
        F.when(n < 200, "error").when(n % 5 < 4, "yes").otherwise("no").alias("predicted"),
        pick(F.col("toxic") == 1, "negative", "neutral").alias("g_sentiment"), pick(n % 7 == 0, "negative", "neutral").alias("p_sentiment"),
        pick(n % 2 == 0, "calm", "upset").alias("g_emotion"), pick(n % 3 == 0, "calm", "upset").alias("p_emotion"), "n_chars", "toxic",
    )


#: Edges made of orders: customer - places -> order, order - ships_to -> nation.
EDGES = """edges AS (SELECT 'customer' AS source_type, CAST(o_custkey AS VARCHAR) AS source_id, 'places' AS link_type, 'order' AS target_type, CAST(o_orderkey AS VARCHAR) AS target_id FROM orders
  UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'lives_in', 'nation', CAST(c_nationkey AS VARCHAR) FROM customer)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    o = load(spark, sf_dir, "orders").select(F.lit("customer").alias("source_type"), text("o_custkey").alias("source_id"), F.lit("places").alias("link_type"), F.lit("order").alias("target_type"), text("o_orderkey").alias("target_id"))
    c = load(spark, sf_dir, "customer").select(F.lit("customer").alias("source_type"), text("c_custkey").alias("source_id"), F.lit("lives_in").alias("link_type"), F.lit("nation").alias("target_type"), text("c_nationkey").alias("target_id"))
    return o.unionByName(c)


#: Claims made of order lines: an order is a report, the line's status its verdict, the discount its confidence.
CLAIMS = """claims AS (SELECT l_orderkey AS report_id, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'hallucination' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'partially' WHEN l_linenumber % 4 = 0 THEN 'contradicted' WHEN l_linenumber % 4 = 1 THEN 'supported' ELSE 'unverifiable' END AS verdict,
  l_discount * 10 AS confidence, l_quantity FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_discount) AS l_discount, min(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber))"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    verdict = F.when(F.col("l_returnflag") == "R", "hallucination").when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "partially").when(n % 4 == 0, "contradicted").when(n % 4 == 1, "supported").otherwise("unverifiable")
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_discount", "l_quantity")))
    return lines.select(F.col("l_orderkey").alias("report_id"), n, verdict.alias("verdict"), (F.col("l_discount") * 10).alias("confidence"), "l_quantity")
