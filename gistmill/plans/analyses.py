"""Queries of analyses by hooks, with their defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis as A
from ..session import load
from .registry import query


@query(f"""WITH k AS (SELECT DISTINCT c_mktsegment AS segment FROM customer UNION SELECT 'nothing there'), f AS (SELECT c_mktsegment AS segment, c_name || ' of ' || c_nationkey AS document, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS nth FROM customer),
  c AS (SELECT segment, string_agg(document, chr(10) || '---' || chr(10) ORDER BY nth) AS context, count(*) AS n FROM f WHERE nth <= 15 GROUP BY 1)
  SELECT segment, CASE WHEN n IS NULL THEN '{A.NOTHING.strip()}' || chr(10) ELSE n || ' passages, ' || length(context) || ' characters' END AS analysis FROM k LEFT JOIN c USING (segment)""")
def report_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    keywords = c.select(F.col("c_mktsegment").alias("segment")).distinct().unionByName(spark.createDataFrame([("nothing there",)], "segment string"))
    found = c.select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("rank"), F.concat("c_name", F.lit(" of "), F.col("c_nationkey")).alias("document"))
    return A.report_analyses(keywords, found, "segment")


#: Projects made of parts: the brand owns, the name is the project's, the size its stars.
PROJECTS = "projects AS (SELECT p_brand || '/' || replace(p_name, ' ', '-') || '-' || p_partkey AS full_name, p_type AS description, p_brand AS language, p_size AS stars, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS tags FROM part)"


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("p_brand", F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey"))
    return load(spark, sf_dir, "part").select(name.alias("full_name"), F.col("p_type").alias("description"), F.col("p_brand").alias("language"), F.col("p_size").alias("stars"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("tags"))


@query(f"""WITH {PROJECTS}, w AS (SELECT *, regexp_extract_all(lower(split_part(full_name, '/', 2)), '[a-z0-9]+') AS words FROM projects),
  d AS (SELECT *, list_filter(words, lambda x, i: list_position(words, x) = i)[1:5] AS tag_list FROM w)
  SELECT full_name, '[Trending] ' || full_name AS title, array_to_string(tag_list, ',') AS tags, '## ' || full_name || chr(10) || chr(10) || description || chr(10) || chr(10) || '### 技术亮点' || chr(10) || chr(10) || '- language: ' || language || chr(10) || '- stars: ' || stars
    || chr(10) || chr(10) || '### 应用场景' || chr(10) || chr(10) || chr(10) || chr(10) || '### 趋势分析' || chr(10) || chr(10) || description AS body FROM d""")
def trend_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.trend_pages(_projects(spark, sf_dir)).select("full_name", "title", F.array_join("tags", ",").alias("tags"), "body")


@query(f"""WITH {PROJECTS}, t AS (SELECT full_name, row_number() OVER (ORDER BY stars DESC, full_name) AS rank FROM projects), i AS (SELECT DISTINCT r_name AS interest FROM region)
  SELECT interest, CAST(rank AS INTEGER) AS rank, full_name AS title, interest AS rationale FROM i, t WHERE rank <= 5""")
def recommended_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.recommendations(_projects(spark, sf_dir).withColumnRenamed("stars", "period_stars"), load(spark, sf_dir, "region").select(F.col("r_name").alias("interest")))
    return found.select("interest", "rank", "title", "rationale")


@query(f"""SELECT p_partkey, p_name AS title, p_type AS problem, '{A.USER}' AS target, 'P0 {A.FEATURE["name"]} TBD' AS feature, '{A.STACK["frontend"]}' AS frontend, {A.HOURS} AS hours, {sum(A.BREAKDOWN.values())}::BIGINT AS total, '{A.RISK}' AS risk, '{A.MONEY}' AS monetization FROM part""")
def fallback_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("keyword"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.lit(None).cast("string").alias("scores"), F.array("p_brand").alias("requirements"))
    made = A.proposals(p, "p_partkey")
    feature = F.concat_ws(" ", F.col("mvp")[0]["priority"], F.col("mvp")[0]["name"], F.col("mvp")[0]["description"])
    total = F.aggregate(F.map_values("breakdown"), F.lit(0).cast("long"), lambda s, x: s + x)
    return made.select("p_partkey", "title", "problem", "target", feature.alias("feature"), "stack.frontend", "hours", total.alias("total"), F.col("risks")[0].alias("risk"), "monetization")
