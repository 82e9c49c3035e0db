"""Queries of what leaves the engine: records, responses, feedback, test cases, proposals, marks of runs and corpora."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import models as M
from ..operators import outputs as O
from ..session import load
from . import standins as S
from .registry import query
from .texts import STRIP, WS


@query(f"""WITH {S.NEEDS}, r AS (SELECT *, CASE WHEN n_chars % 11 = 0 THEN body END AS error, CASE WHEN n_chars % 5 = 0 THEN 'too short' END AS reason, (n_chars % 10) / 10.0::DOUBLE AS c FROM needs)
  SELECT doc_id AS id, CASE WHEN coalesce(error, '') <> '' THEN 'error' WHEN reason IS NOT NULL THEN 'no' ELSE 'yes' END AS requirement_present,
  CASE WHEN coalesce(error, '') <> '' OR reason IS NOT NULL THEN '' ELSE title END AS title, '' AS description, '' AS pain_point, '' AS use_case,
  CASE WHEN coalesce(error, '') <> '' OR reason IS NOT NULL THEN 'mild' ELSE coalesce(sentiment, 'mild') END AS sentiment, 'neutral' AS emotion,
  CASE WHEN coalesce(error, '') <> '' THEN 0.0 ELSE c END AS confidence, CASE WHEN coalesce(error, '') <> '' OR reason IS NULL THEN '' ELSE reason END AS rejection_reason,
  left(coalesce(error, ''), 500) AS extraction_error, 'plain' AS configuration, FALSE AS hitl_edited FROM r""")
def prediction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    none = F.lit(None).cast("string")
    r = S.needs(spark, sf_dir).withColumns({"error": F.when(n % 11 == 0, F.col("body")), "reason": F.when(n % 5 == 0, "too short"), "confidence": (n % 10) / 10.0, "description": none, "pain_point": none, "use_case": none, "emotion": none})
    return O.predictions(r, "doc_id", "plain")


@query(f"""WITH {S.NEEDS} SELECT doc_id, title, left(body, 500) AS description, platform AS source_platform, coalesce(sentiment, 'moderate') AS sentiment,
  CASE WHEN n_chars % 3 = 0 THEN 'neutral' ELSE 'hopeful' END AS emotion, CASE WHEN n_chars % 2 = 0 THEN 0.0 ELSE 0.5 END AS confidence, 1 AS mention_count,
  CASE WHEN n_chars % 6 = 0 THEN '' ELSE lang || ', ' || platform END AS keyword FROM needs""")
def need_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    r = S.needs(spark, sf_dir).withColumns({"emotion": F.when(n % 3 == 0, "").otherwise("hopeful"), "confidence": F.when(n % 2 == 1, F.lit(0.5)), "mention_count": F.lit(None).cast("int"), "keywords": F.when(n % 6 != 0, F.array("lang", "platform"))})
    return O.responses(r)


#: Feedback made of events, and the documents as what was extracted and what a reviewer made of it.
FEEDBACK = """feedback AS (SELECT event_id AS id, ts AS created_at, user_id AS pipeline_run_id,
  CASE event_type WHEN 'click' THEN 'requirement_corrected' WHEN 'view' THEN 'requirement_rejected' WHEN 'purchase' THEN 'item_removed' ELSE 'item_added' END AS feedback_type FROM events)"""


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    named = F.when(kind == "click", "requirement_corrected").when(kind == "view", "requirement_rejected").when(kind == "purchase", "item_removed").otherwise("item_added")
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").alias("pipeline_run_id"), named.alias("feedback_type"))


@query(f"""WITH {FEEDBACK}, x AS (SELECT 'extraction' AS subset, * FROM (SELECT * FROM feedback WHERE feedback_type IN ('requirement_corrected', 'requirement_rejected') ORDER BY created_at DESC, id DESC LIMIT 50)
  UNION ALL SELECT 'noise', * FROM (SELECT * FROM feedback WHERE feedback_type IN ('item_removed', 'item_added') ORDER BY created_at DESC, id DESC LIMIT 50)
  UNION ALL SELECT 'run', * FROM (SELECT * FROM feedback WHERE pipeline_run_id = 7 ORDER BY created_at DESC, id DESC LIMIT 100)) SELECT subset, id, pipeline_run_id, feedback_type FROM x""")
def feedback_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _feedback(spark, sf_dir)
    parts = {"extraction": O.feedback(f, 50, O.EXTRACTION), "noise": O.feedback(f, 50, O.NOISE), "run": O.feedback(f, 100, run=7)}
    a, b, c = (p.select(F.lit(n).alias("subset"), "id", "pipeline_run_id", "feedback_type") for n, p in parts.items())
    return a.unionByName(b).unionByName(c)


@query("SELECT CASE WHEN n_chars % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE split_part(text, chr(10), 1) END AS title, CASE WHEN n_chars % 4 = 0 THEN '' ELSE lang END AS keyword, CAST(n_chars AS VARCHAR) AS created_at FROM documents")
def verifiable_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    keywords = F.when(n % 8 == 0, F.array().cast("array<string>")).when(n % 4 != 0, F.array("lang", "source"))
    d = load(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"), F.when(n % 3 != 0, F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"), keywords.alias("keywords"), n.alias("created_at"))
    return O.verifiable(d)


CASES = r"""WITH e AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) - 1 AS n FROM events WHERE event_type IN ('click', 'view') QUALIFY n < 200),
c AS (SELECT e.*, d.lang, d.source, split_part(d.text, chr(10), 1) AS first, d.n_chars % 11 AS tenths, d.n_chars FROM e JOIN documents d ON d.doc_id = e.event_id % 150 WHERE e.event_id % 13 <> 0)
SELECT 'feedback_' || event_id || '_' || n AS case_id, CASE WHEN event_id % 7 = 0 THEN first || ' x' ELSE lang || ' need' END AS title, first AS content, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE source END AS platform,
  CASE WHEN event_id % 2 = 0 THEN 'strong' ELSE 'mild' END AS sentiment, CAST(NULL AS VARCHAR) AS emotion,
  CASE WHEN event_id % 3 <> 0 THEN round(greatest(tenths / 10.0::DOUBLE - 0.1::DOUBLE, 0), 6) END AS confidence_min, CASE WHEN event_id % 3 <> 0 THEN round(least(tenths / 10.0::DOUBLE + 0.1::DOUBLE, 1), 6) END AS confidence_max,
  array_to_string(list_filter(string_split_regex(first || ' x', '\s+'), lambda w: length(w) > 1)[1:5], ' ') AS title_keywords, user_id AS reason FROM c"""


@query(CASES)
def derived_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _feedback(spark, sf_dir).withColumn("doc_id", F.col("id") % 150)
    i, first = F.col("id"), F.split_part("text", F.lit("\n"), F.lit(1))
    # the join brings a text for every record; what is newest is told before, as in the operator
    d = e.join(load(spark, sf_dir, "documents"), "doc_id")
    before = F.to_json(F.struct(F.when(i % 7 != 0, F.concat("lang", F.lit(" need"))).alias("title"), first.alias("description"), F.when(i % 5 != 0, F.col("source")).alias("platform"), F.lit("mild").alias("sentiment")))
    after = F.to_json(F.struct(F.concat(first, F.lit(" x")).alias("title"), F.when(i % 2 == 0, "strong").alias("sentiment"), F.when(i % 3 != 0, (F.col("n_chars") % 11) / 10.0).alias("confidence")))
    made = d.select("id", "created_at", "feedback_type", F.col("pipeline_run_id").alias("reason"), before.alias("before_json"), F.when(i % 13 != 0, after).alias("after_json"))
    return O.derived_cases(made).withColumn("title_keywords", F.array_join("title_keywords", " "))


@query("""SELECT c_custkey, c_custkey % 4 <> 0 AND c_nationkey % 5 <> 0 AS same, concat_ws(',', CASE WHEN c_custkey % 4 = 0 THEN 'dataset' END, CASE WHEN c_nationkey % 5 = 0 THEN 'model' END) AS changed FROM customer""")
def resumable_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    stored = c.select("c_custkey", F.col("c_name").alias("dataset"), F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment")).alias("model"), F.lit(None).cast("string").alias("pricing"))
    asked = c.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("dataset"), F.col("c_mktsegment").alias("model"), F.lit(None).cast("string").alias("pricing"))
    return O.resumable(stored, asked, "c_custkey", ["dataset", "model", "pricing"])


@query("""SELECT sha256(CAST(coalesce(sum(CAST(CAST('0x' || substr(sha256(doc_id || chr(31) || text || chr(31) || lang), 1, 15) AS BIGINT) AS HUGEINT)), 0) AS VARCHAR) || ':' || count(*)) AS corpus_sha256, count(*) AS corpus_records, 'needs' AS table_name, 'hash' AS embedding_backend FROM documents""")
def corpus_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.corpus_mark(load(spark, sf_dir, "documents"), ["doc_id", "text", "lang"], "needs", "hash")


@query("""SELECT o_custkey AS source_id, o_orderkey AS target_id, 'places' AS link_type, o_orderdate AS created_at, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 20""")
def edge_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id"), F.lit("places").alias("link_type"), F.col("o_orderdate").alias("created_at"), "o_orderstatus")
    return G.edge_page(o, "target_id", 2, 20, link_type="places", o_orderstatus="O", source_id=None).drop("o_orderstatus")


PROPOSALS = """p AS (SELECT p_partkey, p_name AS title, CASE WHEN p_size % 4 <> 0 THEN p_type END AS problem, p_brand AS target, CASE WHEN p_size % 3 <> 0 THEN 'Vue ' || p_size END AS frontend, CASE WHEN p_size % 6 <> 0 THEN p_type END AS backend,
  CASE WHEN p_size % 5 <> 0 THEN p_size END AS hours, '- [P0] ' || p_name || ': ' || p_type || chr(10) || '- [P1] ' || p_brand || ': ' AS features, '- **[P0] ' || p_name || '**: ' || p_type || chr(10) || '- **[P1] ' || p_brand || '**: ' AS bold_features,
  CASE WHEN p_size % 7 <> 0 THEN '{"build": ' || p_size || ', "test": 2}' END AS breakdown, CASE WHEN p_size % 2 <> 0 THEN '- ' || p_type || chr(10) || '- ' || p_brand END AS risks,
  CAST(NULL AS VARCHAR) AS database, CAST(NULL AS VARCHAR) AS hosting, CASE WHEN p_size % 9 <> 0 THEN 'small' END AS rationale, CASE WHEN p_size % 8 <> 0 THEN p_brand END AS monetization FROM part)"""


def _sql_text(template: str) -> str:
    """The template as DuckDB text: a chain of replacements of its marks, one by one."""
    out = "'" + template.replace("'", "''") + "'"
    for mark, name, default in dict.fromkeys(re.findall(r"(\{(\w+)(?:\|((?:[^{}]|\{\})*))?\})", template)):
        out = f"replace({out}, '{mark}', coalesce(CAST({name} AS VARCHAR), '{default}'))"
    return out


@query(f"WITH {PROPOSALS} SELECT p_partkey, {_sql_text(O.PROMPT)} AS prompt, {_sql_text(O.BODY)} AS body FROM p")
def proposal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, none = F.col("p_size"), F.lit(None).cast("string")
    feature = lambda p, a, b: F.struct(p.alias("priority"), a.alias("name"), b.alias("description"))
    p = load(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.when(n % 4 != 0, F.col("p_type")).alias("problem"), F.col("p_brand").alias("target"),
        F.array(feature(F.lit("P0"), F.col("p_name"), F.col("p_type")), feature(none, F.col("p_brand"), none)).alias("mvp"),
        F.struct(F.when(n % 3 != 0, F.concat(F.lit("Vue "), n.cast("string"))).alias("frontend"), F.when(n % 6 != 0, F.col("p_type")).alias("backend"), none.alias("database"), none.alias("hosting"), F.when(n % 9 != 0, F.lit("small")).alias("rationale")).alias("stack"),
        F.when(n % 5 != 0, n).alias("hours"), F.when(n % 7 != 0, F.create_map(F.lit("build"), n, F.lit("test"), F.lit(2))).alias("breakdown"),
        F.when(n % 2 != 0, F.array("p_type", "p_brand")).alias("risks"), F.when(n % 8 != 0, F.col("p_brand")).alias("monetization"),
    )
    return O.proposal_texts(p, "p_partkey")


@query("""WITH l AS (SELECT user_id AS run_id, event_type AS phase, CASE event_id % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'failed' END AS status, ts, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN props END AS result FROM events)
  SELECT run_id, phase, arg_max(status, {'t': ts, 's': seq}) AS status, max(ts) FILTER (status = 'running') AS started_at, max(ts) FILTER (status <> 'running') AS completed_at, arg_max(result, {'t': ts, 's': seq}) FILTER (result IS NOT NULL) AS result FROM l GROUP BY ALL""")
def phase_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    status = F.when(i % 3 == 0, "running").when(i % 3 == 1, "completed").otherwise("failed")
    return O.phase_states(load(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("phase"), status.alias("status"), "ts", i.alias("seq"), F.when(i % 4 == 0, F.col("props")).alias("result")))


@query(f"""WITH d AS (SELECT doc_id, text, list_filter(list_transform(list_filter(regexp_split_to_array(text, '[.!?。！？\\n]'), lambda x: regexp_matches(x, '\\d')), lambda x: {STRIP('x')}), lambda x: length(x) > 5) AS found FROM documents WHERE length(trim(text)) >= 50),
  q AS (SELECT doc_id, text, unnest(list_filter(found, lambda x, i: list_position(found, x) = i)[1:12]) AS quote FROM d), s AS (SELECT *, strpos(text, quote) - 1 AS start FROM q)
  SELECT doc_id, left(sha256(lower({STRIP(f"regexp_replace(quote, '{WS}+', ' ', 'g')")}) || chr(10) || chr(10) || start), 16) AS claim_id, quote, '' AS section, start, start + length(quote) AS "end" FROM s""")
def quoted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of whole documents by the default hook, with their places."""
    return M.extract_claims(load(spark, sf_dir, "documents"), "doc_id", "text").where("error = ''").drop("error")
