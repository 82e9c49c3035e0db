"""Queries of usage, cost, distributions and quality rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import aggregates as A
from ..operators import claims as C
from ..operators import evaluation as E
from ..operators import filters as P
from ..operators import joins as J
from ..session import load
from . import standins as S
from .registry import query

ANCHOR = "TIMESTAMP '2024-01-30 00:00:00'"


@query(f"""WITH {S.USAGE}, s AS (SELECT count(*) AS requests, coalesce(sum(input_tokens), 0) AS i, coalesce(sum(output_tokens), 0) AS o, coalesce(sum(cached_tokens), 0) AS c, coalesce(sum(total_tokens), 0) AS t, coalesce(round(sum(cost), 4), 0.0) AS cost
  FROM usage WHERE created_at >= {ANCHOR} - INTERVAL 14 DAY)
  SELECT requests, CAST(i AS BIGINT) AS input_tokens, CAST(o AS BIGINT) AS output_tokens, CAST(c AS BIGINT) AS cached_tokens, CAST(t AS BIGINT) AS total_tokens, cost, CASE WHEN i > 0 THEN round(CAST(c AS DOUBLE) / CAST(i AS DOUBLE) * 100, 1) ELSE 0.0 END AS cache_hit_rate, round(CAST(c AS DOUBLE) * 1e-6, 4) AS saved FROM s""")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.usage_summary(P.since(S.usage(spark, sf_dir), "created_at", F.expr(ANCHOR), 14))


@query(f"WITH {S.USAGE} SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost FROM usage GROUP BY 1")
def usage_daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.daily_trend(S.usage(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


@query(f"WITH {S.USAGE} SELECT model, call_type, count(*) AS requests, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost, round(avg(cost), 6) AS avg_cost FROM usage GROUP BY model, call_type")
def usage_model_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.model_stats(S.usage(spark, sf_dir))


@query(f"""WITH {S.USAGE}, a AS (SELECT {ANCHOR} AS t), s AS (SELECT 'day' AS period, round(coalesce(sum(cost) FILTER (created_at >= date_trunc('day', t)), 0), 4) AS spent, 0.5 AS budget FROM usage, a
  UNION ALL SELECT 'month', round(coalesce(sum(cost) FILTER (created_at >= date_trunc('month', t)), 0), 4), 2.0 FROM usage, a)
  SELECT period, spent, CAST(budget AS DOUBLE) AS budget FROM s WHERE spent >= budget""")
def budget_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.budget_alerts(S.usage(spark, sf_dir), F.expr(ANCHOR), {"day": 0.5, "month": 2.0})


@query(f"WITH {S.USAGE} SELECT event_id, round((greatest(input_tokens - cached_tokens, 0) * CASE model WHEN 'deepseek-v4-pro' THEN 3.0 WHEN 'deepseek-v4-flash' THEN 1.008 ELSE 0.0 END + cached_tokens * CASE model WHEN 'deepseek-v4-pro' THEN 0.025 WHEN 'deepseek-v4-flash' THEN 0.02 ELSE 0.0 END + output_tokens * CASE model WHEN 'deepseek-v4-pro' THEN 6.0 WHEN 'deepseek-v4-flash' THEN 2.016 ELSE 0.0 END)::DOUBLE / 1e6, 9) AS cost, round(least(cached_tokens, input_tokens) * CASE model WHEN 'deepseek-v4-pro' THEN 2.975 WHEN 'deepseek-v4-flash' THEN 0.988 ELSE 0.0 END::DOUBLE / 1e6, 9) AS saving FROM usage")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, i, o, c = (F.col(x) for x in ("model", "input_tokens", "output_tokens", "cached_tokens"))
    return S.usage(spark, sf_dir).select("event_id", V.cost(m, i, o, c, digits=9).alias("cost"), F.round(V.cache_saving(m, i, c), 9).alias("saving"))


@query(f"""WITH {S.NEEDS}, f AS (SELECT 'platform' AS field, coalesce(nullif(platform, ''), 'unknown') AS value FROM needs UNION ALL SELECT 'sentiment', coalesce(nullif(sentiment, ''), 'moderate') FROM needs UNION ALL SELECT 'lang', coalesce(nullif(lang, ''), 'unknown') FROM needs)
  SELECT field, value, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY field) * 100, 1) AS pct FROM f GROUP BY field, value""")
def field_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distributions(S.needs(spark, sf_dir), {"platform": "unknown", "sentiment": "moderate", "lang": "unknown"})


@query("""WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS value, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents)
  SELECT value, count(*) AS count FROM t GROUP BY value ORDER BY count DESC, min((doc_id, pos)) LIMIT 10""")
def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_values(load(spark, sf_dir, "documents"), F.split("text", " "), 10, F.col("doc_id"))


@query("SELECT coalesce(nullif(regexp_extract(url, 'example\\.net/([a-z]{2})/', 1), ''), 'unknown') AS language, count(*) AS count FROM pages GROUP BY 1")
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.coalesce(F.nullif(F.regexp_extract("url", r"example\.net/([a-z]{2})/", 1), F.lit("")), F.lit("unknown"))
    return load(spark, sf_dir, "pages").groupBy(lang.alias("language")).agg(F.count(F.lit(1)).alias("count"))


@query("SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS date FROM events ORDER BY 1 DESC LIMIT 30")
def latest_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct().orderBy(F.desc("date")).limit(30).select(F.col("date").cast("string"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS approved, count(*) FILTER (o_orderstatus = 'O') AS awaiting, count(*) FILTER (o_orderstatus = 'P') AS rejected FROM orders")
def agent_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return A.counts_by(load(spark, sf_dir, "orders"), [], approved=s == "F", awaiting=s == "O", rejected=s == "P")


@query(f"WITH {S.NEEDS} SELECT platform, count(*) AS count, round(avg(CASE sentiment WHEN 'strong' THEN 1.0 WHEN 'moderate' THEN 0.6 WHEN 'mild' THEN 0.3 ELSE 0.5 END), 2) AS sentiment, arg_min(title, doc_id) AS title FROM needs GROUP BY platform")
def traction_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.traction(S.needs(spark, sf_dir), "platform", "sentiment", "title", "doc_id")


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (coalesce(o_totalprice > 100000, TRUE)) AS approved, round(count(*) FILTER (coalesce(o_totalprice > 100000, TRUE)) / count(*), 4) AS rate FROM orders GROUP BY 1")
def platform_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rates_by(load(spark, sf_dir, "orders"), ["o_orderpriority"], F.coalesce(F.col("o_totalprice") > 100000, F.lit(True)))


CONFUSION = """count(*) AS n, count(*) FILTER (gold = 'yes' AND predicted = 'yes') AS true_positive, count(*) FILTER (gold = 'no' AND predicted = 'no') AS true_negative, count(*) FILTER (gold = 'no' AND predicted = 'yes') AS false_positive, count(*) FILTER (gold = 'yes' AND predicted = 'no') AS false_negative, count(*) FILTER (predicted = 'error') AS error,
  round(count(*) FILTER (gold = predicted) / count(*), 6) AS accuracy FROM judged"""


@query(f"WITH {S.JUDGED} SELECT {CONFUSION}")
def presence_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(S.judged(spark, sf_dir), []).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {S.JUDGED} SELECT platform, {CONFUSION} GROUP BY platform")
def platform_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(S.judged(spark, sf_dir), ["platform"]).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH {S.JUDGED}, g AS (SELECT 'platform' AS grouping, platform AS value, * FROM judged UNION ALL SELECT 'content_type', content_type, * FROM judged),
  m AS (SELECT grouping, value, unnest([
    struct_pack(name := 'false_positive_requirement', count := count(*) FILTER (gold = 'no' AND predicted = 'yes'), total := count(*) FILTER (gold = 'no')),
    struct_pack(name := 'false_negative_requirement', count := count(*) FILTER (gold = 'yes' AND predicted = 'no'), total := count(*) FILTER (gold = 'yes')),
    struct_pack(name := 'sentiment_mismatch', count := count(*) FILTER (gold = 'yes' AND predicted = 'yes' AND g_sentiment <> p_sentiment), total := count(*) FILTER (gold = 'yes' AND predicted = 'yes')),
    struct_pack(name := 'emotion_mismatch', count := count(*) FILTER (gold = 'yes' AND predicted = 'yes' AND g_emotion <> p_emotion), total := count(*) FILTER (gold = 'yes' AND predicted = 'yes'))]) AS r FROM g GROUP BY grouping, value)
  SELECT grouping, value, r.name AS name, r.count AS count, r.total AS total, round(r.count / r.total, 6) AS rate FROM m WHERE r.count > 0""")
def failure_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.failure_modes(S.judged(spark, sf_dir), ["platform", "content_type"], ["sentiment", "emotion"]).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {S.JUDGED}, f AS (SELECT 'sentiment' AS field, g_sentiment = p_sentiment AS ok FROM judged UNION ALL SELECT 'emotion', g_emotion = p_emotion FROM judged UNION ALL SELECT 'present', gold = predicted FROM judged)
  SELECT field, count(*) FILTER (ok) AS agreed, count(*) AS total, round(count(*) FILTER (ok) / count(*), 6) AS rate FROM f GROUP BY field""")
def field_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = S.judged(spark, sf_dir)
    a = j.select("doc_id", F.col("gold").alias("present"), F.col("g_sentiment").alias("sentiment"), F.col("g_emotion").alias("emotion"))
    b = j.select("doc_id", F.col("predicted").alias("present"), F.col("p_sentiment").alias("sentiment"), F.col("p_emotion").alias("emotion"))
    return E.field_agreement(J.compare_fields(a, b, "doc_id", ["sentiment", "emotion", "present"])).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {S.NEEDS}, t AS (SELECT regexp_replace(replace(lower(title), 'ß', 'ss'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', '', 'g') AS t FROM needs), c AS (SELECT t, count(*) AS n FROM t GROUP BY t)
  SELECT CAST(sum(CASE WHEN t <> '' THEN n - 1 ELSE 0 END) AS BIGINT) AS duplicates, CAST(sum(n) AS BIGINT) AS rows, round(sum(CASE WHEN t <> '' THEN n - 1 ELSE 0 END) / sum(n), 6) AS rate FROM c""")
def duplicate_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.duplicate_titles(S.needs(spark, sf_dir), "title").withColumn("rate", F.round("rate", 6))


AUROC = """p AS (SELECT toxic = 1 AS label, CAST(n_chars AS DOUBLE) AS risk FROM judged), r AS (SELECT label, rank() OVER (ORDER BY risk) + (count(*) OVER (PARTITION BY risk) - 1) / 2.0 AS k FROM p)
  SELECT round((sum(k) FILTER (label) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2.0) / (count(*) FILTER (label) * count(*) FILTER (NOT label)), 6) AS auroc FROM r"""


@query(f"WITH {S.JUDGED}, {AUROC}")
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = S.judged(spark, sf_dir).select((F.col("toxic") == 1).alias("label"), F.col("n_chars").cast("double").alias("risk"))
    return E.auroc(j, "label", "risk").withColumn("auroc", F.round("auroc", 6))


@query(f"""WITH {S.JUDGED}, p AS (SELECT CAST(n_chars AS DOUBLE) AS risk, count(*) FILTER (toxic = 1) AS pos, count(*) AS n FROM judged GROUP BY 1),
  w AS (SELECT pos, sum(pos) OVER (ORDER BY risk DESC) AS found, sum(n) OVER (ORDER BY risk DESC) AS rank FROM p) SELECT round(sum(pos * found / rank) / sum(pos), 6) AS average_precision FROM w""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = S.judged(spark, sf_dir).select((F.col("toxic") == 1).alias("label"), F.col("n_chars").cast("double").alias("risk"))
    return E.average_precision(j, "label", "risk").withColumn("average_precision", F.round("average_precision", 6))


@query(f"""WITH {S.CLAIMS}, c AS (SELECT report_id, round(avg(CASE verdict WHEN 'supported' THEN 100.0 WHEN 'partially' THEN 60.0 WHEN 'unverifiable' THEN 40.0 WHEN 'contradicted' THEN 15.0 ELSE 0.0 END * confidence + 50 * (1 - confidence)), 6) AS fact, count(*) FILTER (verdict = 'hallucination') AS h, count(*) FILTER (verdict IN ('hallucination', 'contradicted')) AS f FROM claims GROUP BY 1)
  SELECT o_orderkey AS report_id, coalesce(fact, 50.0) AS fact, round(coalesce(fact, 50.0) * 0.45::DOUBLE + (o_orderkey % 100) * 0.30::DOUBLE + (o_custkey % 100) * 0.25::DOUBLE, 6) AS overall, coalesce(h, 0) AS hallucinations, coalesce(f, 0) AS flagged FROM orders LEFT JOIN c ON o_orderkey = report_id""")
def verification_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), (F.col("o_orderkey") % 100).cast("double").alias("consistency"), (F.col("o_custkey") % 100).cast("double").alias("source"))
    return A.verification_scores(S.claims(spark, sf_dir), reports, "report_id", digits=6)


@query("SELECT o_orderkey AS report_id, round(CASE WHEN f IS NULL THEN NULL ELSE (f * 0.45 + coalesce(c, 0) * 0.30 + coalesce(s, 0) * 0.25) / (0.45 + CASE WHEN c IS NULL THEN 0 ELSE 0.30 END + CASE WHEN s IS NULL THEN 0 ELSE 0.25 END) END, 4) AS score FROM (SELECT o_orderkey, CAST(nullif(o_orderkey % 5, 0) * 20 AS DOUBLE) AS f, CAST(nullif(o_custkey % 3, 0) * 30 AS DOUBLE) AS c, CAST(nullif(o_custkey % 4, 0) * 25 AS DOUBLE) AS s FROM orders)")
def composed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c, m, k: F.nullif(F.col(c) % m, F.lit(0)).cast("double") * k
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), F.round(V.composed(part("o_orderkey", 5, 20), part("o_custkey", 3, 30), part("o_custkey", 4, 25)), 4).alias("score"))


@query(f"""WITH {S.NEEDS}, s AS (SELECT lang, CASE platform WHEN 'src1' THEN 'github' WHEN 'src2' THEN 'StackOverflow' ELSE platform END AS platform, sentiment FROM needs)
  SELECT lang, round(least(100, greatest(0, avg(CASE lower(platform) WHEN 'github' THEN 0.85 WHEN 'stackoverflow' THEN 0.80 WHEN 'juejin' THEN 0.70 ELSE 0.4 END) * 70 + least(15, count(*) * 1.5) + least(10, count(DISTINCT platform) * 5) + CASE WHEN count(DISTINCT sentiment) > 1 THEN 5 ELSE 0 END)), 4) AS score FROM s GROUP BY lang""")
def source_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("platform") == "src1", "github").when(F.col("platform") == "src2", "StackOverflow").otherwise(F.col("platform"))
    return A.reliability(S.needs(spark, sf_dir).withColumn("platform", named), "lang").withColumn("score", F.round("score", 4))


VERDICTS = ["supported", "partially", "unverifiable", "contradicted", "hallucination"]
MATCH = f"""{S.CLAIMS}, gold AS (SELECT report_id * 10 + l_linenumber AS claim_id, verdict AS expected FROM claims WHERE l_quantity > 5), said AS (SELECT report_id * 10 + l_linenumber AS claim_id, CASE WHEN l_quantity > 25 THEN verdict ELSE 'supported' END AS predicted FROM claims WHERE l_quantity < 45), m AS (SELECT * FROM gold FULL JOIN said USING (claim_id))"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.claims(spark, sf_dir).withColumn("claim_id", F.col("report_id") * 10 + F.col("l_linenumber"))
    gold = c.where("l_quantity > 5").select("claim_id", F.col("verdict").alias("expected"))
    said = c.where("l_quantity < 45").select("claim_id", F.when(F.col("l_quantity") > 25, F.col("verdict")).otherwise("supported").alias("predicted"), F.col("l_linenumber").alias("pos"))
    return J.matched_last(gold, said, "claim_id", "pos")


PRF = "round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"


@query(f"WITH {MATCH}, v AS (SELECT unnest({VERDICTS}) AS verdict), s AS (SELECT v.verdict, count(*) FILTER (expected = v.verdict AND predicted = v.verdict) AS tp, count(*) FILTER (predicted = v.verdict AND expected IS DISTINCT FROM v.verdict) AS fp, count(*) FILTER (expected = v.verdict AND predicted IS DISTINCT FROM v.verdict) AS fn FROM m, v GROUP BY 1) SELECT verdict, {PRF} FROM s")
def verdict_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.verdict_metrics(_matched(spark, sf_dir), VERDICTS).select("verdict", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {MATCH}, s AS (SELECT count(*) FILTER (e AND p) AS tp, count(*) FILTER (p AND NOT e) AS fp, count(*) FILTER (e AND NOT p) AS fn FROM (SELECT coalesce(expected IN ('contradicted', 'hallucination'), FALSE) AS e, coalesce(predicted IN ('contradicted', 'hallucination'), FALSE) AS p FROM m)) SELECT {PRF} FROM s")
def flagged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.binary_metrics(_matched(spark, sf_dir), ["contradicted", "hallucination"]).select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {MATCH}, s AS (SELECT count(*) FILTER (expected IS NOT NULL AND predicted IS NOT NULL) AS tp, count(*) FILTER (expected IS NULL) AS fp, count(*) FILTER (predicted IS NULL) AS fn FROM m) SELECT {PRF} FROM s")
def claim_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matched(spark, sf_dir).agg(F.count_if(F.col("in_gold") & F.col("in_predicted")).alias("tp"), F.count_if(~F.col("in_gold")).alias("fp"), F.count_if(~F.col("in_predicted")).alias("fn"))
    return m.select(*E.prf(F.col("tp"), F.col("fp"), F.col("fn"))).select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("SELECT event_type AS stage, CASE WHEN value < 10 THEN 'failed' WHEN value < 40 THEN 'skipped' ELSE 'success' END AS status, count(*) AS count FROM events GROUP BY 1, 2")
def stage_status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("value") < 10, "failed").when(F.col("value") < 40, "skipped").otherwise("success")
    rows = load(spark, sf_dir, "events").select(F.explode(F.create_map(F.col("event_type"), status)).alias("stage", "status"))
    return rows.groupBy("stage", "status").agg(F.count(F.lit(1)).alias("count"))


@query(f"WITH {S.USAGE} SELECT coalesce(call_type, 'total') AS component, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost), 4) AS cost FROM usage GROUP BY ROLLUP (call_type)")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = S.usage(spark, sf_dir).rollup("call_type").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 4).alias("cost"))
    return by.select(F.coalesce("call_type", F.lit("total")).alias("component"), "input_tokens", "output_tokens", "cost")


@query(f"""WITH {S.USAGE}, m AS (SELECT model AS configuration, unnest([struct_pack(metric := 'tokens', value := CAST(sum(total_tokens) AS DOUBLE)), struct_pack(metric := 'cost', value := round(sum(cost), 6)), struct_pack(metric := 'requests', value := CAST(count(*) AS DOUBLE))]) AS r FROM usage GROUP BY 1)
  SELECT m.configuration, m.r.metric AS metric, m.r.value AS value, round(m.r.value - b.r.value, 4) AS change, round((m.r.value - b.r.value) / b.r.value, 6) AS relative FROM m JOIN m b ON b.configuration = 'other' AND b.r.metric = m.r.metric WHERE m.configuration <> 'other'""")
def metric_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.usage(spark, sf_dir).groupBy(F.col("model").alias("configuration")).agg(F.sum("total_tokens").cast("double").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.count(F.lit(1)).cast("double").alias("requests"))
    return A.compared(s.unpivot("configuration", ["tokens", "cost", "requests"], "metric", "value"), "other").withColumns({"change": F.round("change", 4), "relative": F.round("relative", 6)})


@query("WITH p AS (SELECT p_partkey, unnest([p_brand, p_type]) AS keyword, p_size FROM part WHERE p_partkey IN (SELECT p_partkey FROM part ORDER BY p_size DESC, p_name, p_partkey LIMIT 50)) SELECT keyword, CAST(sum(p_size) AS BIGINT) AS heat FROM p GROUP BY 1 ORDER BY heat DESC, keyword LIMIT 10")
def keyword_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = load(spark, sf_dir, "part").orderBy(F.desc("p_size"), "p_name", "p_partkey").limit(50)
    return hot.select(F.explode(F.array("p_brand", "p_type")).alias("keyword"), "p_size").groupBy("keyword").agg(F.sum("p_size").alias("heat")).orderBy(F.desc("heat"), "keyword").limit(10)


@query("SELECT count(*) FILTER (ok1) = count(*) AS positive, count(*) FILTER (ok2) = count(*) AS cheap, bool_and(ok1 AND ok2) AS accepted FROM (SELECT o_totalprice > 0 AS ok1, o_totalprice < 100000 AS ok2 FROM orders)")
def acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    return A.all_hold(load(spark, sf_dir, "orders"), positive=p > 0, cheap=p < 100000)


@query("SELECT source AS platform, lang AS stratum, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 4000 THEN 'medium' ELSE 'long' END AS length_bucket, count(*) AS count, min(n_chars) AS least, round(avg(n_chars), 4) AS mean, max(n_chars) AS most FROM documents GROUP BY GROUPING SETS ((1), (2), (3))")
def sliced_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.col("source").alias("platform"), F.col("lang").alias("stratum"), F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 4000, "medium").otherwise("long").alias("length_bucket"), "n_chars")
    keys = ["platform", "stratum", "length_bucket"]
    return d.groupingSets([[F.col(k)] for k in keys], *keys).agg(F.count(F.lit(1)).alias("count"), F.min("n_chars").alias("least"), F.round(F.avg("n_chars"), 4).alias("mean"), F.max("n_chars").alias("most"))


@query("SELECT role AS link_type, count(*) AS count, min(conv_id * 1000 + turn) AS first_seen FROM conversations GROUP BY 1")
def link_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").groupBy(F.col("role").alias("link_type")).agg(F.count(F.lit(1)).alias("count"), F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_seen"))


@query(f"WITH {S.CLAIMS} SELECT CASE WHEN verdict IN ('hallucination', 'contradicted') THEN 'correction' ELSE 'review' END AS type, verdict, count(*) AS count FROM claims WHERE verdict IN ('hallucination', 'contradicted', 'partially') GROUP BY 1, 2")
def suggestion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.claims(spark, sf_dir).select("verdict", F.lit("").alias("text"), F.lit("").alias("evidence"))
    return C.suggestions(rows).groupBy("type", "verdict").agg(F.count(F.lit(1)).alias("count"))


@query("SELECT r_regionkey, to_json(list(struct_pack(n_nationkey := n_nationkey, n_name := n_name) ORDER BY n_nationkey))::VARCHAR AS items, count(*) AS count FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def gate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation").join(F.broadcast(load(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_regionkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("items"), F.count(F.lit(1)).alias("count"))
