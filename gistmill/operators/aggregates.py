"""Aggregations: usage and cost rollups, distributions, quality rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import values as V


def usage_summary(usage: DataFrame) -> DataFrame:
    """One row: requests, token sums, cost, share of input from cache (percent), and a flat saving per cached token."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = usage.agg(F.count(F.lit(1)).alias("requests"), *(total(c).alias(c) for c in ("input_tokens", "output_tokens", "cached_tokens", "total_tokens")), F.coalesce(F.round(F.sum("cost"), 4), F.lit(0.0)).alias("cost"))
    return sums.withColumn("cache_hit_rate", F.when(F.col("input_tokens") > 0, F.round(F.col("cached_tokens") / F.col("input_tokens") * 100, 1)).otherwise(0.0)).withColumn("saved", F.round(F.col("cached_tokens") * 1e-6, 4))


def daily_trend(usage: DataFrame, ts: str = "created_at") -> DataFrame:
    return usage.groupBy(F.to_date(ts).alias("date")).agg(F.count(F.lit(1)).alias("requests"), F.sum("total_tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost")).orderBy("date")


def model_stats(usage: DataFrame) -> DataFrame:
    by = usage.groupBy("model", "call_type").agg(F.count(F.lit(1)).alias("requests"), F.sum("total_tokens").alias("tokens"), F.sum("cost").alias("_cost"), F.avg("cost").alias("_mean"))
    return by.orderBy(F.desc("_cost"), "model", "call_type").select("model", "call_type", "requests", "tokens", F.round("_cost", 4).alias("cost"), F.round("_mean", 6).alias("avg_cost"))


def budget_alerts(usage: DataFrame, anchor: Column, limits: dict[str, float], ts: str = "created_at") -> DataFrame:
    """(period, spent, budget) of the periods ("day", "month") at or over their limit; 0 switches a limit off."""
    spent = usage.agg(*(F.coalesce(F.sum(F.when(F.col(ts) >= F.date_trunc(p, anchor), F.col("cost"))), F.lit(0.0)).alias(p) for p in limits))
    rows = F.array(*(F.struct(F.lit(p).alias("period"), F.round(p, 4).alias("spent"), F.lit(v).alias("budget")) for p, v in limits.items()))
    return spent.select(F.inline(rows)).where((F.col("budget") > 0) & (F.col("spent") >= F.col("budget")))


def distributions(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(field, value, count, pct) of several columns in one pass; null and empty values take the given default."""
    filled = df.select(*(F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(d)).alias(c) for c, d in columns.items()))
    sets = ", ".join(f"({c})" for c in columns)
    named = [F.when(F.grouping(c) == 0, F.lit(c)) for c in columns]
    by = filled.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.coalesce(*named).alias("field"), F.count(F.lit(1)).alias("count")) if sets else filled
    share = F.round(F.col("count") / F.sum("count").over(Window.partitionBy("field")) * 100, 1)
    return by.select("field", F.coalesce(*columns).alias("value"), "count", share.alias("pct"))


def top_values(df: DataFrame, values: Column, n: int, order: Column) -> DataFrame:
    """The n most frequent elements of an array column, ties to the one that comes first in `order`.

    Elements are counted by hash; only rows that hold the first place of a leading element are looked into again.
    """
    lists = df.select(order.alias("_at"), values.alias("_v"))
    counts = lists.select("_at", F.explode("_v").alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("count"), F.min("_at").alias("_at"))
    rank = F.struct(-F.col("count"), F.col("_at"))
    last = counts.orderBy(rank).limit(n).agg(F.max(rank).alias("_last"))
    best = counts.crossJoin(F.broadcast(last)).where(rank <= F.col("_last")).drop("_last")
    near = lists.join(best.select("_at").distinct(), "_at", "left_semi").select("_at", F.posexplode("_v").alias("_pos", "value"))
    first = near.join(best.select("_at", "value"), ["_at", "value"]).groupBy("value").agg(F.min("_pos").alias("_pos"))
    return best.join(first, "value", "left").orderBy(F.desc("count"), "_at", "_pos").limit(n).select("value", "count")


def counts_by(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """Rows of each group (or of all) in total and for each condition."""
    made = (df.groupBy(*keys) if keys else df.groupBy()).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(n) for n, c in conditions.items()))
    return made


def rates_by(df: DataFrame, keys: list[str], condition: Column, name: str = "approved") -> DataFrame:
    return counts_by(df, keys, **{name: condition}).withColumn("rate", F.round(V.ratio(F.col(name), F.col("total")), 4))


def traction(rows: DataFrame, platform: str, sentiment: str, title: str, order: str) -> DataFrame:
    """Per platform: rows, mean sentiment weight, and the first title; most rows first."""
    return rows.groupBy(F.col(platform).alias("platform")).agg(F.count(F.lit(1)).alias("count"), F.round(F.avg(V.weight(F.col(sentiment), V.SENTIMENT, 0.5)), 2).alias("sentiment"), F.min_by(title, order).alias("title")).orderBy(F.desc("count"), "platform")


def reliability(sources: DataFrame, key: str) -> DataFrame:
    """(key, score) from platforms, volume and variety of each key's sources; see `reliability_of` for keys without."""
    by = sources.groupBy(key).agg(
        F.avg(V.weight(F.lower("platform"), V.PLATFORM, 0.4)).alias("mean"), F.count(F.lit(1)).alias("n"), F.count_distinct("platform").alias("platforms"), F.count_distinct("sentiment").alias("sentiments")
    )
    raw = F.col("mean") * 70 + F.least(F.lit(15.0), F.col("n") * 1.5) + F.least(F.lit(10), F.col("platforms") * 5) + F.when(F.col("sentiments") > 1, 5).otherwise(0)
    return by.select(key, V.clamp(raw, 0.0, 100.0).alias("score"))


def verification_scores(claims: DataFrame, reports: DataFrame, key: str, digits: int = 1) -> DataFrame:
    """fact, overall, hallucinations and flagged of each report (key, consistency, source); without claims fact is 50."""
    scored = V.weight(F.col("verdict"), V.VERDICT, 40.0) * F.col("confidence") + 50 * (1 - F.col("confidence"))
    by = claims.groupBy(key).agg(F.round(F.avg(scored), digits).alias("fact"), F.count_if(F.col("verdict") == "hallucination").alias("hallucinations"), F.count_if(F.col("verdict").isin("hallucination", "contradicted")).alias("flagged"))
    j = reports.join(by, key, "left").withColumn("fact", F.coalesce("fact", F.lit(50.0)))
    overall = F.round(F.col("fact") * 0.45 + F.round("consistency", digits) * 0.30 + F.round("source", digits) * 0.25, digits)
    return j.select(key, "fact", overall.alias("overall"), F.coalesce("hallucinations", F.lit(0)).alias("hallucinations"), F.coalesce("flagged", F.lit(0)).alias("flagged"))


def compared(metrics: DataFrame, baseline: str) -> DataFrame:
    """(configuration, metric, value, change, relative) against a baseline configuration; null where there is no base."""
    base = metrics.where(F.col("configuration") == baseline).select("metric", F.col("value").alias("_base"))
    j = metrics.where(F.col("configuration") != baseline).join(base, "metric", "left")
    return j.select("configuration", "metric", "value", (F.col("value") - F.col("_base")).alias("change"), F.try_divide(F.col("value") - F.col("_base"), F.col("_base")).alias("relative"))


def heat(projects: DataFrame, top: int, n: int) -> DataFrame:
    """(keyword, heat): period stars summed over tags and readable names of the `top` hottest projects."""
    from ..functions.text import readable_name

    hot = projects.orderBy(F.desc("period_stars"), "full_name").limit(top)
    words = F.array_distinct(F.filter(F.array_append(F.coalesce("tags", F.array().cast("array<string>")), readable_name(F.col("full_name"))), lambda x: x != ""))
    return hot.select("period_stars", F.explode(words).alias("keyword")).groupBy("keyword").agg(F.sum("period_stars").alias("heat")).orderBy(F.desc("heat"), "keyword").limit(n)


def all_hold(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: whether each condition holds for every row, and whether all do."""
    each = df.agg(*(F.coalesce(F.bool_and(c), F.lit(True)).alias(n) for n, c in conditions.items()))
    return each.withColumn("accepted", F.array_min(F.array(*conditions)))


def nested(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """All rows as one JSON array text, with their number. For lists that a person reviews, which are small."""
    return rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("_r")))), lambda x: x["_r"])).alias("items"), F.count(F.lit(1)).alias("count"))
