"""Updates and upserts as pure transforms old + delta -> new, for storage without a MERGE of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running


def counted(events: DataFrame, key: list[str], value: str, ts: str) -> DataFrame:
    """Knowledge entries from a batch: latest value, number of sources, and confidence 0.5 plus 0.05 for each after the first."""
    by = events.groupBy(*key).agg(F.max_by(value, ts).alias("value"), F.count(F.lit(1)).alias("source_count"))
    return by.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.5 + 0.05 * (F.col("source_count") - 1)), 4))


def upsert_counted(old: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Existing entries (key, value, source_count, confidence) with a batch of `counted` merged in."""
    d = delta.select(*key, F.col("value").alias("_v"), F.col("source_count").alias("_n"))
    j = old.join(d, key, "full_outer")
    n = F.coalesce("source_count", F.lit(0)) + F.coalesce("_n", F.lit(0))
    fresh = F.coalesce(F.col("confidence"), F.lit(0.45)) + 0.05 * F.coalesce("_n", F.lit(0))
    return j.select(*key, F.coalesce("_v", "value").alias("value"), n.alias("source_count"), F.round(F.least(F.lit(1.0), fresh), 4).alias("confidence"))


def upsert_snapshot(old: DataFrame, delta: DataFrame, key: list[str], value: str) -> DataFrame:
    """Snapshot rows after a fetch, with action: inserted, updated (the value changed), or kept."""
    d = delta.select(*key, F.col(value).alias("_new")).dropDuplicates(key)
    j = old.select(*key, F.col(value).alias("_old"), F.lit(True).alias("_there")).join(d, key, "full_outer")
    action = F.when(F.col("_there").isNull(), "inserted").when(F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old")), "updated").otherwise("kept")
    return j.select(*key, F.coalesce("_new", "_old").alias(value), action.alias("action"))


def set_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Columns set where a condition holds; null conditions leave a row."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def patched(df: DataFrame, patch: DataFrame, key: str, columns: list[str], empty_keeps: bool = False) -> DataFrame:
    """Rows with a patch's columns where they are not null (or, with empty_keeps, not empty either)."""
    p = patch.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    new = lambda c: F.nullif(F.col(f"_{c}"), F.lit("")) if empty_keeps else F.col(f"_{c}")
    return df.join(p, key, "left").select(*(F.coalesce(new(c), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns))


def deleted(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def numbered(old: DataFrame, new: DataFrame, key: str, order: list) -> DataFrame:
    """New rows with ids that go on from the largest one there is, in an order that leaves no ties."""
    top = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    nth = running(new, [], order, {"_nth": F.lit(1)})
    return nth.crossJoin(F.broadcast(top)).withColumn(key, F.col("_top") + F.col("_nth")).drop("_top", "_nth")
