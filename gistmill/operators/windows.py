"""Ranked, running and paged rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_group(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def quota_sample(df: DataFrame, quotas: DataFrame, by: str, order: list, most: int | None = None) -> DataFrame:
    """The first rows of each group, as many as its quota (by, quota); groups without a quota are left out.

    With `most`, the largest quota, each task keeps no more rows of a group than that before the shuffle.
    """
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    ranked = ranked if most is None else ranked.where(F.col("_n") <= most)
    return ranked.join(quotas, by).where(F.col("_n") <= F.col("quota")).drop("_n", "quota")


def last_wins(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per key: the last row's values at the first row's place."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("_v"), F.min(order).alias(order)).select(*key, "_v.*", order)


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Rows of a page, numbered from 1, with the total; the order must end in a unique key."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def page_then_sort(df: DataFrame, order: list, within: list, number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size).orderBy(*within)


def extremes(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n largest gains and n largest losses, with direction."""
    up = df.where(F.col(value) > 0).orderBy(F.desc(value), key).limit(n).withColumn("direction", F.lit("gain"))
    down = df.where(F.col(value) < 0).orderBy(value, key).limit(n).withColumn("direction", F.lit("loss"))
    return up.unionByName(down)


def capped_clusters(sizes: DataFrame, order: list, most: int = 8) -> DataFrame:
    """Clusters renumbered by order, those beyond the cap folded into the last; `sizes` has a row per cluster."""
    nth = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return sizes.withColumn("cluster", F.least(nth, F.lit(most)))


def best_so_far(df: DataFrame, order: str, value: str) -> DataFrame:
    """Rows with the best value before them, whether they improve on it, and how many rows since the last improvement."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("best_before", before).withColumn("improved", F.coalesce(F.col(value) > F.col("best_before"), F.lit(True)))
    marked = marked.withColumn("_run", F.sum(F.col("improved").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.withColumn("stale", F.row_number().over(Window.partitionBy("_run").orderBy(order)) - 1).drop("_run")


def history(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows with the change of a value against the key's row before."""
    return df.withColumn("change", F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(order)))


def bundles(df: DataFrame, by: list[str], order: list, size: int = 2) -> DataFrame:
    """Rows with the number of their bundle of `size` neighbours in the group's order."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("bundle", F.floor(nth / size).cast("int")).withColumn("ordinal", nth)


def staged(parts: list[DataFrame]) -> DataFrame:
    """Tables one after the other, with the number of the table each row is from."""
    out = parts[0].withColumn("stage_no", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("stage_no", F.lit(k)))
    return out


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def under_heading(lines: DataFrame, key: str, heading: Column) -> DataFrame:
    """Lines with the number of the heading they stand under, 0 before the first."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("section", F.sum(heading.cast("int")).over(w))
