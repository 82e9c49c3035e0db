"""Typed edges between entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

EDGE = ["source_type", "source_id", "link_type", "target_type", "target_id"]
# Entity types, where they live, and what they have.
ENTITIES = (
    ("raw_discussion", "vault", ["HasSource", "HasVaultPath", "HasKeyword"]),
    ("requirement", "vault", ["HasSource", "HasSentiment", "HasKeyword", "HasVaultPath"]),
    ("opportunity", "database", ["HasScore", "HasKeyword", "HasStatus"]),
    ("proposal", "database", ["HasKeyword", "HasStatus", "HasVaultPath", "HasTimestamps"]),
    ("report", "vault", ["HasKeyword", "HasVaultPath"]),
    ("crawl_task", "database", ["HasKeyword", "HasStatus", "HasTimestamps"]),
    ("pipeline_run", "database", ["HasKeyword", "HasStatus", "HasTimestamps"]),
    ("verification", "database", ["HasScore", "HasStatus", "HasTimestamps"]),
    ("trending_project", "database", ["HasTimestamps"]),
)


def entities(spark: SparkSession, storage: str | None = None, interface: str | None = None) -> DataFrame:
    out = spark.createDataFrame(list(ENTITIES), "name string, storage string, interfaces array<string>")
    if storage:
        out = out.where(F.col("storage") == storage)
    return out.where(F.array_contains("interfaces", interface)) if interface else out


def neighbors(edges: DataFrame, kind: str, key: str) -> DataFrame:
    """Edges that leave or reach an entity, with direction; a loop comes twice."""
    out = edges.where((F.col("source_type") == kind) & (F.col("source_id") == key)).withColumn("direction", F.lit("outgoing"))
    back = edges.where((F.col("target_type") == kind) & (F.col("target_id") == key)).withColumn("direction", F.lit("incoming"))
    return out.unionByName(back)


def new_edges(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that are no edges yet, once each."""
    return candidates.select(*EDGE).distinct().join(edges.select(*EDGE), EDGE, "left_anti")


def edges_from_ids(rows: DataFrame, kind: str, key: str, ids: str, link: str, target: str) -> DataFrame:
    """Edges from each row to every id in its JSON array of ids; texts that do not parse give none."""
    each = rows.select(F.col(key).cast("string").alias("source_id"), F.explode(F.from_json(ids, "array<string>")).alias("target_id"))
    return each.select(F.lit(kind).alias("source_type"), "source_id", F.lit(link).alias("link_type"), F.lit(target).alias("target_type"), "target_id")


def edges_from_links(docs: DataFrame, kind: str, key: str, refs: str, link: str, target: str) -> DataFrame:
    """Edges from each document to the titles shown in its wiki links."""
    each = docs.select(F.col(key).cast("string").alias("source_id"), F.explode(refs).alias("ref")).select("source_id", T.link_shown(F.col("ref")).alias("target_id"))
    return each.where("target_id <> ''").select(F.lit(kind).alias("source_type"), "source_id", F.lit(link).alias("link_type"), F.lit(target).alias("target_type"), "target_id")


def without_entity(edges: DataFrame, kind: str, key: str) -> DataFrame:
    touches = ((F.col("source_type") == kind) & (F.col("source_id") == key)) | ((F.col("target_type") == kind) & (F.col("target_id") == key))
    return edges.where(~touches)


def relationship_lines(needs: DataFrame, platform: str, title: str, order: str, most: int = 8) -> DataFrame:
    """(platform, lines): up to `most` titles of each platform, in order, long ones shortened."""
    from .windows import first_per_group

    shown = F.when(F.length(title) > 25, F.concat(F.left(title, F.lit(25)), F.lit("..."))).otherwise(F.col(title))
    some = first_per_group(needs, [platform], [order], most).select(platform, F.struct(F.col(order).alias("o"), shown.alias("t")).alias("x"))
    return some.groupBy(platform).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("lines"))


def edge_page(edges: DataFrame, key: str, number: int, size: int, **filters: str | int | None) -> DataFrame:
    """A page of the edges that meet all filters given (None is no filter), newest first, with how many there are."""
    from .windows import page

    for column, value in filters.items():
        if value is not None:
            edges = edges.where(F.col(column) == value)
    return page(edges, [F.desc("created_at"), F.desc(key)], number, size)
