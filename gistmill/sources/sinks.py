"""Sinks: staged documents, archives, sheets, and datasets with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def markdown(fields: Column, body: Column) -> Column:
    """A document's text: its fields (map of strings) between rules, sorted by name, then the body."""
    lines = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), body)


def write_documents(docs: DataFrame, path: str, stage: str, mode: str = "append") -> None:
    """Documents (title, fields, body) under their stage, keyed by stage and file name; the reader takes the last."""
    named = docs.select(F.lit(stage).alias("stage"), F.concat(T.safe_filename(F.col("title")), F.lit(".md")).alias("filename"), "title", "fields", "body", F.current_timestamp().alias("written"))
    named.write.mode(mode).partitionBy("stage").parquet(path)


def read_documents(docs: DataFrame) -> DataFrame:
    """The last version of each document of `write_documents`."""
    return docs.groupBy("stage", "filename").agg(F.max_by(F.struct("title", "fields", "body"), "written").alias("d")).select("stage", "filename", "d.*")


def updated_fields(docs: DataFrame, updates: DataFrame) -> DataFrame:
    """Documents with the fields of updates (filename, updates: map) over their own."""
    j = docs.join(updates, "filename", "left")
    patch = F.coalesce("updates", F.create_map().cast("map<string,string>"))
    kept = F.map_filter("fields", lambda k, _: ~F.map_contains_key(patch, k))
    return j.withColumn("fields", F.map_concat(kept, patch)).drop("updates")


def archive_raw(items: DataFrame, path: str) -> None:
    items.write.mode("append").partitionBy("platform").parquet(path)


def write_vectors(rows: DataFrame, path: str) -> None:
    """Vectors (id, vector, document, metadata) appended with the time; see `last_vectors`."""
    rows.withColumn("written", F.current_timestamp()).write.mode("append").parquet(path)


def last_vectors(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.max_by(F.struct("vector", "document", "metadata"), "written").alias("r")).select("id", "r.*")


def write_sheet(rows: DataFrame, path: str, columns: list[str]) -> None:
    rows.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_with_manifest(rows: DataFrame, path: str, key: str, by: str) -> DataFrame:
    """JSON lines, and a manifest of rows by group with a hash that does not depend on their order.

    The hash of a group is the sum of its rows' hashes, so it is made from partial sums and needs no sort.
    """
    rows.write.mode("overwrite").json(f"{path}/data")
    line = F.xxhash64(F.to_json(F.struct(*sorted(rows.columns)))).cast("decimal(38,0)")
    manifest = rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"), F.sum(line).cast("string").alias("digest"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest
