"""Incremental ingestion with Structured Streaming, and windows over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def files_of(spark: SparkSession, path: str, schema: str, kind: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream; which were read is the checkpoint's knowledge."""
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", per_trigger).load(path)


def first_seen(items: DataFrame, keys: list[str], ts: str | None = None, within: str = "30 days") -> DataFrame:
    """Items whose keys were not seen before. With a time column keys are remembered within the watermark only.

    Without one the state grows for ever, as a seen set does; for unbounded sources give the time.
    """
    if ts is None:
        return items.dropDuplicates(keys)
    return items.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def against_table(items: DataFrame, keys: list[str], table: str, work: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Seen set held in a table: each batch is joined against it, worked on, and its keys appended."""

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        known = spark.table(table) if spark.catalog.tableExists(table) else None
        fresh = df if known is None else df.join(known.select(*keys).distinct(), keys, "left_anti")
        work(fresh)
        fresh.select(*keys).distinct().write.mode("append").saveAsTable(table)

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_in_windows(events: DataFrame, ts: str, every: str, slide: str | None = None, late: str = "10 minutes", by: list[str] | None = None, value: str | None = None) -> DataFrame:
    """Counts (and sums) by tumbling or sliding window of event time; late rows are dropped after the watermark."""
    w = F.window(ts, every, slide) if slide else F.window(ts, every)
    sums = [F.round(F.sum(value), 4).alias("total")] if value else []
    by_window = events.withWatermark(ts, late).groupBy(w.alias("w"), *(by or [])).agg(F.count(F.lit(1)).alias("count"), *sums)
    return by_window.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), "count", *(["total"] if value else []))


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after a gap without events."""
    by = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("count"))
    return by.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")


def chunked(docs: DataFrame, key: str, text: str, size: int = 800, overlap: int = 100) -> DataFrame:
    """Chunks of new documents, for an index that grows."""
    return docs.select(key, F.posexplode(T.chunks(F.col(text), size, overlap)).alias("pos", "chunk"))


def gate_states(decisions: DataFrame) -> DataFrame:
    """State of each gate from its decisions (gate_id, decision, at): the first final one holds, later ones are refused."""
    first = decisions.where(F.col("decision").isin("approved", "rejected")).groupBy("gate_id").agg(F.min_by("decision", "at").alias("state"), F.min("at").alias("decided_at"), (F.count(F.lit(1)) - 1).alias("refused"))
    return decisions.select("gate_id").distinct().join(first, "gate_id", "left").select("gate_id", F.coalesce("state", F.lit("awaiting_review")).alias("state"), "decided_at", F.coalesce("refused", F.lit(0)).alias("refused"))


def run_all(stream: DataFrame, table: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is, append to a table, and stop: one run of an external schedule."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).toTable(table)
    q.awaitTermination()
