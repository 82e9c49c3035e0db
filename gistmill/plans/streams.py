"""Batch forms of the streaming operators; streams themselves are tested against them. Event-time windows are an
extension of this engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from ..streaming import changes, ingest
from .registry import query


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", count(*) AS count, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.counts_in_windows(load(spark, sf_dir, "events"), "ts", "1 day", by=["event_type"], value="value")


@query("""WITH w AS (SELECT event_type, time_bucket(INTERVAL 12 HOUR, ts) - to_hours(CAST(k * 12 AS INTEGER)) AS start FROM events, range(2) r(k)) SELECT event_type, start, start + INTERVAL 1 DAY AS "end", count(*) AS count FROM w GROUP BY 1, 2""")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.counts_in_windows(load(spark, sf_dir, "events"), "ts", "1 day", "12 hours", by=["event_type"])


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS count FROM s GROUP BY user_id, n""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.sessions(load(spark, sf_dir, "events"), "ts", "user_id", "6 hours")


@query("SELECT DISTINCT user_id, event_type FROM events")
def first_seen_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_seen(load(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query("""WITH d AS (SELECT user_id AS gate_id, CASE event_type WHEN 'click' THEN 'approved' WHEN 'view' THEN 'rejected' ELSE 'edited' END AS decision, {'ts': ts, 'event_id': event_id} AS moment FROM events), f AS (SELECT gate_id, arg_min(decision, moment) AS state, count(*) - 1 AS refused FROM d WHERE decision <> 'edited' GROUP BY 1)
  SELECT DISTINCT d.gate_id, coalesce(state, 'awaiting_review') AS state, coalesce(refused, 0) AS refused FROM d LEFT JOIN f USING (gate_id)""")
def gate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "approved").when(F.col("event_type") == "view", "rejected").otherwise("edited")
    d = load(spark, sf_dir, "events").select(F.col("user_id").alias("gate_id"), kind.alias("decision"), F.struct("ts", "event_id").alias("at"))
    return ingest.gate_states(d).drop("decided_at")


def task_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of tasks made of events: a user is a task, the kind of an event its status, every seventh event a removal."""
    status = F.when(F.col("event_id") % 7 == 0, changes.REMOVED).otherwise(F.col("event_type"))
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), status.alias("status"), "ts", F.col("event_id").alias("seq"))


@query("""WITH t AS (SELECT user_id AS task_id, CASE WHEN event_id % 7 = 0 THEN 'removed' ELSE event_type END AS status, ts, event_id AS seq FROM events),
  b AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY task_id ORDER BY ts, seq), 'removed') AS before FROM t WHERE task_id IS NOT NULL AND status IS NOT NULL)
  SELECT task_id, CASE WHEN status = 'removed' THEN 'removed' WHEN before = 'removed' THEN 'inserted' ELSE 'changed' END AS change, status, ts, seq FROM b WHERE status <> before""")
def task_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.changes(task_updates(spark, sf_dir), "task_id")
