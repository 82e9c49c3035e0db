"""A run of phases, each a batch over what earlier ones left; a broken run goes on at its first open phase."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .filters import noise_verdict
from .joins import unseen
from .models import Hook, extract, rule_extractor
from .outputs import phase_states
from .upserts import counted

LOG = "run_id long, phase string, status string, ts timestamp, seq long, result string"


@dataclass
class Phase:
    """make: from the tables of the phases before, by name, to this one's. counts: aggregates observed while it is written."""

    name: str
    make: Callable[[dict[str, DataFrame]], DataFrame]
    counts: dict[str, Column] = field(default_factory=dict)


class Chain:
    """Phases in order, with their tables and a log of their states below one shared folder.

    A phase's table is written whole before it is logged as completed, with the counts observed on the way; what follows
    reads the table, not the plan behind it. Run again, a run reads completed phases and starts at the first other one;
    phases after that are made anew, whatever their state.
    """

    def __init__(self, spark: SparkSession, path: str, phases: list[Phase]):
        self.spark, self.path, self.phases = spark, path, phases
        spark.createDataFrame([], LOG).write.mode("append").parquet(f"{path}/log")

    def _say(self, run_id: int, phase: str, status: str, result: str | None = None) -> None:
        row = self.spark.createDataFrame([(run_id, phase, status, time.time_ns(), result)], "run_id long, phase string, status string, seq long, result string")
        row.select("run_id", "phase", "status", F.timestamp_micros(F.expr("seq div 1000")).alias("ts"), "seq", "result").coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def states(self) -> DataFrame:
        """(run_id, phase, status, started_at, completed_at, result) of all runs; see `phase_states`."""
        return phase_states(self.spark.read.schema(LOG).parquet(f"{self.path}/log"))

    def counts(self, run_id: int) -> DataFrame:
        """(phase, name, value) of the counts of a run's completed phases."""
        rows = self.states().where((F.col("run_id") == run_id) & (F.col("status") == "completed"))
        return rows.select("phase", F.explode(F.from_json("result", "map<string,long>")).alias("name", "value"))

    def table(self, run_id: int, phase: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/run={run_id}/{phase}")

    def run(self, run_id: int, seconds: float | None = None) -> dict[str, DataFrame]:
        """Tables of the phases by name. A phase that fails is logged with its error, which is raised.

        seconds: no phase is begun after so long; those left stay open for the next call.
        """
        began, done, fresh = time.monotonic(), {}, False
        states = {r["phase"]: r["status"] for r in self.states().where(F.col("run_id") == run_id).select("phase", "status").collect()}
        for p in self.phases:
            fresh |= states.get(p.name) != "completed"
            if fresh:
                if seconds is not None and time.monotonic() - began >= seconds:
                    break
                self._say(run_id, p.name, "running")
                try:
                    seen, made = Observation(), p.make(done)
                    made = made.observe(seen, *(c.cast("long").alias(n) for n, c in p.counts.items())) if p.counts else made
                    made.write.mode("overwrite").parquet(f"{self.path}/run={run_id}/{p.name}")
                    result = json.dumps(seen.get) if p.counts else "{}"
                except Exception as e:
                    self._say(run_id, p.name, "failed", json.dumps({"error": str(e)[:2000]}))
                    raise
                self._say(run_id, p.name, "completed", result)
            done[p.name] = self.table(run_id, p.name)
        return done


def mining_phases(items: DataFrame, known: DataFrame, hook: Hook = rule_extractor) -> list[Phase]:
    """crawl, extract, report, archive, distill, complete over items (id, platform, topic, source_url, title, content).

    crawl keeps items whose (platform, source_url) is not in `known`, with the noise rules' verdict; extract asks the hook
    about those that are no noise; report has a summary for each platform; archive a document for each need and distill
    what is known of each (platform, topic); complete is one row of totals.
    """
    n = F.count(F.lit(1))

    def crawl(_: dict[str, DataFrame]) -> DataFrame:
        marked = items.join(unseen(items, known, ["platform", "source_url"]).select("id").withColumn("new", F.lit(True)), "id", "left").withColumn("new", F.coalesce("new", F.lit(False)))
        return marked.withColumn("verdict", F.when(F.col("new"), noise_verdict(F.col("content"), F.col("title"))["verdict"]))

    def extracted(t: dict[str, DataFrame]) -> DataFrame:
        clean = t["crawl"].where("verdict <> 'noise'")
        text = clean.select("id", F.concat_ws("\n", "title", "content").alias("text"))
        return extract(text, "id", "text", hook).join(clean.select("id", "platform", "topic", "source_url"), "id")

    def report(t: dict[str, DataFrame]) -> DataFrame:
        fine = t["extract"].where("error IS NULL")
        return fine.groupBy("platform").agg(n.alias("needs"), F.count_if(F.col("sentiment") == "strong").alias("strong"), F.round(F.avg("confidence"), 4).alias("confidence"))

    def archive(t: dict[str, DataFrame]) -> DataFrame:
        fine = t["extract"].where("error IS NULL")
        body = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("description"), F.lit("\n\n"), F.col("source_url"))
        return fine.select("id", "platform", "topic", body.alias("document"))

    def distill(t: dict[str, DataFrame]) -> DataFrame:
        return counted(t["archive"], ["platform", "topic"], "document", "id")

    def complete(t: dict[str, DataFrame]) -> DataFrame:
        return t["report"].agg(F.sum("needs").alias("needs"), n.alias("platforms")).crossJoin(t["distill"].agg(n.alias("entries")))

    new = F.col("new")
    return [
        Phase("crawl", crawl, {"total": n, "new": F.count_if(new), "skipped": F.count_if(~new), "noise": F.count_if(F.col("verdict") == "noise"), "kept": F.count_if(F.col("verdict") != "noise")}),
        Phase("extract", extracted, {"records": F.count_if(F.col("error").isNull()), "failed": F.count_if(F.col("error").isNotNull())}),
        Phase("report", report, {"platforms": n, "needs": F.coalesce(F.sum("needs"), F.lit(0))}),
        Phase("archive", archive, {"documents": n}),
        Phase("distill", distill, {"entries": n, "sources": F.coalesce(F.sum("source_count"), F.lit(0))}),
        Phase("complete", complete, {"needs": F.coalesce(F.max("needs"), F.lit(0))}),
    ]
