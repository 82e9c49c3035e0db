"""Streams against the batch forms of the same operators."""

from pyspark.sql import functions as F

from gistmill.operators import models
from gistmill.session import load
from gistmill.streaming import ingest

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def drained(stream, mode="append"):
    name = f"out_{abs(hash((mode, id(stream))))}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def landed(spark, data, tmp_path):
    load(spark, data, "events").repartition(3).write.parquet(str(tmp_path / "in"))
    return ingest.files_of(spark, str(tmp_path / "in"), SCHEMA, per_trigger=1)


def test_first_seen(spark, data, tmp_path):
    stream = landed(spark, data, tmp_path)
    got = drained(ingest.first_seen(stream.select("user_id", "event_type"), ["user_id", "event_type"]))
    want = load(spark, data, "events").select("user_id", "event_type").distinct()
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_windows(spark, data, tmp_path):
    stream = landed(spark, data, tmp_path)
    got = drained(ingest.counts_in_windows(stream, "ts", "1 day", late="400 days", by=["event_type"]), "complete")
    want = ingest.counts_in_windows(load(spark, data, "events"), "ts", "1 day", by=["event_type"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_seen_table_across_runs(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS seen_urls")
    fresh = []
    for run, urls in enumerate((["a", "b"], ["b", "c"])):
        spark.createDataFrame([(u,) for u in urls], "url string").write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.files_of(spark, str(tmp_path / "in"), "url string")
        ingest.against_table(stream, ["url"], "seen_urls", lambda df: fresh.extend(r["url"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(fresh) == ["a", "b", "c"]
    spark.sql("DROP TABLE seen_urls")


def test_hooks(spark):
    items = spark.createDataFrame([(1, "The export cannot handle files. It fails every time!!"), (2, "fine")], "id long, text string")
    got = {r["id"]: r for r in models.extract(items, "id", "text").collect()}
    assert got[1]["sentiment"] == "strong" and got[1]["pain_point"].startswith("The export cannot") and got[2]["error"] is None

    def flaky(texts):
        if any("fails" in t for t in texts):
            raise RuntimeError("no answer")
        return [{"title": "t", "sentiment": "odd", "confidence": 7} for _ in texts]

    got = {r["id"]: r for r in models.extract(items, "id", "text", flaky).collect()}
    assert got[1]["error"] == "no answer" and got[1]["title"] is None
    assert (got[2]["title"], got[2]["sentiment"], got[2]["confidence"]) == ("t", "moderate", 1.0)


def test_noise_hook_fails_open(spark):
    long = "A long discussion about tools that people would like to have in their work every day. " * 2
    items = spark.createDataFrame([(1, "short", ""), (2, long, "t")], "id long, content string, title string")

    def broken(texts):
        raise RuntimeError("down")

    got = {r["id"]: (r["verdict"], r["confidence"]) for r in models.filter_noise(items, "id", "content", "title", broken).collect()}
    assert got == {1: ("noise", 0.95), 2: ("relevant", 0.3)}


def test_claim_checks(spark):
    claims = spark.createDataFrame([("r", "c1", "mill grinds grain"), ("s", "c2", "x")], "report string, claim_id string, quote string")
    sources = spark.createDataFrame([("r", "t", "the mill grinds the grain")], "report string, title string, content string")
    got = {r["claim_id"]: (r["verdict"], r["confidence"]) for r in models.check_claims(claims, sources, "report").collect()}
    assert got == {"c1": ("supported", 1.0), "c2": ("unverifiable", 0.3)}


def test_gate_states(spark):
    rows = [(1, "approved", 2), (1, "rejected", 3), (2, "edited", 1), (3, "rejected", 1)]
    got = {r["gate_id"]: (r["state"], r["refused"]) for r in ingest.gate_states(spark.createDataFrame(rows, "gate_id long, decision string, at long")).collect()}
    assert got == {1: ("approved", 1), 2: ("awaiting_review", 0), 3: ("rejected", 0)}


def test_store_or_merge(spark):
    needs = spark.createDataFrame([(1,), (2,)], "id long")
    near = spark.createDataFrame([(1, 7, 0.9), (1, 8, 0.86), (2, 7, 0.5)], "id long, neighbour long, score double")
    got = {r["id"]: (r["action"], r["neighbour"]) for r in models.store_or_merge(needs, near, "id").collect()}
    assert got == {1: ("merged", 7), 2: ("inserted", None)}
    assert spark.range(1).select(models.consistency(F.lit(40.0))).first()[0] == 70.0
