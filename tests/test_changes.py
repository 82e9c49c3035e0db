"""The stream of changes against its batch form, with a restart between batches."""

import pytest
from pyspark.sql import functions as F

from gistmill.plans import streams
from gistmill.streaming import changes as K

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_batch_form(spark):
    rows = [(1, s, i) for i, s in enumerate(["pending", "pending", "running", "removed", "removed", None, "done"])] + [(2, "removed", 0), (None, "x", 0)]
    df = spark.createDataFrame([(k, s, i) for k, s, i in rows], "k long, status string, seq long").withColumn("ts", F.timestamp_seconds("seq"))
    got = [(r["k"], r["change"], r["status"], r["seq"]) for r in K.changes(df, "k").orderBy("k", "seq").collect()]
    assert got == [(1, "inserted", "pending", 0), (1, "changed", "running", 2), (1, "removed", "removed", 3), (1, "inserted", "done", 6)]
    assert K.changes(df.where("false"), "k").count() == 0


def test_stream_with_a_restart_gives_the_batch_form(spark, data, tmp_path, rocksdb):
    tasks = streams.task_updates(spark, data)
    half = tasks.agg(F.percentile_approx("seq", 0.5)).first()[0]
    schema = ", ".join(f"{n} {t}" for n, t in tasks.dtypes)

    def drain():
        stream = K.change_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "task_id")
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()

    # the updates of each key come in order, dealt to two runs of the query
    early = tasks.where(F.col("seq") <= half)
    moments = early.groupBy("task_id").agg(F.max(F.struct("ts", "seq")).alias("last"))
    late = tasks.where(F.col("seq") > half).join(moments, "task_id", "left").where("last IS NULL OR struct(ts, seq) > last").drop("last")
    early.coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
    drain()
    first = spark.read.parquet(f"{tmp_path}/out").count()
    late.coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
    drain()
    out = spark.read.parquet(f"{tmp_path}/out")
    want = K.changes(early.unionByName(late), "task_id")
    assert out.count() > first > 0
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.select(*out.columns).collect()))
    # given again, nothing changes
    early.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    drain()
    assert spark.read.parquet(f"{tmp_path}/out").count() == out.count()
