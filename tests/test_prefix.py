"""Running sums over ranges against plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gistmill.operators import prefix


@pytest.mark.parametrize("seed", [1, 2])
def test_running_sums_by_key(spark, seed):
    rng = random.Random(seed)
    # one key holds most rows, so that it covers several ranges; null is a key of its own
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.choice([None, -3, 0, 5, 7]), rng.random()) for i in range(3000)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame(rows, "k string, at long, v int, x double")
    got = prefix.running(df, ["k"], ["at"], {"total": F.col("v"), "n": F.lit(1), "sum_x": F.col("x")}).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, state = {}, defaultdict(lambda: [0, 0, 0.0])
    for k, at, v, x in sorted(rows, key=lambda r: r[1]):
        s = state[k]
        s[0], s[1], s[2] = s[0] + (v or 0), s[1] + 1, s[2] + x
        want[at] = (k, *s)
    assert len(got) == len(rows)
    for r in got:
        k, total, n, x = want[r["at"]]
        assert (r["k"], r["total"], r["n"]) == (k, total, n) and abs(r["sum_x"] - x) < 1e-9


def test_running_sums_of_all_rows_in_falling_order(spark):
    df = spark.range(1000).repartition(7)
    got = prefix.running(df, [], [F.col("id").desc()], {"s": F.col("id")})
    assert got.columns == ["id", "s"]
    assert {r["id"]: r["s"] for r in got.collect()} == {i: sum(range(i, 1000)) for i in range(1000)}
    assert prefix.running(df.where("id < 0"), [], ["id"], {"s": F.col("id")}).count() == 0
