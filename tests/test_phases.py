"""A chain of phases that breaks, stops and goes on."""

import pytest
from pyspark.sql import functions as F

from gistmill.operators.models import rule_extractor
from gistmill.operators.phases import Chain, Phase, mining_phases


def counts(chain, run_id=1):
    return {(r["phase"], r["name"]): r["value"] for r in chain.counts(run_id).collect()}


def phases(spark, calls, broken):
    def of(name, make):
        def run(tables):
            calls.append(name)
            if name in broken:
                raise ValueError(f"{name} is down")
            return make(tables)

        return Phase(name, run, {"rows": F.count(F.lit(1)), "total": F.coalesce(F.sum("id"), F.lit(0))})

    return [of("one", lambda t: spark.range(10)), of("two", lambda t: t["one"].where("id > 2")), of("three", lambda t: t["two"].unionByName(t["one"])), of("four", lambda t: t["three"].where("id = 9"))]


def test_a_run_broken_in_its_third_phase_goes_on_there(spark, tmp_path):
    calls, broken = [], {"three"}
    chain = Chain(spark, f"{tmp_path}/chain", phases(spark, calls, broken))
    with pytest.raises(ValueError, match="three is down"):
        chain.run(1)
    before = counts(chain)
    assert before == {("one", "rows"): 10, ("one", "total"): 45, ("two", "rows"): 7, ("two", "total"): 42}
    states = {r["phase"]: (r["status"], r["result"]) for r in chain.states().collect()}
    assert states["three"][0] == "failed" and "three is down" in states["three"][1] and "four" not in states
    broken.clear()
    calls.clear()
    # another object over the same folder, as after a restart of the driver
    chain = Chain(spark, f"{tmp_path}/chain", phases(spark, calls, broken))
    tables = chain.run(1)
    assert calls == ["three", "four"] and sorted(r["id"] for r in tables["four"].collect()) == [9, 9]
    after = counts(chain)
    assert {k: v for k, v in after.items() if k in before} == before and after["three", "rows"] == 17
    calls.clear()
    chain.run(1)
    assert calls == [] and counts(chain) == after
    chain.run(2)
    assert calls == ["one", "two", "three", "four"] and counts(chain, 2) == after


def test_a_lost_phase_makes_what_follows_anew_and_time_ends_a_run(spark, tmp_path):
    calls = []
    chain = Chain(spark, f"{tmp_path}/chain", phases(spark, calls, set()))
    assert chain.run(1, seconds=0) == {} and calls == []
    chain.run(1)
    chain._say(1, "two", "failed")
    calls.clear()
    chain.run(1)
    assert calls == ["two", "three", "four"]


def test_mining_phases(spark, tmp_path):
    long = "the export of large projects fails with a timeout every time it is started from the menu"
    rows = [(1, "a", "x", "u1", "Export fails", long), (2, "a", "x", "u2", "ok", "thanks"), (3, "b", "x", "u3", "Slow", long + " again"), (4, "a", "y", "u4", "Known", long), (5, None, "y", "u5", None, long)]
    items = spark.createDataFrame(rows, "id long, platform string, topic string, source_url string, title string, content string")
    known = items.where("id = 4").select("platform", "source_url")

    def hook(texts):
        if any("again" in t for t in texts):
            raise ValueError("no answer")
        return rule_extractor(texts)

    chain = Chain(spark, f"{tmp_path}/chain", mining_phases(items, known, hook))
    tables = chain.run(7)
    got = counts(chain, 7)
    assert [got["crawl", n] for n in ("total", "new", "skipped", "noise", "kept")] == [5, 4, 1, 1, 3]
    assert (got["extract", "records"], got["extract", "failed"], got["report", "needs"], got["archive", "documents"], got["distill", "entries"], got["complete", "needs"]) == (2, 1, 2, 2, 2, 2)
    assert tables["complete"].first().asDict() == {"needs": 2, "platforms": 2, "entries": 2}
    empty = Chain(spark, f"{tmp_path}/empty", mining_phases(items.where("false"), known))
    empty.run(1)
    assert counts(empty)["crawl", "total"] == 0 and counts(empty)["complete", "needs"] == 0
