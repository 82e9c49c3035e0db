"""Documents as files: whole or not there, overwritten, read back; listings that read what changed; ordered lines."""

import json
import os

import pytest
from pyspark.sql import functions as F

from gistmill.sources import document_files as D
from gistmill.sources.files import documents, settings


def docs(spark, rows):
    return spark.createDataFrame(rows, "stage string, title string, fields map<string,string>, body string")


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names)


def test_written_overwritten_and_read_back(spark, tmp_path):
    path = f"{tmp_path}/vault"
    rows = [("need", f"Title {i}", {"标题": f"Title {i}", "a": "b"}, f"body {i}\n") for i in range(20)] + [("raw", "odd/name?", None, None), (None, "root", {}, "x")]
    D.write_document_files(docs(spark, rows).repartition(4), path)
    got = {r["title"]: r for r in documents(spark, path).collect()}
    assert len(got) == 22 and got["Title 3"]["body"] == "body 3\n" and got["Title 3"]["fields"]["a"] == "b"
    assert not [f for f in files(path) if "_staging" in f]
    D.write_document_files(docs(spark, [("need", "Title 3", {"a": "c"}, "new"), ("need", "Title 99", {}, "more")]), path)
    again = {r["filename"]: r["body"] for r in documents(spark, path).collect()}
    assert len(again) == 23 and again["Title 3.md"] == "new"
    D.write_document_files(docs(spark, [("need", "only", {}, "one")]), path, mode="overwrite")
    assert [f for f in files(path)] == ["02-需求池/only.md"]


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    path = f"{tmp_path}/vault"
    D.write_document_files(docs(spark, [("need", "before", {}, "x")]), path)
    broken = docs(spark, [("need", f"t{i}", {}, "x") for i in range(10)]).repartition(3).withColumn("body", F.when(F.col("title") == "t7", F.raise_error(F.lit("killed"))).otherwise(F.col("body")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        D.write_document_files(broken, path)
    assert files(path) == ["02-需求池/before.md"]


def test_cached_documents_read_only_what_changed(spark, tmp_path, monkeypatch):
    path, cache = f"{tmp_path}/vault", f"{tmp_path}/cache"
    D.write_document_files(docs(spark, [("need", f"t{i}", {"n": str(i)}, "x") for i in range(5)]), path)
    reads = []
    real = D.documents
    monkeypatch.setattr(D, "documents", lambda *a: (reads.append(a[1:]), real(*a))[1])
    of = lambda: {r["filename"]: r["body"] for r in D.CachedDocuments(spark, path, cache).refresh().collect()}
    assert of() == {f"t{i}.md": "x" for i in range(5)} and len(reads) == 1
    assert len(of()) == 5 and len(reads) == 1
    changed = f"{path}/02-需求池/t3.md"
    with open(changed, "w") as f:
        f.write("changed")
    os.utime(changed, (1_900_000_000, 1_900_000_000))
    os.remove(f"{path}/02-需求池/t1.md")
    assert of() == {"t0.md": "x", "t2.md": "x", "t3.md": "changed", "t4.md": "x"} and len(reads) == 2
    # the scan opens the files of the range of times only
    plan = real(spark, *reads[1])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(modificationTime" in plan
    os.remove(f"{path}/02-需求池/t0.md")
    assert len(of()) == 3 and len(reads) == 2
    held = D.CachedDocuments(spark, path, cache, ttl=60)
    assert held.refresh().count() == 3
    os.remove(f"{path}/02-需求池/t2.md")
    assert held.refresh().count() == 3 and of().keys() == {"t3.md", "t4.md"}


def test_lines_in_order_over_partitions_and_batches(spark, tmp_path):
    path = f"{tmp_path}/lines"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = spark.range(1000).withColumn("z", F.lit(None).cast("string")).orderBy(F.rand(3))
    D.write_lines_in_order(rows.where("id < 600"), path, ["id"], 0)
    D.write_lines_in_order(rows.where("id >= 600"), path, ["id"], 1)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = [json.loads(line) for f in D.line_files(path) for line in open(f)]
    assert [x["id"] for x in whole] == list(range(1000)) and list(whole[0]) == ["id", "z"] and len(D.line_files(path)) > 3
    # a batch that broke is no part of the whole, and is written again
    os.remove(f"{path}/batch=00000001/_SUCCESS")
    assert D.finished_batches(path) == [0]
    D.write_lines_in_order(rows.where("id >= 600"), path, ["id"], 1)
    assert D.finished_batches(path) == [0, 1] and sum(1 for f in D.line_files(path) for _ in open(f)) == 1000
    assert D.line_files(f"{tmp_path}/none") == []


def test_settings_of_yaml_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.yaml").write_text("llm:\n  model: x\n  sizes: [1, 2]\n  live: true\nempty: {}\nnone:\nn: 3\n")
    (tmp_path / "in" / "b.yml").write_text("a: [1\n")
    (tmp_path / "in" / "c.yaml").write_text("- 1\n")
    (tmp_path / "in" / "d.txt").write_text("x: 1\n")
    got = {(r["path"].rsplit("/", 1)[1], r["name"]): r["value"] for r in settings(spark, f"{tmp_path}/in").collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "a.yaml"} == {"llm.model": "x", "llm.sizes": "[1, 2]", "llm.live": "true", "empty": "{}", "none": None, "n": "3"}
    assert got["c.yaml", ""] == "no mapping" and got["b.yml", ""] and len(got) == 8
