"""Analyses: answers, faults and fixed results."""

import json

from gistmill.operators import analysis as A
from gistmill.operators import outputs as O


def test_reports_of_found_of_nothing_and_of_faults(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    found = spark.createDataFrame([("a", i, f"doc {i}") for i in range(20)] + [("b", 0, "boom")], "k string, rank int, document string")

    def hook(texts):
        if any("boom" in t for t in texts):
            raise ValueError("model is down")
        return ["line\\nline " + str(t.count("doc")) for t in texts]

    got = {r["k"]: r["analysis"] for r in A.report_analyses(keys, found, "k", hook).collect()}
    assert got == {"a": "line\nline 15", "b": "> AI 分析生成失败: model is down\n", "c": A.NOTHING}


def test_trend_pages(spark):
    rows = spark.createDataFrame([("me/fast-api-kit", "does", "Go", 5), ("me/odd", None, None, None)], "full_name string, description string, language string, stars int")
    got = {r["full_name"]: r for r in A.trend_pages(rows).collect()}
    assert got["me/fast-api-kit"]["tags"] == ["fast", "api", "kit"]
    assert got["me/fast-api-kit"]["body"] == "## me/fast-api-kit\n\ndoes\n\n### 技术亮点\n\n- language: Go\n- stars: 5\n\n### 应用场景\n\n\n\n### 趋势分析\n\ndoes"
    assert got["me/odd"]["body"].startswith("## me/odd\n\n\n\n### ")
    bad = A.trend_pages(rows, lambda texts: ["no json"] * len(texts)).collect()
    assert all(list(r["tags"]) == [] for r in bad) and len(bad) == 2


def test_recommendations(spark):
    projects = spark.createDataFrame([(f"o/p{i}", "d", "Go", i, "x" if i % 2 else None) for i in range(40)], "full_name string, description string, language string, period_stars int, tags string")
    interests = spark.createDataFrame([("ai",), ("ai",), ("web",)], "interest string")
    seen = A.recommendations(projects, interests).collect()
    assert {(r["interest"], r["rank"], r["title"]) for r in seen} == {(i, k + 1, f"o/p{39 - k}") for i in ("ai", "web") for k in range(5)}

    def hook(texts):
        x = [json.loads(t) for t in texts]
        assert all(len(y["projects"]) == 30 and y["projects"][0] == "- o/p39 (Go, +39 stars): d [tags: x]" for y in x)
        return [json.dumps([{"title": y["interest"]}] * 9) for y in x]

    assert A.recommendations(projects, interests, hook).count() == 10
    assert A.recommendations(projects.where("false"), interests).count() == 0


def test_proposals(spark):
    rows = spark.createDataFrame([(1, "k", "T", "D", None, ["r1"]), (2, "k", "U", None, '{"a":1}', None), (3, "k", "V", "E", None, None)], "id int, keyword string, title string, description string, scores string, requirements array<string>")

    def hook(texts):
        if any("机会: T" in t for t in texts):
            raise ValueError("down")
        return [json.dumps({"title": "made", "hours": 3, "mvp": [{"name": "n", "priority": "P2"}]}) if "机会: U" in t else "[1]" for t in texts]

    got = {r["id"]: r for r in A.proposals(rows, "id", hook).collect()}
    assert (got[1]["title"], got[1]["problem"], got[1]["hours"], got[1]["stack"]["hosting"], got[1]["error"]) == ("T", "D", 40, "Vercel", "down")
    assert (got[2]["title"], got[2]["problem"], got[2]["hours"], got[2]["mvp"][0]["priority"], got[2]["error"]) == ("made", None, 3, "P2", None)
    assert got[3]["title"] == "V" and got[3]["error"] == "answer is no object"
    texts = {r["id"]: r["prompt"] for r in O.proposal_texts(A.proposals(rows, "id", hook), "id").collect()}
    assert "- [P0] 核心功能: TBD" in texts[1] and "Vue 3" in texts[1]
