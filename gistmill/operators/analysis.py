"""Analyses by a model over what was found: reports, trending projects, topics to write about, project proposals.

Each asks a hook for a batch of texts at a time, and has a fixed result for what cannot be asked or fails.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

Hook = Callable[[list[str]], list[str]]
# What stands in for an analysis, and a proposal where no model answers.
NOTHING = "> 未检索到相关需求数据，无法生成 AI 分析。\n"
FAILED = "> AI 分析生成失败: {}\n"
USER, RISK, MONEY, HOURS = "独立开发者", "需验证需求真实性", "开源 + SaaS", 40
FEATURE = {"name": "核心功能", "priority": "P0", "description": "TBD"}
STACK = {"frontend": "Vue 3", "backend": "FastAPI", "database": "SQLite", "hosting": "Vercel", "rationale": "最低维护成本"}
BREAKDOWN = {"前端": 15, "后端": 15, "数据库": 5, "部署": 3, "测试": 2}
TREND = "tags array<string>, highlights array<string>, use_cases array<string>, analysis string"
TOPIC = "title string, rationale string, angle string, related_projects array<string>"
PROPOSAL = "title string, problem string, target string, mvp array<struct<priority:string,name:string,description:string>>, stack struct<frontend:string,backend:string,database:string,hosting:string,rationale:string>, hours int, breakdown map<string,int>, risks array<string>, monetization string"


def asked(rows: DataFrame, key: str, ask: Column, hook: Hook, batch: int = 16) -> DataFrame:
    """(key, answer, error) of the hook's answers; a batch that fails is asked again row by row, null texts not at all."""

    def answers(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            said = hook(texts)
            if len(said) != len(texts):
                raise ValueError("number of answers differs")
            return [(s, None) for s in said]
        except Exception as e:  # noqa: BLE001
            return [(None, str(e) or "hook failed")] if len(texts) == 1 else [a for t in texts for a in answers([t])]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                got = answers(list(part["_ask"]))
                yield pd.DataFrame({key: part[key].to_numpy(), "answer": [a for a, _ in got], "error": [e for _, e in got]})

    # a small file is one task, but its hooks' work is not small: the rows are dealt to all tasks
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = rows.select(key, ask.alias("_ask")).where("_ask IS NOT NULL").repartition(tasks)
    return plain.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, answer string, error string")


def outlined(texts: list[str]) -> list[str]:
    """The default analysis: how many passages there are, of how many characters."""
    return [f"{t.count(chr(10) + '---' + chr(10)) + 1} passages, {len(t)} characters" for t in texts]


def report_analyses(keywords: DataFrame, found: DataFrame, key: str, hook: Hook = outlined, most: int = 15) -> DataFrame:
    """(key, analysis) of each keyword from the first `most` documents found for it (key, rank, document), whole ones.

    A keyword without documents has a fixed sentence, and a hook that fails its error. A literal \\\\n becomes a line feed.
    """
    first = found.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).where(F.col("_nth") <= most)
    context = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "document"))), lambda x: x["document"]), "\n---\n").alias("context"))
    got = asked(context, key, F.col("context"), hook)
    said = F.when(F.col("answer").isNotNull(), T.real_line_feeds(F.col("answer"))).when(F.col("error").isNotNull(), F.format_string(FAILED.replace("{}", "%s"), "error"))
    return keywords.select(key).join(got, key, "left").select(key, F.coalesce(said, F.lit(NOTHING)).alias("analysis"))


def named_tags(texts: list[str]) -> list[str]:
    """The default analysis of a project: tags from its name's words, its language and stars as highlights."""
    out = []
    for x in map(json.loads, texts):
        words = list(dict.fromkeys(re.findall(r"[a-z0-9]+", x["full_name"].split("/")[-1].lower())))
        lines = [f"{k}: {x[k]}" for k in ("language", "stars") if x.get(k) is not None]
        out.append(json.dumps({"tags": words[:5], "highlights": lines, "use_cases": [], "analysis": x.get("description") or ""}, ensure_ascii=False))
    return out


def trend_pages(projects: DataFrame, hook: Hook = named_tags) -> DataFrame:
    """(full_name, title, tags, body, error): a page for each project (full_name, description, language, stars).

    An answer that is no object has no tags and its project a page without analysis.
    """
    ask = F.to_json(F.struct("full_name", "description", "language", "stars"))
    got = asked(projects, "full_name", ask, hook).select("full_name", F.from_json("answer", TREND).alias("r"), "error")
    j = projects.join(got, "full_name")
    items = lambda c: F.array_join(F.transform(F.coalesce(F.col(f"r.{c}"), F.array().cast("array<string>")), lambda x: F.concat(F.lit("- "), x)), "\n")
    body = F.concat(
        F.lit("## "), F.col("full_name"), F.lit("\n\n"), F.coalesce("description", F.lit("")), F.lit("\n\n### 技术亮点\n\n"), items("highlights"),
        F.lit("\n\n### 应用场景\n\n"), items("use_cases"), F.lit("\n\n### 趋势分析\n\n"), F.coalesce("r.analysis", F.lit("")),
    )
    return j.select("full_name", F.concat(F.lit("[Trending] "), F.col("full_name")).alias("title"), F.coalesce("r.tags", F.array().cast("array<string>")).alias("tags"), body.alias("body"), "error")


def leading_lines(texts: list[str]) -> list[str]:
    """The default recommendation: the first five projects as they stand."""
    out = []
    for x in map(json.loads, texts):
        names = [re.match(r"- (\S+) \(", p) for p in x["projects"][:5]]
        out.append(json.dumps([{"title": n[1], "rationale": x["interest"], "angle": "", "related_projects": [n[1]]} for n in names if n]))
    return out


def recommendations(projects: DataFrame, interests: DataFrame, hook: Hook = leading_lines, top: int = 30, most: int = 5) -> DataFrame:
    """(interest, rank, title, rationale, angle, related_projects): topics from the `top` projects by stars of the period.

    projects: full_name, description, language, period_stars, tags (a string or null); ties go by name. A hook that fails
    leaves no rows. The projects of the top are one row, which is what is broadcast to the interests.
    """
    tags = F.when(F.coalesce("tags", F.lit("")) != "", F.concat(F.lit(" [tags: "), F.col("tags"), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("- "), F.col("full_name"), F.lit(" ("), F.coalesce("language", F.lit("")), F.lit(", +"), F.col("period_stars").cast("string"), F.lit(" stars): "), F.coalesce("description", F.lit("")), tags)
    best = projects.select("full_name", "period_stars", line.alias("line")).orderBy(F.desc("period_stars"), "full_name").limit(top)
    lines = best.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("period_stars")).alias("s"), "full_name", "line"))), lambda x: x["line"]).alias("projects")).where("size(projects) > 0")
    rows = interests.select("interest").distinct().crossJoin(F.broadcast(lines))
    got = asked(rows, "interest", F.to_json(F.struct("interest", "projects")), hook)
    topics = F.slice(F.from_json("answer", f"array<struct<{TOPIC.replace(' ', ':').replace(',:', ',')}>>"), 1, most)
    return got.select("interest", F.posexplode(topics).alias("rank", "t")).select("interest", (F.col("rank") + 1).alias("rank"), "t.*")


def unanswered(texts: list[str]) -> list[str]:
    """The default for proposals: no model, so that the fixed structure stands."""
    raise ValueError("no model")


def proposals(opportunities: DataFrame, key: str, hook: Hook = unanswered) -> DataFrame:
    """(key, fields of a proposal, error) of opportunities (key, keyword, title, description, scores, requirements).

    scores: JSON or null; requirements: ids, of which twenty are shown. An answer that is no object counts as a failure,
    and a failure gives the fixed structure around the opportunity's title and description. Fields that an answer leaves
    out are empty. The result is what `outputs.proposal_texts` takes.
    """
    ids = F.array_join(F.slice(F.coalesce("requirements", F.array().cast("array<string>")), 1, 20), ", ")
    ask = F.concat_ws("\n", *(F.concat(F.lit(f"{n}: "), F.coalesce(c, F.lit(""))) for n, c in (("关键词", F.col("keyword")), ("机会", F.col("title")), ("描述", F.col("description")), ("评分", F.coalesce("scores", F.lit("{}"))), ("需求", ids))))
    got = asked(opportunities, key, ask, hook).select(key, F.from_json("answer", PROPOSAL, {"columnNameOfCorruptRecord": "_bad"}).alias("r"), F.try_parse_json("answer").alias("v"), "error")
    whole = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    j = opportunities.select(key, F.col("title").alias("_title"), F.col("description").alias("_text")).join(got, key)
    fine = F.coalesce(whole, F.lit(False))
    literal = lambda d: F.struct(*(F.lit(v).alias(k) for k, v in d.items()))
    fixed = {
        "title": F.col("_title"), "problem": F.col("_text"), "target": F.lit(USER), "mvp": F.array(F.struct(*(F.lit(FEATURE[k]).alias(k) for k in ("priority", "name", "description")))), "stack": literal(STACK),
        "hours": F.lit(HOURS), "breakdown": F.create_map(*(F.lit(x) for kv in BREAKDOWN.items() for x in kv)), "risks": F.array(F.lit(RISK)), "monetization": F.lit(MONEY),
    }
    error = F.when(~fine, F.coalesce("error", F.lit("answer is no object")))
    return j.select(key, *(F.when(fine, F.col(f"r.{n}")).otherwise(c).alias(n) for n, c in fixed.items()), error.alias("error"))
