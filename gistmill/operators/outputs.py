"""What leaves the engine: records, responses, test cases, proposals, and the marks that tell two runs apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

# Fields of a prediction and what they hold where nothing was extracted.
EMPTY = {"title": "", "description": "", "pain_point": "", "use_case": "", "sentiment": "mild", "emotion": "neutral"}
# Feedback that bears on extraction, and on the noise filter.
EXTRACTION, NOISE = ("requirement_corrected", "requirement_rejected"), ("item_removed", "item_added")
# The text of a proposal for a coding assistant, and of its document; {name} is a field, [name] a list.
PROMPT = """# Project: {title}

## Problem
{problem}

## Target Users
{target}

## MVP Scope
{features}

## Suggested Tech Stack
- Frontend: {frontend|TBD}
- Backend: {backend|TBD}
- Database: {database|TBD}
- Hosting: {hosting|TBD}
- Why: {rationale|Minimal maintenance}

## Estimated Effort
~{hours|40} hours

## Build Instructions
Scaffold this project with {frontend|Vue} + {backend|FastAPI}.
Start with the data model, then implement the core user flow.
"""
BODY = """# {title}

## 问题陈述
{problem}

## 目标用户
{target}

## MVP 功能
{bold_features}

## 技术栈
| 层级 | 选型 |
|------|------|
| 前端 | {frontend|TBD} |
| 后端 | {backend|TBD} |
| 数据库 | {database|TBD} |
| 部署 | {hosting|TBD} |

> {rationale}

## 工作量
{hours|N/A} 小时: {breakdown|{}}

## 风险
{risks|待分析}

## 变现
{monetization}
"""
PRIORITY = "P1"


def predictions(records: DataFrame, key: str, configuration: str) -> DataFrame:
    """One flat record per extraction: present is error, no (a reason to reject) or yes; errors are cut to 500 characters.

    records: key, the fields of `EMPTY`, confidence, reason and error. An error leaves nothing of the fields; a rejected
    row neither, but for its confidence.
    """
    failed, refused = F.coalesce(F.col("error"), F.lit("")) != "", F.coalesce(F.col("reason"), F.lit("")) != ""
    present = F.when(failed, "error").when(refused, "no").otherwise("yes")
    fields = [F.when(failed | refused, F.lit(v)).otherwise(F.coalesce(F.col(n), F.lit(v))).alias(n) for n, v in EMPTY.items()]
    sure = F.when(failed, 0.0).otherwise(F.coalesce("confidence", F.lit(0.0))).alias("confidence")
    reason = F.when(failed | ~refused, "").otherwise(F.col("reason")).alias("rejection_reason")
    return records.select(F.col(key).alias("id"), present.alias("requirement_present"), *fields, sure, reason, F.left(F.coalesce("error", F.lit("")), F.lit(500)).alias("extraction_error"), F.lit(configuration).alias("configuration"), F.lit(False).alias("hitl_edited"))


def responses(needs: DataFrame, shown: int = 500) -> DataFrame:
    """Needs as a client gets them: null or empty moods take the middle value, keywords are one text, bodies are cut."""
    filled = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c)
    return needs.select(
        "doc_id", F.coalesce("title", F.lit("")).alias("title"), F.left(F.coalesce("body", F.lit("")), F.lit(shown)).alias("description"), F.coalesce("platform", F.lit("")).alias("source_platform"),
        filled("sentiment", "moderate"), filled("emotion", "neutral"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("mention_count", F.lit(1)).alias("mention_count"),
        F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), ", ").alias("keyword"),
    )


def feedback(records: DataFrame, limit: int, types: tuple[str, ...] = (), run: int | None = None) -> DataFrame:
    """The newest feedback of some types, or of one run; a top-n, so no full sort is kept."""
    if types:
        records = records.where(F.col("feedback_type").isin(*types))
    if run:
        records = records.where(F.col("pipeline_run_id") == run)
    return records.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def verifiable(reports: DataFrame) -> DataFrame:
    """Reports that can be checked: title (or the file's stem), the first keyword of a list or nothing, the time as text."""
    first = F.coalesce(F.get("keywords", F.lit(0)), F.lit(""))
    return reports.select(F.coalesce("title", F.regexp_replace("filename", r"\.[^.]*$", "")).alias("title"), first.alias("keyword"), F.coalesce(F.col("created_at").cast("string"), F.lit("")).alias("created_at"))


RECORD = "struct<title:string,description:string,platform:string,sentiment:string,emotion:string,confidence:double>"


def derived_cases(records: DataFrame, limit: int = 200) -> DataFrame:
    """Test cases made of corrections: the input as extracted first, and what a reviewer made of it as expectation.

    Records without a before, an after or a title give none. Confidence may be off by 0.1 either way, within 0 and 1;
    of the corrected title the first five words of two characters or more are expected. Cases are numbered newest first.
    """
    from pyspark.sql.window import Window

    newest = feedback(records, limit, EXTRACTION).withColumn("_n", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))) - 1)
    b, a = F.from_json("before_json", RECORD), F.from_json("after_json", RECORD)
    j = newest.withColumns({"b": b, "a": a}).where("b is not null and a is not null and before_json <> '{}' and after_json <> '{}'")
    words = F.slice(F.filter(F.split("a.title", r"\s+"), lambda w: F.length(w) > 1), 1, 5)
    sure = F.col("a.confidence")
    return j.where(F.coalesce("b.title", "a.title", F.lit("")) != "").select(
        F.concat(F.lit("feedback_"), F.col("id").cast("string"), F.lit("_"), F.col("_n").cast("string")).alias("case_id"), F.coalesce("b.title", "a.title").alias("title"),
        F.coalesce("b.description", "a.description", F.lit("")).alias("content"), F.coalesce("b.platform", F.lit("unknown")).alias("platform"),
        F.coalesce("a.sentiment", "b.sentiment").alias("sentiment"), F.coalesce("a.emotion", "b.emotion").alias("emotion"),
        F.when(sure.isNotNull(), F.round(V.clamp(sure - 0.1, 0.0, 1.0), 6)).alias("confidence_min"), F.when(sure.isNotNull(), F.round(V.clamp(sure + 0.1, 0.0, 1.0), 6)).alias("confidence_max"), words.alias("title_keywords"), "reason",
    ).where("sentiment is not null or emotion is not null or confidence_min is not null or title_keywords is not null")


def resumable(stored: DataFrame, asked: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, same, changed): whether a stored run has what is asked for now, and the fields that differ, by name."""
    a = asked.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    differs = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in sorted(fields))))
    return stored.join(a, key).select(key, (F.size(differs) == 0).alias("same"), F.array_join(differs, ",").alias("changed"))


def corpus_mark(records: DataFrame, columns: list[str], table: str, backend: str) -> DataFrame:
    """One row that names a corpus: a digest that does not depend on the order of rows, how many there are, and where.

    The rows' own digests are added up (60 bits of each), so partial sums meet, not rows; repeated rows count.
    """
    row = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns))
    part = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(20,0)")
    by = records.agg(F.coalesce(F.sum(part), F.lit(0).cast("decimal(30,0)")).alias("_s"), F.count(F.lit(1)).alias("corpus_records"))
    return by.select(F.sha2(F.concat_ws(":", F.col("_s").cast("string"), F.col("corpus_records").cast("string")), 256).alias("corpus_sha256"), "corpus_records", F.lit(table).alias("table_name"), F.lit(backend).alias("embedding_backend"))


def filled(template: str, fields: dict[str, Column]) -> Column:
    """A text with {name} or {name|default} replaced by columns; nulls take the default, or nothing."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{(\w+)(?:\|((?:[^{}]|\{\})*))?\}", template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(fields[m[1]].cast("string"), F.lit(m[2] or ""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def proposal_texts(proposals: DataFrame, key: str) -> DataFrame:
    """(key, prompt, body) of proposals: title, problem, target, mvp (array of priority, name, description), stack (struct),
    hours, breakdown (map), risks (array) and monetization, each of which may be null."""

    def listed(before: str, after: str) -> Column:
        line = lambda m: F.concat(F.lit(before), F.coalesce(m["priority"], F.lit(PRIORITY)), F.lit("] "), F.coalesce(m["name"], F.lit("")), F.lit(after), F.coalesce(m["description"], F.lit("")))
        return F.array_join(F.transform("mvp", line), "\n")

    stack = {n: F.col(f"stack.{n}") for n in ("frontend", "backend", "database", "hosting", "rationale")}
    hours = F.array_join(F.transform(F.map_entries("breakdown"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"].cast("string"))), ", ")
    fields = stack | {n: F.col(n) for n in ("title", "problem", "target", "hours", "monetization")}
    fields |= {"features": listed("- [", ": "), "bold_features": listed("- **[", "**: "), "breakdown": F.concat(F.lit("{"), hours, F.lit("}"))}
    fields["risks"] = F.nullif(F.array_join(F.transform("risks", lambda r: F.concat(F.lit("- "), r)), "\n"), F.lit(""))
    return proposals.select(key, filled(PROMPT, fields).alias("prompt"), filled(BODY, fields).alias("body"))


def phase_states(log: DataFrame) -> DataFrame:
    """(run_id, phase, status, started_at, completed_at, result) from a log of (run_id, phase, status, ts, seq, result).

    The last status counts; a start is the last running entry, an end the last completed or failed one, and an entry
    without a result leaves the one before it. One aggregate with partial sums, whatever the length of the log.
    """
    moment = F.struct("ts", "seq")
    ended = F.col("status").isin("completed", "failed")
    return log.groupBy("run_id", "phase").agg(
        F.max_by("status", moment).alias("status"), F.max(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"), F.max(F.when(ended, F.col("ts"))).alias("completed_at"),
        F.max_by("result", F.when(F.coalesce(F.col("result"), F.lit("")) != "", moment)).alias("result"),
    )
