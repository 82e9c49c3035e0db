"""Experiments over configurations: results are kept under fingerprints, so that what two configurations share, or a
broken run had done, is computed once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..kept import kept
from .evaluation import prf, reviewed
from .filters import noise_verdict
from .outputs import EMPTY

Hook = Callable[[list[str]], list[str]]
# The configurations compared.
EXTRACTIONS = ("rule_only", "llm_only", "hybrid")
#: Evidence depth and the characters of a source's content that it shows, none for titles only.
EVIDENCE = {"no_evidence": None, "titles_only": 0, "snippet_200": 200, "snippet_800": 800}
SCORES = ("fact_only", "fact_consistency", "full_weighted")
CHOSEN = "snippet_200"
# How a discussion and its context are put to a model.
TITLE_MARK, CONTENT_MARK = "讨论标题：", "\n\n讨论内容：\n"
CONTEXT_MARK = "\n\n以下是 held-out 公开讨论中检索到的补充上下文。仅用于帮助理解，不要把上下文中的事实当作当前讨论的事实：\n\n"
TEXTS, MOODS = ("title", "description", "pain_point", "use_case"), ("sentiment", "emotion")
RECORD = "struct<title:string,description:string,pain_point:string,use_case:string,sentiment:string,emotion:string>"
FIELDS = "stage string, fingerprint string, result string, error string, attempts int"


class Store:
    """Results of stages as Parquet, partitioned by stage: (fingerprint, result, error, attempts), one row a fingerprint.

    A fingerprint is the sha256 of stage, configuration and input, so equal work of several configurations is one row.
    Batches are appended as they finish: what a broken run had written is found by the next one. A fingerprint that two
    interrupted runs both wrote is read once, the row without an error before others.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.spark.createDataFrame([], FIELDS).write.mode("append").partitionBy("stage").parquet(path)

    def rows(self, stage: str) -> DataFrame:
        there = self.spark.read.schema(FIELDS).parquet(self.path).where(F.col("stage") == stage)
        best = F.max_by(F.struct("result", "error"), F.struct(F.col("error").isNull(), "attempts", "result")).alias("r")
        return there.groupBy("fingerprint").agg(best, F.sum("attempts").alias("attempts")).select("fingerprint", "r.result", "r.error", "attempts")

    def run(self, asked: DataFrame, stage: str, hook: Hook, batch: int = 64, retry_failed: bool = False) -> DataFrame:
        """`asked` (any columns, configuration, input), its input left out, with fingerprint, result and error, the missing ones computed.

        What is asked is worked out twice, for the hook and for a written table without the inputs that the result reads.

        hook: from a list of inputs to as many results, called on the executors. A batch that fails, or answers with
        another number of results, is asked again row by row; a row that fails has its error in place of a result.
        Failed rows are not asked again unless retry_failed.
        """
        mark = F.sha2(F.concat_ws("\n", F.lit(stage), "configuration", "input"), 256)
        asked = asked.withColumn("fingerprint", mark)
        known = self.rows(stage)
        open_ = asked.select("fingerprint", "input").dropDuplicates(["fingerprint"]).join(known.where("error IS NULL") if retry_failed else known, "fingerprint", "left_anti")
        made = open_.mapInArrow(_asking(hook, batch), "fingerprint string, result string, error string, attempts int")
        made.withColumn("stage", F.lit(stage)).write.mode("append").partitionBy("stage").parquet(self.path)
        return kept(asked.drop("input"), "asked").join(self.rows(stage).drop("attempts"), "fingerprint", "left")

    def calls(self) -> DataFrame:
        """(stage, kept, attempts): fingerprints of each stage, and how often a hook was asked for them."""
        there = self.spark.read.schema(FIELDS).parquet(self.path)
        return there.groupBy("stage").agg(F.count_distinct("fingerprint").alias("kept"), F.sum("attempts").alias("attempts"))


def _asking(hook: Hook, batch: int):
    def ask(inputs: list[str]) -> list[tuple[str | None, str | None, int]]:
        try:
            said = hook(inputs)
            if len(said) != len(inputs):
                raise ValueError("number of answers differs")
            return [(s, None, 1) for s in said]
        except Exception as e:  # noqa: BLE001
            if len(inputs) == 1:
                return [(None, str(e) or "hook failed", 1)]
            return [(r, x, n + 1) for i in inputs for r, x, n in ask([i])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):  # only these inputs become Python strings at a time
                part = b.slice(at, batch)
                result, error, attempts = (list(x) for x in zip(*ask(part.column("input").to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column("fingerprint"), pa.array(result, pa.string()), pa.array(error, pa.string()), pa.array(attempts, pa.int32())], ["fingerprint", "result", "error", "attempts"])

    return run


CLAIMS = "array<struct<quote:string,section:string>>"
CHECKED = "array<struct<verdict:string,confidence:double>>"


def _extracted(reports: DataFrame, store: Store, hook: Hook, rule: Column) -> DataFrame:
    """(id, configuration, claims, error): rule claims, the hook's, and both without those alike (characters, over 0.8)."""
    asked = reports.select("id", F.lit("llm").alias("configuration"), F.col("report_body").alias("input"))
    got = store.run(asked, "claim_extraction", hook).select("id", F.from_json("result", CLAIMS).alias("llm"), F.when(F.col("result").isNull(), F.coalesce("error", F.lit("no answer"))).alias("error"))
    j = reports.select("id", rule.alias("rule")).join(got, "id")
    # each claim's characters are found once, and the fold once a report
    chars = lambda q: F.when(F.coalesce(q, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(q, "")))
    marked = F.transform(F.concat("llm", "rule"), lambda c: F.struct(c["quote"].alias("quote"), c["section"].alias("section"), chars(c["quote"]).alias("chars")))
    shared = lambda a, b: F.size(F.array_intersect(a["chars"], b["chars"]))
    like = lambda a, b: T.once(shared(a, b), lambda n: (n > 0) & (n / (F.size(a["chars"]) + F.size(b["chars"]) - n) > 0.8))
    none = F.array().cast(CLAIMS.replace(">>", ",chars:array<string>>>"))
    fold = F.aggregate(marked, none, lambda held, c: F.when(F.exists(held, lambda k: like(k, c)), held).otherwise(F.array_append(held, c)), lambda held: F.transform(held, lambda c: F.struct(c["quote"].alias("quote"), c["section"].alias("section"))))
    j, both = j.withColumn("both", fold), F.col("both")
    many = F.when(F.size(both) > 12, F.lit("hybrid extraction exceeds the 12-claim call cap"))
    each = [(F.lit("rule_only"), F.col("rule"), F.lit(None).cast("string")), (F.lit("llm_only"), F.col("llm"), F.col("error")), (F.lit("hybrid"), F.when(F.size(both) <= 12, both), F.coalesce("error", many))]
    return kept(j.select("id", F.inline(F.array(*(F.struct(n.alias("configuration"), c.alias("claims"), e.alias("error")) for n, c, e in each)))), "extraction")


def _checked(hybrid: DataFrame, reports: DataFrame, store: Store, hook: Hook) -> DataFrame:
    """(id, configuration, checked, error) of the hybrid claims at each depth of evidence, in the claims' order."""
    j = hybrid.where("error IS NULL AND size(claims) > 0").join(reports.select("id", "sources"), "id")
    shown = lambda n: F.transform("sources", lambda s: F.struct(s["title"].alias("title"), (F.left(s["content"], F.lit(n)) if n else F.lit("")).alias("content")))
    ask = [F.struct(F.lit(k).alias("configuration"), F.to_json(F.struct("claims", shown(n).alias("sources"))).alias("input")) for k, n in EVIDENCE.items() if n is not None]
    got = store.run(j.select("id", F.size("claims").alias("many"), F.inline(F.array(*ask))), "fact_check", hook)
    checked = F.from_json("result", CHECKED)
    whole = F.when(F.size(checked) == F.col("many"), checked)
    with_sources = got.select("id", "configuration", whole.alias("checked"), F.when(whole.isNull(), F.coalesce("error", F.lit("answer is not complete"))).alias("error"))
    none = F.transform("claims", lambda c: F.struct(F.lit("unverifiable").alias("verdict"), F.lit(0.3).alias("confidence")))
    return j.select("id", F.lit("no_evidence").alias("configuration"), none.alias("checked"), F.lit(None).cast("string").alias("error")).unionByName(with_sources)


def verifier_experiment(reports: DataFrame, store: Store, extract: Hook, check: Hook, judge: Hook, rule: Column) -> dict[str, DataFrame]:
    """Three ways to extract claims, four depths of evidence and three ways to score, over reports (id, report_body, sources).

    The hook `extract` gives a report's claims as JSON [{quote, section}], `check` takes {claims, sources} and gives
    [{verdict, confidence}] in the claims' order, `judge` takes {body, claims} and gives a number up to 100. rule: the
    rule's claims of a report, a column of [{quote, section}]. Each report is asked about five times, however many
    configurations use an answer: once for claims, for each depth with sources, and for consistency.

    Returns extraction (id, configuration, claims, error), evidence (id, configuration, checked, error, score) and scores
    (id, configuration, score). What failed upstream leaves no row in evidence and null scores.
    """
    extraction = _extracted(reports, store, extract, rule)
    hybrid = extraction.where("configuration = 'hybrid'").drop("configuration")
    evidence = _checked(hybrid, reports, store, check)
    asked = hybrid.where("error IS NULL").join(reports.select("id", F.col("report_body").alias("body")), "id").select("id", F.lit("full").alias("configuration"), F.to_json(F.struct("body", "claims")).alias("input"))
    consistency = store.run(asked, "consistency", judge).select("id", F.least(F.lit(100.0), F.greatest(F.lit(0.0), (100 + F.col("result").cast("double")) / 2)).alias("consistency"))
    parts = reports.select("id", F.inline(F.transform("sources", lambda s: F.struct(s["platform"].alias("platform"))))).groupBy("id").agg(F.avg(V.weight(F.lower("platform"), V.PLATFORM, 0.4)).alias("mean"), F.count(F.lit(1)).alias("n"), F.count_distinct("platform").alias("kinds"))
    source = parts.select("id", V.clamp(F.col("mean") * 70 + F.least(F.lit(15.0), F.col("n") * 1.5) + F.least(F.lit(10), F.col("kinds") * 5), 0.0, 100.0).alias("source"))

    point = lambda x: V.weight(x["verdict"], V.VERDICT, 40.0) * x["confidence"] + 50 * (1 - x["confidence"])
    fact = F.round(F.aggregate(F.transform("checked", point), F.lit(0.0), lambda s, x: s + x) / F.size("checked"), 1)
    scored = evidence.withColumn("fact", fact).join(consistency, "id", "left").join(source, "id", "left")
    evidence = scored.select("id", "configuration", "checked", "error", F.round(V.composed(F.col("fact"), F.col("consistency"), F.col("source")), 6).alias("score"))
    chosen = scored.where(F.col("configuration") == CHOSEN)
    nothing = F.lit(None).cast("double")
    mixes = {"fact_only": V.composed(F.col("fact"), nothing, nothing), "fact_consistency": F.when(F.col("consistency").isNotNull(), V.composed(F.col("fact"), F.col("consistency"), nothing)), "full_weighted": F.when(F.col("consistency").isNotNull(), V.composed(F.col("fact"), F.col("consistency"), F.col("source")))}
    scores = chosen.select("id", F.inline(F.array(*(F.struct(F.lit(k).alias("configuration"), F.round(v, 6).alias("score")) for k, v in mixes.items()))))
    return {"extraction": extraction, "evidence": evidence, "scores": scores}


def extraction_metrics(extraction: DataFrame, gold: DataFrame) -> DataFrame:
    """(configuration, reports, precision, recall, f1) of claims by equal quotes, over the reports that a way succeeded for.

    gold: (id, claims) with quotes."""
    known = gold.select("id", F.array_distinct(F.transform("claims", lambda c: c["quote"])).alias("gold"))
    j = extraction.where("error IS NULL").join(known, "id").withColumn("said", F.array_distinct(F.transform("claims", lambda c: c["quote"])))
    hits = F.size(F.array_intersect("gold", "said"))
    by = j.groupBy("configuration").agg(F.count(F.lit(1)).alias("reports"), F.sum(hits).alias("tp"), F.sum(F.size("said") - hits).alias("fp"), F.sum(F.size("gold") - hits).alias("fn"))
    return by.select("configuration", "reports", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def evidence_metrics(evidence: DataFrame, extraction: DataFrame, gold: DataFrame) -> DataFrame:
    """(configuration, reports, matched, right, accuracy): verdicts of hybrid claims that gold has too, at each depth."""
    hybrid = extraction.where("configuration = 'hybrid'").select("id", "claims")
    said = evidence.where("error IS NULL").join(hybrid, "id").select("id", "configuration", F.explode(F.arrays_zip("claims", "checked")).alias("x"))
    known = gold.select("id", F.inline("claims")).select("id", "quote", F.col("verdict").alias("gold"))
    j = said.select("id", "configuration", F.col("x.claims.quote").alias("quote"), F.col("x.checked.verdict").alias("verdict")).join(known, ["id", "quote"], "left")
    right = F.count_if(F.col("gold") == F.col("verdict"))
    matched = F.count("gold")
    return j.groupBy("configuration").agg(F.count_distinct("id").alias("reports"), matched.alias("matched"), right.alias("right"), V.ratio(right, matched).alias("accuracy"))


def call_counts(store: Store, reports: int) -> DataFrame:
    """One row: calls that were made, planned (five a report), and that separate runs would make (twenty), and saved."""
    made = store.calls().agg(F.coalesce(F.sum("kept"), F.lit(0)).alias("asked"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"))
    return made.select(F.lit(reports).cast("long").alias("reports"), "asked", "attempts", F.lit(5 * reports).cast("long").alias("planned"), F.lit(20 * reports).cast("long").alias("separate"), F.lit(15 * reports).cast("long").alias("saved"), (F.lit(5 * reports) - F.col("asked")).cast("long").alias("shared"))


def extraction_benchmark(items: DataFrame, store: Store, hook: Hook, configuration: str = "extraction") -> DataFrame:
    """(id, present, record, error) for items (id, title, content): noise is `no` and never asked about, the rest is the hook's.

    The hook gives a record as JSON, or an empty string where an item states no need; present is error where it fails.
    """
    noise = noise_verdict(F.col("content"), F.col("title"))
    judged = kept(items.select("id", "title", "content", (noise["verdict"] == "noise").alias("noise")), "judged")
    text = F.concat_ws("\n", "title", "content")
    got = store.run(judged.where(~F.col("noise")).select("id", F.lit(configuration).alias("configuration"), text.alias("input")), "extraction", hook)
    present = F.when(F.col("result").isNull(), "error").when(F.col("result") == "", "no").otherwise("yes")
    asked = got.select("id", present.alias("present"), F.nullif("result", F.lit("")).alias("record"), "error")
    none = F.lit(None).cast("string")
    return asked.unionByName(judged.where("noise").select("id", F.lit("no").alias("present"), none.alias("record"), none.alias("error")))


def discussion_experiment(items: DataFrame, contexts: DataFrame, gold: DataFrame, store: Store, hook: Hook) -> DataFrame:
    """(id, configuration, present, fields of a record, error) of each discussion with no context, with one, and reviewed.

    items: id, title, content; contexts: id, context, what retrieval found for a discussion; gold: id, present and the
    fields. The hook gives a record as JSON, or an empty string where there is no need. Noise is `no` in every
    configuration and never asked about. Without a context the configurations that take one have an error. rag_hitl is
    rag as a reviewer with the gold leaves it (see `evaluation.reviewed`), so it asks nothing of its own; a discussion that
    failed is not reviewed.
    """
    noise = noise_verdict(F.col("content"), F.col("title"))
    judged = kept(items.select("id", "title", "content", (noise["verdict"] == "noise").alias("noise")).join(contexts, "id", "left"), "judged")
    plain = F.concat(F.lit(TITLE_MARK), F.coalesce("title", F.lit("")), F.lit(CONTENT_MARK), F.coalesce("content", F.lit("")))
    found = F.nullif(F.trim(F.coalesce("context", F.lit(""))), F.lit(""))
    ways = F.array(F.struct(F.lit("no_rag").alias("configuration"), plain.alias("input")), F.struct(F.lit("rag").alias("configuration"), F.concat(plain, F.lit(CONTEXT_MARK), found).alias("input")))
    each = judged.select("id", "noise", F.inline(ways))
    got = store.run(each.where("NOT noise AND input IS NOT NULL").select("id", "configuration", "input"), "discussion", hook)
    record = F.from_json("result", RECORD)
    said = F.when(F.col("result").isNull(), "error").when(F.col("result") == "", "no").when(record["title"].isNull(), "error").otherwise("yes")
    asked = got.select("id", "configuration", said.alias("present"), record.alias("r"), F.when(said == "error", F.coalesce("error", F.lit("answer is no record"))).alias("error"))
    nothing = F.lit(None).cast(RECORD)
    rest = each.where("noise OR input IS NULL").select("id", "configuration", F.when(F.col("noise"), "no").otherwise("error").alias("present"), nothing.alias("r"), F.when(~F.col("noise"), "no context returned").alias("error"))
    empty = {n: F.lit(EMPTY.get(n, "")) for n in (*TEXTS, *MOODS)}
    fields = [F.coalesce(F.col(f"r.{n}"), v).alias(n) for n, v in empty.items()]
    made = asked.unionByName(rest).select("id", "configuration", "present", *fields, "error")
    rag = made.where("configuration = 'rag'")
    edited = reviewed(rag.where("present <> 'error'").drop("configuration", "error"), gold, "id", list(TEXTS), list(MOODS)).drop("edited")
    failed = rag.where("present = 'error'").withColumn("configuration", F.lit("rag_hitl"))
    hitl = edited.withColumns({"configuration": F.lit("rag_hitl"), "error": F.lit(None).cast("string")})
    return made.unionByName(hitl.select(*made.columns)).unionByName(failed)
