"""Where a language model would sit: hooks that take a batch of texts, with deterministic rules as the default.

A hook is a function from a list of texts to a list of results; it runs on the executors, a batch at a time, and is
imported there, so clients and keys are made inside it. A failing batch is not lost: each operator says what it yields.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import values as V
from .filters import noise_verdict
from .prefix import running

Hook = Callable[[list[str]], list[dict | None]]
# What an extracted record may hold.
PAIN = re.compile(r"(?i)\b(?:cannot|can't|fails?|slow|broken|missing)\b")
SENTIMENTS = ("strong", "moderate", "mild")
EMOTIONS = ("frustrated", "neutral", "hopeful", "angry")
RECORD = "title string, description string, pain_point string, use_case string, sentiment string, emotion string, confidence double, error string"


def _pain(text: str) -> str:
    """The part between full stops and line ends around the first word of PAIN, empty without one; one look at each character."""
    found = PAIN.search(text)
    if not found:
        return ""
    start = max(text.rfind(".", 0, found.start()), text.rfind("\n", 0, found.start())) + 1
    ends = [e for e in (text.find(".", found.end()), text.find("\n", found.end())) if e >= 0]
    return text[start : min(ends, default=len(text))]


def rule_extractor(texts: list[str]) -> list[dict | None]:
    """A record from the text alone: first sentence as title, first 300 characters as description, words as mood."""
    out = []
    for t in texts:
        first = re.split(r"(?<=[.!?。！？])\s|\n", t.strip(), maxsplit=1)[0]
        mood = "strong" if re.search(r"(?i)must|never|broken|!!", t) else "mild" if len(t) < 200 else "moderate"
        pain = _pain(t)
        out.append({"title": first[:80], "description": t[:300], "pain_point": pain.strip(), "use_case": "", "sentiment": mood, "emotion": "frustrated" if pain else "neutral", "confidence": 0.8 if pain else 0.5})
    return out


def extract(items: DataFrame, key: str, text: str, hook: Hook = rule_extractor, retries: int = 2, batch: int = 64) -> DataFrame:
    """(key, record fields, error): a record per row; values outside their enumerations take the middle one.

    A batch that fails is tried again, then row by row; a row that fails still has its error in place of a record.
    """

    def ask(texts: list[str]) -> list[dict]:
        for _ in range(retries):
            try:
                return [r or {} for r in hook(texts)]
            except Exception as e:  # noqa: BLE001
                error = str(e)
        return [{"error": error}] if len(texts) == 1 else [r for t in texts for r in ask([t])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                rows = []
                for r in ask([t or "" for t in part[text]]):
                    bad = r.get("error")
                    rows.append({"title": None if bad else r.get("title") or "", "description": None if bad else r.get("description") or "", "pain_point": None if bad else r.get("pain_point") or "", "use_case": None if bad else r.get("use_case") or "", "sentiment": None if bad else r.get("sentiment") if r.get("sentiment") in SENTIMENTS else "moderate", "emotion": None if bad else r.get("emotion") if r.get("emotion") in EMOTIONS else "neutral", "confidence": None if bad else min(1.0, max(0.0, float(r.get("confidence") or 0.0))), "error": bad})
                out = pd.DataFrame(rows)
                out.insert(0, key, part[key].to_numpy())
                yield out

    return items.select(key, text).mapInPandas(run, f"{key} {dict(items.dtypes)[key]}, {RECORD}")


def filter_noise(items: DataFrame, key: str, content: str, title: str, hook: Hook | None = None) -> DataFrame:
    """(key, verdict, reason, confidence): the rules first; what they pass is the hook's to judge.

    Without a hook it is relevant with 0.5, and with 0.3 where the hook fails: nothing is dropped for want of a model.
    """
    ruled = items.select(key, F.concat_ws("\n", title, content).alias("_t"), noise_verdict(F.col(content), F.col(title)).alias("v"))
    noise = ruled.where("v.verdict = 'noise'").select(key, "v.verdict", "v.reason", "v.confidence")
    rest = ruled.where("v.verdict <> 'noise'")
    if hook is None:
        return noise.unionByName(rest.select(key, F.lit("relevant").alias("verdict"), F.lit("").alias("reason"), F.lit(0.5).alias("confidence")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                said = hook(list(pdf["_t"]))
            except Exception as e:  # noqa: BLE001
                said = [{"verdict": "relevant", "reason": str(e), "confidence": 0.3}] * len(pdf)
            yield pd.DataFrame({key: pdf[key], "verdict": [(s or {}).get("verdict", "relevant") for s in said], "reason": [(s or {}).get("reason", "") for s in said], "confidence": [float((s or {}).get("confidence", 0.5)) for s in said]})

    return noise.unionByName(rest.select(key, "_t").mapInPandas(run, f"{key} {dict(items.dtypes)[key]}, verdict string, reason string, confidence double"))


def overlap_checker(texts: list[str]) -> list[dict | None]:
    """Verdict of {"claim", "sources"} objects by the share of the claim's words that the sources have."""
    out = []
    for t in texts:
        x = json.loads(t)
        words = set(re.findall(r"\w+", x["claim"].lower()))
        share = len(words & set(re.findall(r"\w+", " ".join(x["sources"]).lower()))) / max(len(words), 1)
        verdict = "supported" if share >= 0.8 else "partially" if share >= 0.5 else "unverifiable" if share >= 0.2 else "hallucination"
        out.append({"verdict": verdict, "confidence": round(max(share, 1 - share), 4)})
    return out


def figure_claims(texts: list[str]) -> list[list[dict]]:
    """Up to 12 sentences with a figure, word for word."""
    out = []
    for t in texts:
        found = [s.strip() for s in re.split(r"[.!?。！？\n]", t) if re.search(r"\d", s)]
        out.append([{"quote": q, "section": ""} for q in dict.fromkeys(found) if len(q) > 5][:12])
    return out


def extract_claims(reports: DataFrame, key: str, text: str, hook: Callable[[list[str]], list[list[dict] | None]] = figure_claims, most: int = 12, batch: int = 64) -> DataFrame:
    """(key, claim_id, quote, section, start, end, error): claims that the hook quotes from each report, with their places.

    An answer counts only whole: a list of at most `most` objects whose quotes are over 5 characters and stand in the
    report word for word. Otherwise the report has one row with the error, and no claims. A batch that fails is asked
    again report by report. Places count characters from 0, the first place of a quote. Reports of fewer than 50
    characters besides white space, and null ones, are not asked about.
    """

    def faults(items, body: str) -> str:
        if not isinstance(items, list):
            return "response is not a list"
        if len(items) > most:
            return f"response has more than {most} claims"
        for x in items:
            quote = x.get("quote") if isinstance(x, dict) else None
            if not isinstance(quote, str) or len(quote) <= 5:
                return "claim has no quote, or a short one"
            if quote not in body:
                return "claim quote is not in the report"
        return ""

    def said(texts: list[str]) -> list[tuple[list[dict] | None, str]]:
        try:
            answers = hook(texts)
            if len(answers) != len(texts):
                raise ValueError("number of answers differs")
            return [(a, "") for a in answers]
        except Exception as e:  # noqa: BLE001
            return [(None, str(e) or "hook failed")] if len(texts) == 1 else [x for t in texts for x in said([t])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part, rows = pdf.iloc[at : at + batch], []
                for k, body, (items, error) in zip(part[key], part[text], said(list(part[text])), strict=True):
                    if error := error or faults(items, body):
                        rows.append((k, None, None, None, None, error))
                        continue
                    rows += [(k, x["quote"], str(x.get("section", "")), body.find(x["quote"]), body.find(x["quote"]) + len(x["quote"]), "") for x in items]
                out = pd.DataFrame(rows, columns=[key, "quote", "section", "start", "end", "error"])
                yield out.astype({"start": "Int64", "end": "Int64"})

    asked = reports.select(key, text).where(F.length(F.trim(F.col(text))) >= 50)
    got = asked.mapInPandas(run, f"{key} {dict(reports.dtypes)[key]}, quote string, section string, start long, end long, error string")
    return got.select(key, F.when(F.col("error") == "", T.claim_id(F.col("quote"), F.col("section"), F.col("start"))).alias("claim_id"), "quote", "section", "start", "end", "error")


def claims_as_json(texts: list[str]) -> list[str]:
    """`figure_claims` as an experiment's hook."""
    return [json.dumps(c, ensure_ascii=False) for c in figure_claims(texts)]


def checks_as_json(inputs: list[str]) -> list[str]:
    """`overlap_checker` over all claims of {claims, sources} objects, as an experiment's hook."""
    out = []
    for x in map(json.loads, inputs):
        shown = [f"{s['title']} {s['content']}" for s in x["sources"]]
        said = overlap_checker([json.dumps({"claim": c["quote"], "sources": shown}) for c in x["claims"]])
        out.append(json.dumps(said))
    return out


def consistency_by_words(inputs: list[str]) -> list[str]:
    """A score of {body, claims} objects: lower for each claim that both denies and states."""
    count = lambda x: sum(bool(re.search(r"(?i)\b(?:never|not)\b.*\band\b", c["quote"])) for c in x["claims"])
    return [str(max(0, 100 - 60 * count(x))) for x in map(json.loads, inputs)]


def check_claims(claims: DataFrame, sources: DataFrame, report: str, hook: Hook = overlap_checker, most: int = 15, size: int = 200) -> DataFrame:
    """(report, claim_id, verdict, confidence) of claims (report, claim_id, quote) against their report's sources.

    Up to `most` sources of a report are shown, cut to `size` characters; without any a claim is unverifiable with 0.3.
    """
    from .windows import first_per_group

    shown = first_per_group(sources, [report], ["title"], most).groupBy(report).agg(F.array_sort(F.collect_list(F.left("content", F.lit(size)))).alias("sources"))
    j = claims.join(shown, report, "left")
    none = j.where("sources is null").select(report, "claim_id", F.lit("unverifiable").alias("verdict"), F.lit(0.3).alias("confidence"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said = hook(list(pdf["ask"]))
            yield pd.DataFrame({report: pdf[report], "claim_id": pdf["claim_id"], "verdict": [s["verdict"] for s in said], "confidence": [min(1.0, max(0.0, float(s["confidence"]))) for s in said]})

    asked = j.where("sources is not null").select(report, "claim_id", F.to_json(F.struct(F.col("quote").alias("claim"), "sources")).alias("ask"))
    return none.unionByName(asked.mapInPandas(run, f"{report} {dict(claims.dtypes)[report]}, claim_id string, verdict string, confidence double"))


def overlaps_by_index(asks: list[str]) -> list[str]:
    """`overlap_checker` over {claims: [{index, quote}], sources} objects: [{index, verdict, confidence}] as JSON."""
    out = []
    for x in map(json.loads, asks):
        said = overlap_checker([json.dumps({"claim": c["quote"], "sources": x["sources"]}) for c in x["claims"]])
        out.append(json.dumps([{"index": c["index"], **s} for c, s in zip(x["claims"], said, strict=True)]))
    return out


def _indexed(answer: str, wanted: list[int]) -> dict[int, dict]:
    """An answer by index; raises unless it is a list with each wanted index once, a known verdict and a confidence."""
    items = json.loads(answer)
    if not isinstance(items, list) or not all(isinstance(i, dict) for i in items):
        raise ValueError("answer is not a list of objects")
    if sorted(i.get("index", -1) if isinstance(i.get("index"), int) else -1 for i in items) != sorted(wanted):
        raise ValueError("indices are not complete and distinct")
    for i in items:
        if i.get("verdict") not in V.VERDICT:
            raise ValueError("verdict is not known")
        if isinstance(i.get("confidence"), bool) or not isinstance(i.get("confidence"), int | float):
            raise ValueError("confidence is no number")
    return {i["index"]: i for i in items}


def check_in_batches(claims: DataFrame, sources: DataFrame, report: str, hook: Callable[[list[str]], list[str]] = overlaps_by_index, per: int = 12, most: int = 15, size: int = 200) -> DataFrame:
    """(report, claim_id, verdict, confidence, error) of claims (report, claim_id, quote), asked about `per` at a time.

    The hook takes a list of {claims: [{index, quote}], sources} objects as JSON, and gives a list of answers
    [{index, verdict, confidence}]. An answer counts only if it has every index of its batch once; else, or if the hook
    fails, the batch is halved and asked again, down to single claims, which then have the error in place of a verdict.
    Of a report's sources (report, title, content) the first `most` by title are shown, cut to `size` characters.
    Without sources nothing is asked: unverifiable with 0.3. Null quotes are empty. claim_id is distinct in a report.
    """
    first = sources.select(report, F.struct(F.coalesce("title", F.lit("")).alias("title"), F.left(F.coalesce("content", F.lit("")), F.lit(size)).alias("content")).alias("s"))
    ranked = first.withColumn("_nth", F.row_number().over(Window.partitionBy(report).orderBy("s"))).where(F.col("_nth") <= most)
    shown = ranked.groupBy(report).agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: F.concat_ws(" ", x["title"], x["content"])).alias("sources"))
    rows = running(claims.select(report, "claim_id", F.coalesce("quote", F.lit("")).alias("quote")), [report], ["claim_id"], {"_nth": F.lit(1)})
    rows = rows.join(shown, report, "left")
    none = rows.where("sources IS NULL").select(report, "claim_id", F.lit("unverifiable").alias("verdict"), F.lit(0.3).alias("confidence"), F.lit(None).cast("string").alias("error"))
    batches = rows.where("sources IS NOT NULL").groupBy(report, F.floor((F.col("_nth") - 1) / per).alias("_batch")).agg(F.array_sort(F.collect_list(F.struct("_nth", "claim_id", "quote"))).alias("claims"), F.first("sources").alias("sources"))

    def ask(quotes: list[str], shown: list[str], at: int) -> list[tuple]:
        wanted = list(range(at, at + len(quotes)))
        try:
            body = json.dumps({"claims": [{"index": i, "quote": q} for i, q in zip(wanted, quotes, strict=True)], "sources": shown}, ensure_ascii=False)
            said = _indexed(hook([body])[0], wanted)
            return [(said[i]["verdict"], min(1.0, max(0.0, float(said[i]["confidence"]))), None) for i in wanted]
        except Exception as e:  # noqa: BLE001
            if len(quotes) == 1:
                return [(None, None, str(e) or "hook failed")]
            half = len(quotes) // 2
            return ask(quotes[:half], shown, at) + ask(quotes[half:], shown, at + half)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for name, group, shown in zip(pdf[report], pdf["claims"], pdf["sources"], strict=True):
                got = ask([c["quote"] for c in group], list(shown), 0)
                out += [(name, c["claim_id"], *g) for c, g in zip(group, got, strict=True)]
            yield pd.DataFrame(out, columns=[report, "claim_id", "verdict", "confidence", "error"])

    kinds = dict(claims.dtypes)
    asked = batches.mapInPandas(run, f"{report} {kinds[report]}, claim_id {kinds['claim_id']}, verdict string, confidence double, error string")
    return none.unionByName(asked)


def consistency(model_score):
    """Score of a report's consistency: halfway between full marks and the model's."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (100 + model_score) / 2))


def store_or_merge(needs: DataFrame, nearest: DataFrame, key: str, threshold: float = 0.85) -> DataFrame:
    """Needs with action: merged into the neighbour of (key, neighbour, score) at the threshold or above, or inserted."""
    near = nearest.where(F.col("score") >= threshold).groupBy(key).agg(F.max_by("neighbour", F.struct("score", "neighbour")).alias("neighbour"))
    return needs.join(near, key, "left").withColumn("action", F.when(F.col("neighbour").isNotNull(), "merged").otherwise("inserted"))


def detected(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows with marks of attempts to steer a model, to be kept from the hooks."""
    return texts.withColumn("found", T.injections(F.col(text))).where(F.size("found") > 0).select(key, "found")
