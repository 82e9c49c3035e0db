"""Numeric, map and JSON expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Price per million tokens (input, input from cache, output) by model.
PRICES = {
    "deepseek-v4-pro": (3.0, 0.025, 6.0),
    "deepseek-v4-flash": (1.008, 0.02, 2.016),
    "text-embedding-3-small": (0.0, 0.0, 0.0),
}
# Weights of enumerated judgements.
SENTIMENT = {"strong": 1.0, "moderate": 0.6, "mild": 0.3}
PLATFORM = {"github": 0.85, "stackoverflow": 0.80, "juejin": 0.70, "unknown": 0.40}
VERDICT = {"supported": 100.0, "partially": 60.0, "unverifiable": 40.0, "contradicted": 15.0, "hallucination": 0.0}
CLARITY = {"clear": 0.9, "partial": 0.65, "ambiguous": 0.4}
# Phases in the order in which a run passes them.
PHASES = ("crawl", "extract", "report", "archive", "distill", "complete")


def weight(name: Column, table: dict[str, float], default: float | None) -> Column:
    """Value of an enumerated name; the default for others and null."""
    out = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[name]
    return out if default is None else F.coalesce(out, F.lit(default))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, per_input double, per_cached double, per_output double")


def cost(model: Column, tokens_in: Column, tokens_out: Column, cached: Column, digits: int = 6) -> Column:
    """Cost of a call; 0 for unknown models."""
    per = [weight(model, {m: p[k] for m, p in PRICES.items()}, 0.0) for k in range(3)]
    return F.round((F.greatest(tokens_in - cached, F.lit(0)) * per[0] + cached * per[1] + tokens_out * per[2]) / 1e6, digits)


def cache_saving(model: Column, tokens_in: Column, cached: Column) -> Column:
    per = [weight(model, {m: p[k] for m, p in PRICES.items()}, 0.0) for k in range(2)]
    return F.least(cached, tokens_in) * (per[0] - per[1]) / 1e6


def range_score(value: Column, low: Column, high: Column) -> Column:
    """1 inside a range, less by the distance from its nearer end outside."""
    miss = F.when(value.between(low, high), 0.0).otherwise(F.least(F.abs(value - low), F.abs(value - high)))
    return F.greatest(F.lit(0.0), 1 - miss)


def composed(fact: Column, consistency: Column, source: Column) -> Column:
    """Weighted mean of the parts that there are; null without the fact score."""
    parts = ((fact, 0.45), (consistency, 0.30), (source, 0.25))
    total = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts), F.lit(0.0))
    share = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.when(fact.isNotNull(), total / share)


def progress(phase: Column) -> Column:
    """Percent of the phases reached; 0 for phases that are none."""
    return F.round(F.array_position(F.array(*map(F.lit, PHASES)), phase) / len(PHASES) * 100).cast("int")


def age(ts: Column, anchor: Column) -> Column:
    """How long ago in words: just now, minutes, hours, or the date."""
    s = F.unix_timestamp(anchor) - F.unix_timestamp(ts)
    return (
        F.when(s < 60, "just now")
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" h")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def json_or(text: Column, schema: str, default: Column) -> Column:
    """Parsed JSON, the default where it does not parse."""
    return F.coalesce(F.from_json(text, schema), default)


def unwrapped(text: Column) -> Column:
    """First record of a reply as JSON text: of an array, or of the first list under a known envelope key, or itself."""
    keys = ("requirements", "demands", "items", "data", "result")
    return F.coalesce(F.get_json_object(text, "$[0]"), *(F.get_json_object(text, f"$.{k}[0]") for k in keys), text)


def merged(base: Column, patch: Column) -> Column:
    """Map with the patch's entries over the base's."""
    base = F.map_filter(base, lambda k, _: ~F.map_contains_key(patch, k))
    return F.map_concat(base, patch)


def _balanced(text: str) -> str | None:
    for start, end in ("{}", "[]"):
        at = text.find(start)
        depth = 0
        for i in range(at, len(text)) if at >= 0 else ():
            depth += (text[i] == start) - (text[i] == end)
            if depth == 0:
                try:
                    return json.dumps(json.loads(text[at : i + 1]), ensure_ascii=False)
                except ValueError:
                    break
    return None


@F.pandas_udf(StringType())
def tolerant_json(texts: pd.Series) -> pd.Series:
    """JSON found in a model's reply, as text: whole, fenced, or the first balanced object or array (Arrow UDF)."""

    def find(text: str | None) -> str | None:
        if text is None:
            return None
        body = text.strip()
        if body.startswith("```"):
            body = re.sub(r"\n?```$", "", re.sub(r"^```\w*\n?", "", body)).strip()
        fenced = re.search(r"```(?:json)?\s*\n?(.*?)\n?```", body, re.S)
        for part in (body, fenced and fenced[1].strip()):
            try:
                if part:
                    return json.dumps(json.loads(part), ensure_ascii=False)
            except ValueError:
                pass
        return _balanced(body)

    return texts.map(find)
