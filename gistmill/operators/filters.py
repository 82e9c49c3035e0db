"""Row predicates: noise rules, search, optional conjuncts, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def noise_verdict(content: Column, title: Column) -> Column:
    """struct(verdict, reason, confidence) of the noise rules; the first that holds decides.

    Too short, too long, off topic, or lines of which fewer than three in ten differ; else relevant with 0.7.
    """
    both = F.concat(F.lower(F.coalesce(content, F.lit(""))), F.lit(" "), F.lower(F.coalesce(title, F.lit(""))))
    # the words have no case, so they are looked for as they stand; the list of hits is made for rows that have one
    plain = F.concat_ws(" ", F.coalesce(content, F.lit("")), F.coalesce(title, F.lit("")))
    off_topic = reduce(lambda a, b: a | b, (F.contains(plain, F.lit(k)) for k in T.OFF_TOPIC))
    hits = F.filter(F.array(*map(F.lit, T.OFF_TOPIC)), lambda k: F.contains(plain, k))
    lines = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), T.strip), lambda x: x != "")
    say = lambda verdict, reason, sure: F.struct(F.lit(verdict).alias("verdict"), reason.alias("reason"), F.lit(sure).alias("confidence"))
    return (
        F.when(F.length(T.strip(both)) < 60, say("noise", F.lit("内容过短 (<60字符)"), 0.95))
        .when(F.length(both) > 50000, say("noise", F.lit("内容过长 (>50000字符)"), 0.85))
        .when(off_topic, say("noise", F.concat(F.lit("包含非技术关键词: "), F.array_join(F.slice(hits, 1, 3), ", ")), 0.90))
        .when(T.once(lines, lambda x: (F.size(x) > 3) & (F.size(F.array_distinct(x)) / F.size(x) < 0.3)), say("noise", F.lit("疑似重复/垃圾内容"), 0.85))
        .otherwise(say("relevant", F.lit(""), 0.7))
    )


def split_noise(items: DataFrame, verdict: Column) -> tuple[DataFrame, DataFrame]:
    return items.where(verdict != "noise"), items.where(verdict == "noise")


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows equal in every column given a value other than None; a list means any of its values."""
    tests = (F.col(c).isin(v) if isinstance(v, (list, tuple)) else F.col(c) == v for c, v in wanted.items() if v is not None)
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def search(docs: DataFrame, keyword: str = "", platform: str = "", sentiment: str = "") -> DataFrame:
    """Documents (title, keywords, platform, sentiment) by keyword in title or keywords, platform and sentiment.

    A document without sentiment counts as moderate; an empty argument does not filter.
    """
    tests = []
    if keyword:
        k = F.lit(keyword.lower())
        tests.append(F.contains(F.lower("title"), k) | F.coalesce(F.exists("keywords", lambda x: F.contains(F.lower(x), k)), F.lit(False)))
    if platform:
        tests.append(F.col("platform") == platform)
    if sentiment:
        tests.append(F.coalesce(F.nullif(F.col("sentiment"), F.lit("")), F.lit("moderate")) == sentiment)
    return docs.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def since(df: DataFrame, ts: str, anchor: Column, days: int) -> DataFrame:
    """Rows of the last days before an anchor time."""
    return df.where(F.col(ts) >= anchor - F.make_dt_interval(F.lit(days)))


def approved(items: DataFrame, flag: str = "approved") -> DataFrame:
    return items.where(F.coalesce(F.col(flag), F.lit(True)))


def has_failed(stages: Column) -> Column:
    """Whether a map of stage structs (status, configurations: map of structs with status) holds a failure."""
    inner = lambda s: F.coalesce(F.exists(F.map_values(s["configurations"]), lambda c: c["status"] == "failed"), F.lit(False))
    return F.exists(F.map_values(stages), lambda s: (s["status"] == "failed") | inner(s))


def sheet_errors(sheet: DataFrame, key: str, enums: dict[str, list[str]], required_if: dict[str, Column]) -> DataFrame:
    """(key, error) rows: values outside their enumeration, and empty columns where a condition asks for them."""
    bad = [F.when(~F.coalesce(F.col(c), F.lit("")).isin(v), F.lit(f"{c}: not allowed")) for c, v in enums.items()]
    bad += [F.when(when & (F.coalesce(T.strip(F.col(c)), F.lit("")) == ""), F.lit(f"{c}: missing")) for c, when in required_if.items()]
    return sheet.select(key, F.explode(F.array_compact(F.array(*bad))).alias("error"))


def forbidden_paths(schema, words: tuple[str, ...] = ("author",), exact: tuple[str, ...] = ("claims", "annotation_status"), path: str = "") -> list[str]:
    """Field paths of a schema whose names are forbidden; read off the schema, so no data is scanned."""
    from pyspark.sql import types as P

    if isinstance(schema, P.StructType):
        out = []
        for f in schema.fields:
            here = f"{path}.{f.name}".lstrip(".")
            out += [here] * (any(w in f.name.lower() for w in words) or f.name in exact)
            out += forbidden_paths(f.dataType, words, exact, here)
        return out
    if isinstance(schema, P.ArrayType):
        return forbidden_paths(schema.elementType, words, exact, path)
    if isinstance(schema, P.MapType):
        return forbidden_paths(schema.valueType, words, exact, path)
    return []
