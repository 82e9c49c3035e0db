"""Claims in reports: extraction by rule, near-duplicates, suggestions, clusters of needs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..kept import dropped, kept
from .evaluation import fit_kind, scored

CLAIM = r"\d+\.\s*\*\*(.{10,150}?)\*\*"


def rule_quotes(body: Column) -> Column:
    """Bold numbered items of a report, without colons at their ends, equal ones once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(CLAIM), F.lit(1)), lambda q: F.regexp_replace(T.strip(q), "[：:]+$", "")))


def rule_claims(reports: DataFrame, key: str, body: str, section: str = "核心发现") -> DataFrame:
    """(key, pos, quote, start, claim_id) of bold numbered items, equal ones of a report once; start counts from 0."""
    each = reports.select(key, F.col(body).alias("_body"), F.posexplode(rule_quotes(F.col(body))).alias("pos", "quote"))
    start = (F.position(F.col("quote"), F.col("_body")) - 1).cast("int")
    return each.select(key, "pos", "quote", start.alias("start"), T.claim_id(F.col("quote"), F.lit(section), start).alias("claim_id"))


def distinct_claims(claims: DataFrame, key: str, threshold: float = 0.8) -> DataFrame:
    """(key, quotes): each report's claims in order, without those too like one kept before.

    A report's claims are one row's array, so the fold is local to a row.
    """
    listed = claims.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "quote"))), lambda x: x["quote"]).alias("quotes"))
    fold = F.aggregate("quotes", F.array().cast("array<string>"), lambda kept, q: F.when(F.exists(kept, lambda k: T.char_jaccard(k, q) > threshold), kept).otherwise(F.array_append(kept, q)))
    return listed.select(key, fold.alias("quotes"))


def suggestions(claims: DataFrame) -> DataFrame:
    """A row per claim that asks for a correction or a review."""
    bad = F.col("verdict").isin("hallucination", "contradicted")
    kind = F.when(bad, "correction").when(F.col("verdict") == "partially", "review")
    why = F.when(bad, "该声明与来源数据不符").otherwise("部分内容缺乏数据支撑")
    action = F.when(bad, "建议删除或修正该声明，确保与原始数据一致").otherwise("建议补充具体来源或限定表述范围")
    return claims.where(kind.isNotNull()).select(kind.alias("type"), F.col("text").alias("claim"), "verdict", F.coalesce(F.nullif("evidence", F.lit("")), why).alias("reason"), action.alias("action"))


def seeds(words: DataFrame) -> DataFrame:
    """(by, id) of the rows that no earlier seed shares a word with, from distinct (by, id, word); ids in order within by.

    Found in rounds: an open row that is the smallest open one under each of its words is a seed, for no row before it
    that shares a word can become one any more; the rows that share a word with it are closed. So the rounds follow the
    longest chain of rows that wait for each other, not the rows. Each round's open words are a written table.
    """
    open_, found = kept(words, "words"), []
    while not open_.isEmpty():
        least = open_.groupBy("by", "word").agg(F.min("id").alias("_least"))
        marked = open_.join(least, ["by", "word"])
        fresh = kept(marked.groupBy("by", "id").agg(F.bool_and(F.col("id") == F.col("_least")).alias("seed")).where("seed").select("by", "id"), "seeds")
        found.append(fresh)
        taken = open_.join(fresh, ["by", "id"], "left_semi").select("by", "word")
        closed = open_.join(taken, ["by", "word"], "left_semi").select("by", "id").distinct()
        rest = kept(open_.join(closed, ["by", "id"], "left_anti"), "words")
        dropped(open_)
        open_ = rest
    dropped(open_)
    return reduce(DataFrame.unionByName, found) if found else words.select("by", "id").where("false")


def seed_clusters(needs: DataFrame, by: str, key: str, title: str) -> DataFrame:
    """(by, key, cluster) of greedy clusters of each group, in key order, at most eight.

    A need joins the first seed with which it shares a word of three characters or more; a need that shares none with
    the seeds before it is a seed, as is one without words. Of more than eight clusters the seven largest stay, numbered
    by size and then by their first need, and the others are the eighth; else they are numbered by their first need.
    Groups of up to three are one cluster. A null group is none; keys are distinct within a group.
    Seeds share no word with each other, so a word leads to one seed, whose cluster is found by a join.
    """
    rows = kept(needs.where(F.col(by).isNotNull()).select(F.col(by).alias("by"), F.col(key).alias("id"), title), "needs")
    tokens = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(title), F.lit(""))), r"(?U)\s+"), lambda w: F.length(w) >= 3))
    words = kept(rows.select("by", "id", F.explode(tokens).alias("word")), "words")
    first = seeds(words).withColumn("seed", F.col("id"))
    owner = words.join(first.select("by", "id", "seed"), ["by", "id"]).select("by", "word", "seed")
    joined = words.join(owner, ["by", "word"]).groupBy("by", "id").agg(F.min("seed").alias("seed"))
    placed = kept(rows.select("by", "id").join(joined, ["by", "id"], "left").withColumn("seed", F.coalesce("seed", "id")), "placed")

    sizes = placed.groupBy("by", "seed").agg(F.count(F.lit(1)).alias("many"))
    groups = sizes.groupBy("by").agg(F.sum("many").alias("rows"), F.count(F.lit(1)).alias("clusters"))
    told = sizes.join(groups, "by")
    rank = lambda *order: (F.row_number().over(Window.partitionBy("by").orderBy(*order)) - 1).alias("cluster")
    few = told.where("rows > 3 AND clusters <= 8").select("by", "seed", rank("seed"))
    large = told.where("rows > 3 AND clusters > 8").select("by", "seed", rank(F.desc("many"), "seed")).where("cluster < 7")
    numbered = placed.join(groups, "by").join(few.unionByName(large), ["by", "seed"], "left")
    cluster = F.when(F.col("rows") <= 3, 0).otherwise(F.coalesce("cluster", F.lit(7)))
    return numbered.select(F.col("by").alias(by), F.col("id").alias(key), cluster.cast("int").alias("cluster"))


def opportunities(needs: DataFrame, by: str, key: str, title: str) -> tuple[DataFrame, DataFrame]:
    """Opportunities of the clusters of two needs and more, and what they contain.

    The first: (by, cluster, title, description, n, score, status), the title that of the first need, up to 300
    characters, the score as in `evaluation.scored`. The second: edges (source_type, source_id, link_type, target_type,
    target_id) from each opportunity, named by/cluster, to its needs. Titles are looked at one by one and counted, so a
    cluster's texts never come together.
    """
    placed = kept(seed_clusters(needs, by, key, title), "clusters")
    joined = placed.join(needs.select(by, key, F.col(title).alias("_title")), [by, key])
    rows = joined.groupBy(by, "cluster").agg(F.count(F.lit(1)).alias("n"), F.min_by("_title", key).alias("_first"), F.min(fit_kind(F.col("_title"))).alias("_kind")).where("n >= 2")
    text = F.concat(F.lit("基于 "), F.col("n").cast("string"), F.lit(" 条相关需求聚合"))
    made = rows.select(by, "cluster", F.left(F.coalesce("_first", F.lit("")), F.lit(300)).alias("title"), text.alias("description"), "n", scored(F.col("_kind"), F.col("n")).alias("score"), F.lit("scored").alias("status"))
    name = F.concat_ws("/", F.col(by).cast("string"), F.col("cluster").cast("string"))
    edges = placed.join(rows.select(by, "cluster"), [by, "cluster"]).select(
        F.lit("opportunity").alias("source_type"), name.alias("source_id"), F.lit("contains").alias("link_type"), F.lit("requirement").alias("target_type"), F.col(key).cast("string").alias("target_id")
    )
    return made, edges
