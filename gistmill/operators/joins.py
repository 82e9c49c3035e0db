"""Joins: incremental, set difference, comparison, lookup and merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..kept import kept


def unseen(items: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose keys are not known yet; copies within the batch stay."""
    return items.join(known.select(*keys).distinct(), keys, "left_anti")


def key_mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: (key, side). Empty where the key sets are equal."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def compare_fields(first: DataFrame, second: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, first, second, agreed) for every field of every shared key."""
    a = first.select(key, *(F.col(f).cast("string").alias(f"a_{f}") for f in fields))
    b = second.select(key, *(F.col(f).cast("string").alias(f"b_{f}") for f in fields))
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("first"), F.col(f"b_{f}").alias("second")) for f in fields))
    return a.join(b, key).select(key, F.inline(pairs)).withColumn("agreed", F.col("first").eqNullSafe(F.col("second")))


def lookup(rows: DataFrame, table: DataFrame, key: str, columns: list[str], other: str | None = None) -> DataFrame:
    """Rows with columns of the table row of their key, null where there is none."""
    found = table.select(F.col(other or key).alias("_key"), *columns)
    return rows.join(found, rows[key] == found["_key"], "left").drop("_key")


def by_title(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(title, filename, tier) of the document for each title: same file name, same normal form, or one in the other.

    asked has title; docs has filename and title. The first tier with a match decides, then the first file name. The
    last tier compares only titles still open, with documents of the same first three characters in either; a key of
    fewer characters meets every key that holds it, an empty one all.
    """
    asked = asked.select("title").distinct()
    d = docs.select("filename", F.col("title").alias("doc_title"), T.title_key(F.col("title")).alias("doc_key"))
    q = asked.withColumn("file", T.safe_filename(F.col("title"))).withColumn("key", T.title_key(F.col("title")))
    same = q.join(d.select("filename").distinct(), q["file"] == F.col("filename")).select("title", "filename", F.lit(1).alias("tier"))
    # of documents with one key only the first file name can be the answer
    d = kept(d.groupBy("doc_key").agg(F.min("filename").alias("filename")).withColumn("doc_id", F.monotonically_increasing_id()), "titles")
    alike = q.join(d, q["key"] == d["doc_key"]).select("title", "filename", F.lit(2).alias("tier"))
    rest = q.join(same.unionByName(alike).select("title").distinct(), "title", "left_anti")
    # a key inside another has all its three-character blocks there, so it is looked for under the one that fewest of the
    # others hold. Keys under three characters are blocks of their own, which meet the empty string, the characters and
    # pairs of characters of the other side
    few = lambda k: T.once(F.split(k, ""), lambda c: F.flatten(F.array(F.array(F.lit("")), _blocks(c, 1), _blocks(c, 2))))
    keys = kept(rest.select("key").distinct().withColumn("key_id", F.monotonically_increasing_id()), "keys")
    texts, asks = d.select(F.col("doc_id").alias("id"), F.col("doc_key").alias("text")), keys.select(F.col("key_id").alias("id"), F.col("key").alias("text"))
    inner = _held(asks, texts).toDF("key_id", "doc_id").unionByName(_held(texts, asks).toDF("doc_id", "key_id")).distinct()
    near = rest.select("title", "key").join(keys, "key").join(inner, "key_id").join(d.select("filename", "doc_id"), "doc_id").select("title", "filename")
    held = d.select("filename", F.explode(few(F.col("doc_key"))).alias("at")).groupBy("at").agg(F.min("filename").alias("filename"))
    short_asked = rest.where(F.length("key") < 3).join(held, F.col("key") == F.col("at")).select("title", "filename")
    short_docs = rest.withColumn("at", F.explode(few(F.col("key")))).join(d.where(F.length("doc_key") < 3), F.col("at") == F.col("doc_key")).select("title", "filename")
    near = near.unionByName(short_asked).unionByName(short_docs).withColumn("tier", F.lit(3))
    best = Window.partitionBy("title").orderBy("tier", "filename")
    return same.unionByName(alike).unionByName(near.distinct()).withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def _blocks(chars: Column, n: int) -> Column:
    """Distinct runs of n characters of an array of characters, none if it is shorter."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))), lambda i: F.concat(*(chars[i + k] for k in range(n))))
    return F.when(F.size(chars) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _held(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole) ids of texts (id, text) of three characters or more, the one inside the other.

    A part longer than every whole is out at once. Blocks of the wholes that no part can have, by a hash of 20 bits, are
    dropped where they are made; what moves is ids and blocks, and texts for the pairs that share a rarest block.
    """
    at = F.explode(T.once(F.split("text", ""), lambda c: _blocks(c, 3))).alias("at")
    mark = F.pmod(F.xxhash64("at"), F.lit(1 << 20)).alias("mark")
    most = wholes.agg(F.max(F.length("text")).alias("most"))
    small = parts.crossJoin(F.broadcast(most)).where(F.length("text") <= F.col("most")).select("id", at)
    placed = wholes.select(F.col("id").alias("whole"), at).withColumn("mark", mark).join(F.broadcast(small.select(mark).distinct()), "mark", "left_semi")
    sizes = placed.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    rarest = small.join(sizes, "at", "left").groupBy("id").agg(F.min_by("at", F.coalesce("n", F.lit(0))).alias("at"))
    met = rarest.join(placed, "at").select(F.col("id").alias("part"), "whole")
    told = met.join(parts.select(F.col("id").alias("part"), F.col("text").alias("_part")), "part").join(wholes.select(F.col("id").alias("whole"), F.col("text").alias("_whole")), "whole")
    return told.where(F.contains("_whole", F.col("_part"))).select("part", "whole")


def held_out(items: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(excluded.select(*keys).distinct(), keys, "left_anti")


def merged_decisions(first: DataFrame, second: DataFrame, human: DataFrame, key: str, field: str) -> DataFrame:
    """(key, value, source): what both say, else the human's word if there is one, else the first's."""
    j = first.select(key, F.col(field).alias("a")).join(second.select(key, F.col(field).alias("b")), key).join(human.select(key, F.col(field).alias("h")), key, "left")
    source = F.when(F.col("a").eqNullSafe(F.col("b")), "agent_a").when(F.col("h").isNull(), "agent_a").when(F.col("h") == F.col("a"), "agent_a").when(F.col("h") == F.col("b"), "agent_b").otherwise("human_override")
    return j.select(key, F.coalesce(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("a")), "h", "a").alias("value"), source.alias("adjudication_source"))


def matched_last(gold: DataFrame, predicted: DataFrame, key: str, order: str) -> DataFrame:
    """Full outer join of gold with the last prediction of each key; in_gold and in_predicted tell the sides."""
    last = predicted.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n", order)
    return gold.withColumn("in_gold", F.lit(True)).join(last.withColumn("in_predicted", F.lit(True)), key, "full_outer").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("in_gold", "in_predicted")})


def first_stage(docs: DataFrame, key: str, stages: list[str]) -> DataFrame:
    """Of each key the document in the first of some stages that has it."""
    nth = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    return docs.where(nth > 0).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(nth))).where("_n = 1").drop("_n")


def transitions(base: DataFrame, other: DataFrame, gold: DataFrame, key: str, field: str) -> DataFrame:
    """(key, change): improved, worsened or unchanged correctness from one configuration to another."""
    j = gold.select(key, F.col(field).alias("g")).join(base.select(key, F.col(field).alias("x")), key).join(other.select(key, F.col(field).alias("y")), key)
    was, now = F.col("x").eqNullSafe(F.col("g")), F.col("y").eqNullSafe(F.col("g"))
    return j.select(key, F.when(~was & now, "improved").when(was & ~now, "worsened").otherwise("unchanged").alias("change"))


def backlinked(docs: DataFrame, refs: DataFrame) -> DataFrame:
    """Documents (title, links) with the links of refs (title, link) added where they lack them."""
    new = refs.groupBy("title").agg(F.array_sort(F.collect_set("link")).alias("_new"))
    return docs.join(new, "title", "left").withColumn("links", F.array_union(F.coalesce("links", F.array().cast("array<string>")), F.coalesce("_new", F.array().cast("array<string>")))).drop("_new")

