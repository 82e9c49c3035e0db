"""Queries of joins, edges, pages, sets, quotas and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..operators import claims as C
from ..operators import evaluation as E
from ..operators import filters as P
from ..operators import graph as G
from ..operators import joins as J
from ..operators import upserts as U
from ..operators import windows as W
from ..session import load
from ..sources import files
from . import standins as S
from .registry import query


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unseen_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.unseen(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id")


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'right' END AS side, count(*) AS count FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL GROUP BY 1")
def key_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.key_mismatch(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "doc_id").groupBy("side").agg(F.count(F.lit(1)).alias("count"))


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def gate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.lookup(load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer"), "o_custkey", ["c_name", "c_mktsegment"], "c_custkey").select("o_orderkey", "c_name", "c_mktsegment")


TITLED = """q AS (SELECT DISTINCT upper(n_name) AS title FROM nation UNION SELECT p_name FROM part WHERE p_size = 1 UNION SELECT c_mktsegment || '_' FROM customer), d AS (SELECT n_name || '.md' AS filename, n_name AS title FROM nation UNION ALL SELECT 'x' || r_name, r_name FROM region UNION ALL SELECT DISTINCT 'seg ' || c_mktsegment, c_mktsegment FROM customer)"""
KEY = "regexp_replace(trim(lower({0})), '[\\s\\-_]+', ' ', 'g')"


@query(f"""WITH {TITLED}, m AS (SELECT q.title, d.filename, CASE WHEN left(regexp_replace(q.title, '[<>:"/\\\\|?*]', '', 'g'), 80) = d.filename THEN 1 WHEN {KEY.format('q.title')} = {KEY.format('d.title')} THEN 2 WHEN contains({KEY.format('q.title')}, {KEY.format('d.title')}) OR contains({KEY.format('d.title')}, {KEY.format('q.title')}) THEN 3 END AS tier FROM q, d)
  SELECT title, filename, tier FROM m WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title ORDER BY tier, filename) = 1""")
def title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.by_title(*_titles(spark, sf_dir, load(spark, sf_dir, "part").where("p_size = 1")))


def _titles(spark: SparkSession, sf_dir: str, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    n, seg = load(spark, sf_dir, "nation"), load(spark, sf_dir, "customer").select("c_mktsegment").distinct()
    asked = n.select(F.upper("n_name").alias("title")).union(parts.select("p_name")).union(seg.select(F.concat("c_mktsegment", F.lit("_"))))
    docs = n.select(F.concat("n_name", F.lit(".md")).alias("filename"), F.col("n_name").alias("title"))
    return asked, docs.union(load(spark, sf_dir, "region").select(F.concat(F.lit("x"), "r_name"), "r_name")).union(seg.select(F.concat(F.lit("seg "), "c_mktsegment"), "c_mktsegment"))


ALL_TITLED = TITLED.replace(" WHERE p_size = 1", "").removesuffix(")") + " UNION ALL SELECT DISTINCT 'type ' || p_type, p_type FROM part UNION ALL SELECT CAST(doc_id AS VARCHAR) || '.md', split_part(text, chr(10), 1) FROM documents), qk AS (SELECT title, {0} AS k FROM q), dk AS (SELECT filename, {1} AS k FROM d)".format(KEY.format("title"), KEY.format("title"))


@query(f"""WITH {ALL_TITLED}, m AS (SELECT title, filename, CASE WHEN left(regexp_replace(title, '[<>:"/\\|?*]', '', 'g'), 80) = filename THEN 1 WHEN qk.k = dk.k THEN 2 WHEN contains(qk.k, dk.k) OR contains(dk.k, qk.k) THEN 3 END AS tier FROM qk, dk)
  SELECT title, filename, tier FROM m WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY title ORDER BY tier, filename) = 1""")
def title_lookup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of all parts, looked up among part types and the first lines of all documents too."""
    asked, docs = _titles(spark, sf_dir, load(spark, sf_dir, "part"))
    types = load(spark, sf_dir, "part").select(F.concat(F.lit("type "), "p_type"), "p_type").distinct()
    return J.by_title(asked, docs.union(types).union(S.needs(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")), "title")))


@query(f"WITH {S.EDGES} SELECT *, 'outgoing' AS direction FROM edges WHERE source_type = 'customer' AND source_id = '7' UNION ALL SELECT *, 'incoming' FROM edges WHERE target_type = 'customer' AND target_id = '7'")
def edge_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbors(S.edges(spark, sf_dir), "customer", "7")


@query(f"WITH {S.EDGES} SELECT link_type, target_type, count(*) AS count, count(DISTINCT source_id) AS sources FROM edges GROUP BY 1, 2")
def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.edges(spark, sf_dir).groupBy("link_type", "target_type").agg(F.count(F.lit(1)).alias("count"), F.count_distinct("source_id").alias("sources"))


MIGRATE = """c AS (SELECT 'order' AS source_type, CAST(l_orderkey AS VARCHAR) AS source_id, 'contains' AS link_type, 'part' AS target_type, CAST(l_partkey AS VARCHAR) AS target_id FROM lineitem), e AS (SELECT 'order' AS source_type, CAST(l_orderkey AS VARCHAR) AS source_id, 'contains' AS link_type, 'part' AS target_type, CAST(l_partkey AS VARCHAR) AS target_id FROM lineitem WHERE l_linenumber = 1)"""


@query(f"WITH {MIGRATE} SELECT * FROM c EXCEPT SELECT * FROM e")
def edge_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    ids = li.groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.col("l_partkey").cast("string"))).alias("ids"))
    there = li.where("l_linenumber = 1").select(F.lit("order").alias("source_type"), F.col("l_orderkey").cast("string").alias("source_id"), F.lit("contains").alias("link_type"), F.lit("part").alias("target_type"), F.col("l_partkey").cast("string").alias("target_id"))
    return G.new_edges(there, G.edges_from_ids(ids, "order", "l_orderkey", "ids", "contains", "part"))


@query(f"WITH {S.EDGES} SELECT count(*) AS kept FROM edges WHERE NOT ((source_type = 'nation' AND source_id = '3') OR (target_type = 'nation' AND target_id = '3'))")
def edge_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.without_entity(S.edges(spark, sf_dir), "nation", "3").agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT s_suppkey, 'nation ' || CAST(s_nationkey AS VARCHAR) AS target_id FROM supplier")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").withColumn("refs", F.array(F.concat(F.lit("[[nations/"), F.col("s_nationkey").cast("string"), F.lit("|nation "), F.col("s_nationkey").cast("string"), F.lit("]]"))))
    return G.edges_from_links(s, "supplier", "s_suppkey", "refs", "references", "nation").select(F.col("source_id").cast("long").alias("s_suppkey"), "target_id")


@query("""WITH i AS (SELECT 'requirement' AS name, count(*) AS n FROM documents UNION ALL SELECT 'raw_discussion', count(*) FROM pages UNION ALL SELECT 'proposal', count(*) FROM part UNION ALL SELECT 'crawl_task', count(DISTINCT conv_id) FROM conversations
  UNION ALL SELECT 'verification', count(*) FROM labels UNION ALL SELECT 'stranger', count(*) FROM nation) SELECT name, 'database' AS storage, n FROM i WHERE name IN ('proposal', 'crawl_task', 'verification')""")
def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each kind that is registered as living in the database with a status; others are no such entities."""
    sizes = {"requirement": "documents", "raw_discussion": "pages", "proposal": "part", "crawl_task": "conversations", "verification": "labels", "stranger": "nation"}
    rows = None
    for kind, table in sizes.items():
        n = F.count_distinct("conv_id") if table == "conversations" else F.count(F.lit(1))
        one = load(spark, sf_dir, table).agg(F.lit(kind).alias("name"), n.alias("n"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.join(F.broadcast(G.entities(spark, "database", "HasStatus")), "name").select("name", "storage", "n")


@query(f"""WITH {S.NEEDS}, r AS (SELECT platform, doc_id, CASE WHEN length(title) > 25 THEN left(title, 25) || '...' ELSE title END AS t, row_number() OVER (PARTITION BY platform ORDER BY doc_id) AS n FROM needs) SELECT platform, string_agg(t, chr(10) ORDER BY doc_id) AS lines FROM r WHERE n <= 8 GROUP BY platform""")
def relationship_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.relationship_lines(S.needs(spark, sf_dir), "platform", "title", "doc_id")


@query("SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def paged_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return W.page(o, [F.desc("o_orderdate"), "o_orderkey"], 3, 20)


@query("SELECT p_partkey, p_name, p_size FROM (SELECT p_partkey, p_name, p_size FROM part ORDER BY p_name, p_partkey LIMIT 25 OFFSET 25) ORDER BY p_size DESC, p_name")
def page_then_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.page_then_sort(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), ["p_name", "p_partkey"], [F.desc("p_size"), "p_name"], 2, 25)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
def top_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(30).select("p_partkey", "p_retailprice")


@query("(SELECT c_custkey, c_acctbal, 'gain' AS direction FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 5) UNION ALL (SELECT c_custkey, c_acctbal, 'loss' FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal, c_custkey LIMIT 5)")
def gains_and_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.extremes(load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 5)


@query("WITH a AS (SELECT 0 AS stage_no, n_name AS name FROM nation UNION ALL SELECT 1, r_name FROM region UNION ALL SELECT 2, s_name FROM supplier) SELECT * FROM a ORDER BY stage_no, name LIMIT 20 OFFSET 20")
def staged_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [load(spark, sf_dir, t).select(F.col(c).alias("name")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"))]
    return W.staged(parts).orderBy("stage_no", "name").offset(20).limit(20)


@query("WITH s AS (SELECT p_brand, count(*) AS size, min(p_partkey) AS first_at FROM part GROUP BY 1) SELECT p_brand, size, CAST(least(row_number() OVER (ORDER BY size DESC, first_at), 8) AS INTEGER) AS cluster FROM s")
def cluster_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("size"), F.min("p_partkey").alias("first_at"))
    return W.capped_clusters(sizes, [F.desc("size"), "first_at"]).select("p_brand", "size", "cluster")


@query("SELECT * FROM orders WHERE o_orderkey = 33")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").where("o_orderkey = 33").limit(1)


@query("WITH q AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) SELECT doc_id, lang, left(sha256(source || ':' || CAST(doc_id AS VARCHAR)), 16) AS id FROM q WHERE n <= CASE lang WHEN 'en' THEN 34 WHEN 'de' THEN 33 WHEN 'fr' THEN 33 ELSE 0 END")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import short_id

    quotas = spark.createDataFrame([("en", 34), ("de", 33), ("fr", 33)], "lang string, quota int")
    some = W.quota_sample(load(spark, sf_dir, "documents"), quotas, "lang", ["doc_id"], most=34)
    return some.select("doc_id", "lang", short_id(F.col("source"), F.col("doc_id").cast("string")).alias("id"))


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = J.held_out(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), ["text"])
    return J.held_out(d, load(spark, sf_dir, "labels").where("toxic = 1"), ["doc_id"]).select("doc_id")


@query("SELECT text AS key, arg_max(doc_id, doc_id) AS value, min(doc_id) AS place FROM documents GROUP BY text")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.col("text").alias("key"), F.col("doc_id").alias("value"), F.col("doc_id").alias("place"))
    return W.last_wins(d, ["key"], "place", ["value"])


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.first_per_group(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], 3)


@query("WITH d AS (SELECT CAST(ts AS DATE) AS d, round(sum(value), 4) AS v FROM events GROUP BY 1), b AS (SELECT d, v, max(v) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM d), m AS (SELECT *, coalesce(v > best, TRUE) AS improved FROM b), g AS (SELECT *, sum(CAST(improved AS INTEGER)) OVER (ORDER BY d) AS run FROM m) SELECT strftime(d, '%Y-%m-%d') AS day, v, best AS best_before, improved, CAST(row_number() OVER (PARTITION BY run ORDER BY d) - 1 AS INTEGER) AS stale FROM g")
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = load(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.round(F.sum("value"), 4).alias("v"))
    return W.best_so_far(by, "day", "v")


@query("SELECT o_custkey, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 4) AS change FROM orders")
def verification_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return W.history(o, "o_custkey", "at", "o_totalprice").select("o_custkey", "o_orderkey", F.round("change", 4).alias("change"))


@query("SELECT s_suppkey, s_nationkey, CAST(floor(n / 2) AS INTEGER) AS bundle, CASE CAST(n % 3 AS INTEGER) WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END AS length_bucket FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n FROM supplier)")
def ranked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = W.bundles(load(spark, sf_dir, "supplier"), ["s_nationkey"], ["s_suppkey"])
    return b.select("s_suppkey", "s_nationkey", "bundle", F.when(F.col("ordinal") % 3 == 0, "short").when(F.col("ordinal") % 3 == 1, "medium").otherwise("long").alias("length_bucket"))


@query("SELECT event_type, user_id, arg_max(props, (ts, event_id)) AS value, count(*) AS source_count, round(least(1.0, 0.5 + 0.05 * (count(*) - 1)), 4)::DOUBLE AS confidence FROM events GROUP BY 1, 2")
def knowledge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    # two batches, one after the other in time, cut in the middle of the table's days
    cut = F.broadcast(e.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2").alias("cut")))
    dealt = e.crossJoin(cut)
    keys = ["event_type", "user_id"]
    first, second = (U.counted(dealt.where(c), keys, "props", "at") for c in ("ts <= cut", "ts > cut"))
    return U.upsert_counted(first, second, keys).select(*keys, "value", "source_count", "confidence")


@query("""WITH o AS (SELECT p_partkey, p_size AS v FROM part WHERE p_partkey % 3 <> 0), n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 2 = 0)
  SELECT p_partkey, coalesce(n.v, o.v) AS p_size, CASE WHEN o.v IS NULL THEN 'inserted' WHEN n.v IS NOT NULL AND n.v <> o.v THEN 'updated' ELSE 'kept' END AS action FROM o FULL JOIN n USING (p_partkey)""")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    fetched = p.where("p_partkey % 2 = 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return U.upsert_snapshot(p.where("p_partkey % 3 <> 0"), fetched, ["p_partkey"], "p_size")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def stale_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    old = (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp"))
    return U.set_where(o, old, o_orderstatus=F.lit("X")).select("o_orderkey", "o_orderstatus")


@query("SELECT c.c_custkey, coalesce(CASE WHEN c.c_custkey % 2 = 0 THEN upper(c.c_name) END, c.c_name) AS c_name, coalesce(nullif(CASE WHEN c.c_custkey % 3 = 0 THEN '' WHEN c.c_custkey % 2 = 0 THEN 'NEW' END, ''), c.c_mktsegment) AS c_mktsegment FROM customer c")
def patch_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    even = F.col("c_custkey") % 2 == 0
    patch = c.select("c_custkey", F.when(even, F.upper("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 3 == 0, "").when(even, "NEW").alias("c_mktsegment"))
    return U.patched(c, patch, "c_custkey", ["c_name", "c_mktsegment"], empty_keeps=True)


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def vector_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return U.deleted(e, e.where("label = 3"), "vec_id").select("vec_id")


@query("SELECT 24 + row_number() OVER (ORDER BY r_name) AS n_nationkey, r_name AS n_name FROM region")
def numbered_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    return U.numbered(old, load(spark, sf_dir, "region").select(F.col("r_name").alias("n_name")), "n_nationkey", ["n_name"]).select("n_nationkey", "n_name")


@query("SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def nations_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_nationkey").intersect(load(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def parts_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey").exceptAll(load(spark, sf_dir, "lineitem").where("l_quantity > 40").select("l_partkey").distinct())


@query(f"""WITH {S.JUDGED}, j AS (SELECT doc_id, gold, predicted AS a, CASE WHEN n_chars % 2 = 0 THEN gold ELSE predicted END AS b FROM judged) SELECT CASE WHEN a <> gold AND b = gold THEN 'improved' WHEN a = gold AND b <> gold THEN 'worsened' ELSE 'unchanged' END AS change, count(*) AS count FROM j GROUP BY 1""")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = S.judged(spark, sf_dir)
    gold, base = j.select("doc_id", F.col("gold").alias("present")), j.select("doc_id", F.col("predicted").alias("present"))
    other = j.select("doc_id", F.when(F.col("n_chars") % 2 == 0, F.col("gold")).otherwise(F.col("predicted")).alias("present"))
    return J.transitions(base, other, gold, "doc_id", "present").groupBy("change").agg(F.count(F.lit(1)).alias("count"))


@query(f"""WITH {S.JUDGED}, j AS (SELECT doc_id, gold AS a, predicted AS b, CASE WHEN toxic = 1 THEN 'no' END AS h FROM judged) SELECT CASE WHEN a = b OR h IS NULL OR h = a THEN 'agent_a' WHEN h = b THEN 'agent_b' ELSE 'human_override' END AS adjudication_source, CASE WHEN a = b THEN a ELSE coalesce(h, a) END AS value, count(*) AS count FROM j GROUP BY 1, 2""")
def merged_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = S.judged(spark, sf_dir)
    human = j.where("toxic = 1").select("doc_id", F.lit("no").alias("present"))
    m = J.merged_decisions(j.select("doc_id", F.col("gold").alias("present")), j.select("doc_id", F.col("predicted").alias("present")), human, "doc_id", "present")
    return m.groupBy("adjudication_source", "value").agg(F.count(F.lit(1)).alias("count"))


@query(f"""WITH {S.JUDGED}, j AS (SELECT gold, predicted, g_emotion, p_emotion, g_sentiment, p_sentiment FROM judged) SELECT list_filter([CASE WHEN gold <> predicted OR g_sentiment <> p_sentiment THEN 'sentiment' END, CASE WHEN g_emotion <> p_emotion THEN 'emotion' END, CASE WHEN gold <> predicted THEN 'present' END], lambda x: x IS NOT NULL)::VARCHAR AS edited, count(*) AS count FROM j GROUP BY 1""")
def review_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment stands for a text field (its words share no bigrams), emotion for an enumerated one."""
    j = S.judged(spark, sf_dir)
    gold = j.select("doc_id", F.col("gold").alias("present"), F.col("g_sentiment").alias("sentiment"), F.col("g_emotion").alias("emotion"))
    said = j.select("doc_id", F.col("predicted").alias("present"), F.col("p_sentiment").alias("sentiment"), F.col("p_emotion").alias("emotion"))
    edited = E.reviewed(said, gold, "doc_id", ["sentiment"], ["emotion"])
    return edited.groupBy(F.concat(F.lit("["), F.array_join("edited", ", "), F.lit("]")).alias("edited")).agg(F.count(F.lit(1)).alias("count"))


@query("SELECT event_type AS stage, CASE event_type WHEN 'view' THEN 17 ELSE 0 END AS percent, count(*) AS count FROM events GROUP BY 1")
def phase_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.when(F.col("event_type") == "view", "crawl").otherwise("gate")
    return load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage"), V.progress(phase).alias("percent")).agg(F.count(F.lit(1)).alias("count"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '02-需求池' ELSE '' END AS folder FROM pages")
def stage_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", files.stage_folder(F.when(F.col("page_id") % 2 == 0, "need").otherwise("other")).alias("folder"))


@query("SELECT doc_id, error FROM (SELECT doc_id, unnest(list_filter([CASE WHEN lang NOT IN ('en', 'de') THEN 'lang: not allowed' END, CASE WHEN lang = 'en' AND length(text) < 50 THEN 'note: missing' END], lambda x: x IS NOT NULL)) AS error FROM documents)")
def sheet_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").withColumn("note", F.when(F.length("text") >= 50, F.col("text")))
    return P.sheet_errors(d, "doc_id", {"lang": ["en", "de"]}, {"note": F.col("lang") == "en"})


@query("SELECT doc_id, path, hash FROM (SELECT doc_id, 'd' || CAST(doc_id AS VARCHAR) AS path, md5('d' || CAST(doc_id AS VARCHAR) || ':' || CAST(n_chars AS VARCHAR) || ':' || CAST(n_chars AS VARCHAR)) AS hash FROM documents) WHERE doc_id % 3 <> 0")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("modified"), F.col("n_chars").alias("length"))
    whole = d.withColumn("hash", F.md5(F.concat_ws(":", "path", F.col("modified").cast("string"), F.col("length").cast("string"))))
    state = whole.select("path", F.when(F.col("doc_id") % 3 == 0, F.col("hash")).otherwise("old").alias("hash"))
    return files.changed(d, state).select("doc_id", "path", "hash")


@query(f"WITH {S.CLAIMS}, f AS (SELECT report_id, max(CASE WHEN verdict = 'hallucination' THEN 1 ELSE 0 END) AS bad FROM claims GROUP BY 1) SELECT count(*) FILTER (bad = 1) AS failed, count(*) AS reports FROM f")
def failed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("verdict") == "hallucination", "failed").otherwise("success")
    stage = F.struct(status.alias("status"), F.create_map(F.lit("rule"), F.struct(status.alias("status"))).alias("configurations"))
    by = S.claims(spark, sf_dir).groupBy("report_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_linenumber"), stage))).alias("stages"))
    return by.agg(F.count_if(P.has_failed(F.col("stages"))).alias("failed"), F.count(F.lit(1)).alias("reports"))


@query("SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority)::VARCHAR[] AS links FROM orders GROUP BY 1")
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    docs = o.select(F.col("o_custkey").alias("title")).distinct().withColumn("links", F.lit(None).cast("array<string>"))
    return J.backlinked(docs, o.select(F.col("o_custkey").alias("title"), F.col("o_orderpriority").alias("link"))).select(F.col("title").alias("o_custkey"), "links")


@query("SELECT o_custkey, arg_min(o_orderkey, (CASE o_orderstatus WHEN 'P' THEN 1 ELSE 2 END, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus IN ('P', 'F') GROUP BY 1")
def first_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = load(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("stage")).agg(F.min("o_orderkey").alias("o_orderkey"))
    return J.first_stage(one, "o_custkey", ["P", "F"]).select("o_custkey", "o_orderkey")


@query(f"""WITH {S.CLAIMS}, b AS (SELECT *, verdict IN ('hallucination', 'contradicted') AS bad FROM claims WHERE verdict IN ('hallucination', 'contradicted', 'partially'))
  SELECT CASE WHEN bad THEN 'correction' ELSE 'review' END AS type, 'line ' || l_linenumber AS claim, verdict, CASE WHEN bad THEN '该声明与来源数据不符' ELSE '部分内容缺乏数据支撑' END AS reason,
  CASE WHEN bad THEN '建议删除或修正该声明，确保与原始数据一致' ELSE '建议补充具体来源或限定表述范围' END AS action FROM b""")
def claim_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.claims(spark, sf_dir).select("report_id", "verdict", F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("text"), F.lit("").alias("evidence"))
    return C.suggestions(c)
