"""Queries over landed results, planted in the given pages where those have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from ..sources import page_state as P
from .registry import query

#: Ten pages make a search; a page's posts are itself and its neighbour, told by its state, the interface or a browser.
PLANTED = """planted AS (SELECT page_id, page_id // 30 AS keyword, page_id % 30 // 3 AS page, page_id % 3 AS way, url FROM pages WHERE page_id >= 0),
asked AS (SELECT keyword, page, way, page_id AS id, url, 0 AS pos FROM planted UNION ALL SELECT keyword, page, way, page_id + 3, url, 1 FROM planted)"""


def _planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    i = F.col("page_id")
    p = load(spark, sf_dir, "pages").where(i >= 0).select(F.floor(i / 30).alias("keyword"), F.floor(i % 30 / 3).alias("page"), (i % 3).alias("way"), i.alias("id"), "url", "html")
    object_ = lambda **names: F.to_json(F.struct(*(v.alias(k) for k, v in names.items())))
    two = lambda **n: F.concat(F.lit("["), object_(**n), F.lit(","), object_(**(n | {next(iter(n)): F.col("id") + 3})), F.lit("]"))
    listed = two(noteId=F.col("id"), display_title=F.concat(F.lit("page "), F.col("id")), desc=F.col("url"))
    script = F.concat(F.lit('<script>window.__INITIAL_STATE__ = {"a":undefined,"search":{"feeds":[],"result":{"noteList":'), listed, F.lit("}}}</script>"))
    pages = p.where("way = 0").select("keyword", "page", F.concat(F.coalesce("html", F.lit("")), script).alias("html"))
    told = two(id=F.col("id").cast("string"), title=F.concat(F.lit("page "), F.col("id")), description=F.col("url"))
    answers = p.where("way = 1").select("keyword", "page", F.concat(F.lit('{"success":'), F.when(F.col("page") % 4 == 0, "false").otherwise("true"), F.lit(',"data":{"notes":'), told, F.lit("}}")).alias("body"))
    cards = p.where("way = 2").select("keyword", "page", F.lit(0).alias("pos"), F.concat(F.lit("/explore/"), F.col("id"), F.lit("/?x=1")).alias("href"), F.concat(F.lit(" page "), F.col("id")).alias("title"), F.col("url").alias("text"), F.lit(None).cast("string").alias("author"))
    return pages, answers, cards


@query(f"""WITH {PLANTED}, every AS (SELECT keyword, page, 0 AS rank, pos, id, CASE pos WHEN 0 THEN id ELSE id - 3 END AS told, url FROM asked WHERE way = 0
  UNION ALL SELECT keyword, page, 1, pos, id, CASE pos WHEN 0 THEN id ELSE id - 3 END, url FROM asked WHERE way = 1 AND page % 4 <> 0 UNION ALL SELECT keyword, page, 2, 0, id, id, url FROM asked WHERE way = 2 AND pos = 0),
  f AS (SELECT * FROM every QUALIFY rank = min(rank) OVER (PARTITION BY keyword, page)), o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY keyword, id ORDER BY page, pos) = 1),
  s AS (SELECT DISTINCT keyword, page FROM f), l AS (SELECT keyword, min(page) AS least FROM planted GROUP BY 1), e AS (SELECT keyword, max(page) AS last FROM (SELECT s.keyword, page, least + row_number() OVER (PARTITION BY s.keyword ORDER BY page) - 1 AS want FROM s JOIN l USING (keyword)) WHERE page = want GROUP BY 1)
  SELECT keyword, CAST(row_number() OVER (PARTITION BY keyword ORDER BY page, pos) AS INTEGER) AS ordinal, 'https://www.xiaohongshu.com/explore/' || id AS source_url, 'page ' || told AS title, left(url, 5000) AS content FROM o JOIN e USING (keyword) WHERE page <= last""")
def posts_in_page_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.posts(*_planted(spark, sf_dir)).select("keyword", "ordinal", "source_url", "title", "content")
