"""Landed crawl results to discussion rows: platform, source_url, title, content, author, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Markup of result blocks, their links, texts and authors, and of topics; labels of trending periods.
POST_BLOCK = r'(?s)<div\s+class="s_post"[^>]*>(.*?)</div>'
POST_LINK = r'(?s)<a\s+[^>]*href="(/p/\d+)"[^>]*>(.*?)</a>'
POST_TEXT = r'(?s)<p[^>]*class="[^"]*p_content[^"]*"[^>]*>(.*?)</p>'
POST_AUTHOR = r'p_author_name"[^>]*>(.*?)<'
POST_TITLE = r'<span\s+class="p_title"[^>]*>.*?<a[^>]*href="(/p/\d+)"[^>]*>(.*?)</a>'
TOPIC_LINK = r'(?s)<a\s+[^>]*href="(https://www\.douban\.com/group/topic/\d+/?)[^"]*"[^>]*>(.+?)</a>'
TOPIC_TEXTS = (r'(?s)<span\s+class="subject-cast"[^>]*>(.*?)</span>', r'(?s)<p[^>]*>(.*?)</p>')
TOPIC_RATING = r'<span\s+class="rating_nums">([\d.]+)</span>'
PERIODS = {"daily": "today", "weekly": "this week", "monthly": "this month"}


def _item(platform: str, url: Column, title: Column, content: Column, author: Column | None = None, tags: Column | None = None) -> list[Column]:
    none = F.lit("")
    return [F.lit(platform).alias("platform"), url.alias("source_url"), title.alias("title"), content.alias("content"), F.coalesce(author if author is not None else none, none).alias("author"), (tags if tags is not None else F.array().cast("array<string>")).alias("tags")]


def issues(rows: DataFrame, limit: int = 100) -> DataFrame:
    """Issue search results (html_url, title, body, user.login, labels[].name, ordinal): first of each URL, up to a limit."""
    first = rows.groupBy("html_url").agg(F.min_by(F.struct("title", "body", "user", "labels"), "ordinal").alias("r"), F.min("ordinal").alias("ordinal")).orderBy("ordinal").limit(limit)
    return first.select(*_item("github", F.col("html_url"), F.col("r.title"), F.coalesce("r.body", F.lit("")), F.col("r.user.login"), F.transform("r.labels", lambda x: x["name"])))


def excerpts(rows: DataFrame) -> DataFrame:
    """Question excerpts (question_id, title, body, tags): tags stripped, link made from the id."""
    return rows.select(*_item("stackoverflow", F.concat(F.lit("https://stackoverflow.com/questions/"), F.col("question_id").cast("string")), T.plain_text(F.col("title")), T.strip(T.strip_tags(F.col("body"))), None, F.col("tags")))


def articles(rows: DataFrame) -> DataFrame:
    """Search entries (title, description, url, nickname, tags) with highlight marks removed; untitled ones go."""
    bare = lambda c: F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<em>"), F.lit("")), F.lit("</em>"), F.lit(""))
    title, text = bare("title"), bare("description")
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), T.strip), lambda x: x != "")
    return rows.where(title != "").select(*_item("csdn", F.coalesce("url", F.lit("")), F.left(title, F.lit(200)), F.when(text != "", F.left(text, F.lit(5000))).otherwise(title), F.col("nickname"), tags))


def feed(rows: DataFrame) -> DataFrame:
    """Feed objects that are articles or short posts: (article_id, pin_id, title, content, keywords, user_name)."""
    name = F.coalesce("article_id", "pin_id", F.lit(""))
    url = F.when(name != "", F.concat(F.lit("https://juejin.cn/"), F.when(F.col("article_id").isNotNull(), "post/").otherwise("pin/"), name)).otherwise("")
    tags = F.filter(F.transform(F.split(F.coalesce("keywords", F.lit("")), ","), T.strip), lambda x: x != "")
    return rows.select(*_item("juejin", url, F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")), F.col("user_name"), tags))


def answers(rows: DataFrame) -> DataFrame:
    """Objects of several types (id, type, title, question_title, content, excerpt, question_id, topics[].name)."""
    kind, name = F.col("type"), F.col("id").cast("string")
    title = F.when(kind == "answer", F.col("question_title")).otherwise(F.col("title"))
    url = (
        F.when(kind == "answer", F.concat(F.lit("https://www.zhihu.com/question/"), F.col("question_id").cast("string"), F.lit("/answer/"), name))
        .when(kind == "article", F.concat(F.lit("https://zhuanlan.zhihu.com/p/"), name))
        .when(kind == "question", F.concat(F.lit("https://www.zhihu.com/question/"), name))
        .when(kind == "pin", F.concat(F.lit("https://www.zhihu.com/pin/"), name))
        .otherwise("")
    )
    text = T.strip(T.strip_tags(F.coalesce(F.nullif("content", F.lit("")), "excerpt", F.lit(""))))
    tags = F.slice(F.transform(F.coalesce("topics", F.array().cast("array<struct<name:string>>")), lambda t: t["name"]), 1, 5)
    shown = T.strip(T.strip_tags(F.coalesce(title, F.lit(""))))
    return rows.where((shown != "") & (text != "")).dropDuplicates(["id"]).select(*_item("zhihu", url, shown, text, None, tags))


def posts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Search result blocks in pages: link, title, excerpt (or the title), author; one row per link.

    A page without blocks gives its title links instead, whose titles are the text too.
    """
    blocks = F.regexp_extract_all(html, F.lit(POST_BLOCK), F.lit(1))
    some = pages.select(blocks.alias("bs"), F.col(html).alias("h"))
    block = some.select(F.explode("bs").alias("b"))
    link, title = F.regexp_extract("b", POST_LINK, 1), T.plain_text(F.regexp_extract("b", POST_LINK, 2))
    text = T.plain_text(F.regexp_extract("b", POST_TEXT, 1))
    author = T.strip(F.regexp_extract("b", POST_AUTHOR, 1))
    bare = some.where(F.size("bs") == 0).select(F.explode(F.regexp_extract_all("h", F.lit(POST_TITLE), F.lit(0))).alias("b"))
    named = T.plain_text(F.regexp_extract("b", POST_TITLE, 2))
    rows = block.select(link.alias("l"), title.alias("t"), text.alias("x"), author.alias("a")).unionByName(bare.select(F.regexp_extract("b", POST_TITLE, 1).alias("l"), named.alias("t"), F.lit("").alias("x"), F.lit("").alias("a")))
    rows = rows.where("l <> '' and t <> ''").dropDuplicates(["l"])
    return rows.select(*_item("tieba", F.concat(F.lit("https://tieba.baidu.com"), F.col("l")), F.left("t", F.lit(200)), F.when(F.col("x") != "", F.left("x", F.lit(3000))).otherwise(F.col("t")), F.col("a")))


def topics(pages: DataFrame, html: str = "html") -> DataFrame:
    """Topic links in pages, each with the excerpt and the rating found around its first place; the title where none is."""
    found = F.regexp_extract_all(html, F.lit(TOPIC_LINK), F.lit(0))
    links = pages.select(F.col(html).alias("h"), F.explode(F.array_distinct(found)).alias("a"))
    links = links.select("h", F.regexp_extract("a", TOPIC_LINK, 1).alias("url"), T.plain_text(F.regexp_extract("a", TOPIC_LINK, 2)).alias("t"))
    at = F.position(F.col("url"), F.col("h"))
    start = F.greatest(at - 200, F.lit(1))
    near = links.where("t <> ''").withColumn("near", F.substring("h", start, at + 2000 - start))
    texts = [F.nullif(T.plain_text(F.regexp_extract("near", p, 1)), F.lit("")) for p in TOPIC_TEXTS]
    rating = F.regexp_extract("near", TOPIC_RATING, 1)
    tags = F.when(rating != "", F.array(F.concat(F.lit("评分:"), rating))).otherwise(F.array().cast("array<string>"))
    return near.select(*_item("douban", F.col("url"), F.left("t", F.lit(200)), F.coalesce(*(F.left(x, F.lit(3000)) for x in texts), F.col("t")), tags=tags)).dropDuplicates(["source_url"])


def trending(pages: DataFrame, since: str = "daily", day: str | None = None, html: str = "html") -> DataFrame:
    """Project rows of trending pages; figures that are no numbers are 0."""
    a = pages.select(F.explode(F.regexp_extract_all(html, F.lit(r'(?s)<article class="Box-row">(.*?)</article>'), F.lit(1))).alias("a"))
    whole = lambda t: F.coalesce(F.try_to_number(F.nullif(F.replace(t, F.lit(","), F.lit("")), F.lit("")), F.lit("999999999999")).cast("int"), F.lit(0))
    part = lambda p, g=1: F.regexp_extract("a", p, g)
    heading = F.regexp_extract_all(part(r"(?s)<h2[^>]*>(.*?)</h2>"), F.lit(r'<a[^>]+href="(/[^"]+)"'), F.lit(1))
    name = F.regexp_replace(F.coalesce(F.try_element_at(heading, F.lit(-1)), F.lit("")), "^/+", "")
    label = PERIODS.get(since, "today")
    rows = a.select(
        name.alias("full_name"),
        T.strip(T.strip_tags(part(r'(?s)<p class="col-9[^"]*">(.*?)</p>'))).alias("description"),
        T.strip(part(r'itemprop="programmingLanguage">(.*?)</span>')).alias("language"),
        whole(T.strip(T.strip_tags(part(r"(?s)/stargazers[^>]*>(.*?)</a>")))).alias("stars"),
        whole(T.strip(T.strip_tags(part(r"(?s)/forks[^>]*>(.*?)</a>")))).alias("forks"),
        whole(part(rf"([\d,]+)\s*stars?\s+{label}")).alias("period_stars"),
        F.lit(since).alias("since"),
        F.array_join(F.regexp_extract_all("a", F.lit(r'alt="(@[^"]+)"'), F.lit(1)), ",").alias("contributors"),
        (F.lit(day) if day else F.current_date().cast("string")).alias("snapshot_date"),
    )
    return rows.where(F.contains("full_name", F.lit("/")))


def threads(videos: DataFrame, most: int) -> DataFrame:
    """Comments and their replies of videos (aid, title, replies array of struct(message, uname, sub array of the same)).

    Up to `most` rows a video, comments before their replies; short comments and calls of assistants are skipped.
    """
    from ..operators.windows import first_per_group

    roots = videos.select("aid", "title", F.posexplode_outer("replies").alias("i", "r"))
    first = roots.select("aid", "title", "i", F.lit(-1).alias("j"), F.col("r.message").alias("m"), F.col("r.uname").alias("u"))
    second = roots.select("aid", "title", "i", F.posexplode("r.sub").alias("j", "s")).select("aid", "title", "i", "j", F.col("s.message").alias("m"), F.col("s.uname").alias("u"))
    rows = first.unionByName(second).where(F.col("m").isNotNull() & ~T.comment_skipped(F.col("m")))
    kept = first_per_group(rows, ["aid"], ["i", "j"], most)
    return kept.select(*_item("bilibili", F.concat(F.lit("https://www.bilibili.com/video/av"), F.col("aid").cast("string")), F.col("title"), F.col("m"), F.col("u")))
