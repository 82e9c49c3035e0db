"""Text expressions: columns in, columns out, nothing leaves the JVM unless the docstring says so."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import reduce
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

# Topics that a discussion about software does not have, in order of precedence in reasons.
OFF_TOPIC = (
    "股票", "炒股", "基金", "理财", "保险",
    "招聘", "求职", "简历", "面试",
    "相亲", "交友", "约会", "征婚",
    "买房", "租房", "房价", "楼盘",
    "彩票", "中奖", "双色球",
    "医院", "挂号", "处方", "医保",
    "考研", "公务员", "教师资格证",
)
# Marks of attempts to steer a model, matched without regard to case.
INJECTIONS = (
    r"ignore\s+(all\s+)?previous\s+(instructions|prompts)",
    r"forget\s+(everything|all|your\s+instructions)",
    r"you\s+are\s+now\s+",
    r"new\s+instructions?\s*:",
    r"system\s*:\s*",
    r"<\|(im_start|system|user|assistant)\|>",
    r"```system",
    r"\[INST\]",
    r"disregard\s+(your|the|all)\s+",
)
# Active content in output; the first that matches is replaced everywhere, the others are left.
ACTIVE = (r"<script[^>]*>", r"javascript\s*:", r"on\w+\s*=\s*[\"']")
# Fixed value: assistants called by name in comments.
SUMMONS = r"(?i)^@?(?:MilkyAi|AI视频总结|AI全文总结|AI总结喵)\b"
# Entities that occur in crawled pages.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


#: White space in the sense of Unicode.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends; only the ends are looked at, so a long text costs no more."""
    return F.btrim(text, F.lit(WHITE))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once a row however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def matching_form(text: Column) -> Column:
    """Case-folded (with sharp s as ss), letters, digits and underscores only."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"(?U)[^\w]+", "")


def grams(text: Column, size: int = 2) -> Column:
    """Array of all character n-grams; empty for shorter texts."""
    n = F.length(text) - (size - 1)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(LongType())
def bag_overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the multiset intersection of the character bigrams of two strings (Arrow UDF)."""
    bag = lambda t: Counter(t[i : i + 2] for i in range(len(t) - 1))
    return pd.Series([sum((bag(x or "") & bag(y or "")).values()) for x, y in zip(a, b, strict=True)])


def bigram_dice(first: Column, second: Column) -> Column:
    """Dice coefficient of character-bigram multisets.

    Both empty: 1; one empty: 0; one of a single character: whether they are equal. Null counts as empty.
    """
    a, b = (matching_form(F.coalesce(x, F.lit(""))) for x in (first, second))
    return (
        F.when((a == "") & (b == ""), 1.0)
        .when((a == "") | (b == ""), 0.0)
        .when((F.length(a) < 2) | (F.length(b) < 2), (a == b).cast("double"))
        .otherwise(2.0 * bag_overlap(a, b) / (F.length(a) + F.length(b) - 2))
    )


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of character sets; 0 if either is empty."""
    x, y = (F.array_distinct(F.split(F.coalesce(t, F.lit("")), "")) for t in (a, b))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def plain_text(html: Column) -> Column:
    """Tags removed, common entities resolved, ends stripped."""
    return strip(reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, strip_tags(html)))


@F.pandas_udf(StringType())
def unescape_all(texts: pd.Series) -> pd.Series:
    """Every HTML entity, named or numbered (Arrow UDF)."""
    return texts.map(lambda t: None if t is None else unescape(t))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition (Arrow UDF)."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def title_key(title: Column) -> Column:
    """Form under which titles are equal: lower case, composed for compatibility, runs of space, hyphen and underscore as one space."""
    return F.regexp_replace(nfkc(strip(F.lower(title))), r"(?U)[\s\-_]+", " ")


def safe_filename(title: Column) -> Column:
    kept = F.left(F.regexp_replace(title, r'[<>:"/\\|?*]', ""), F.lit(80))
    return F.coalesce(F.nullif(strip(kept), F.lit("")), F.lit("untitled"))


def link_title(ref: Column) -> Column:
    """Title in a wiki link [[folder/title|shown]], or the text without brackets and bars at its ends."""
    inner = F.regexp_extract(ref, r"\[\[.*?/(.*?)\|", 1)
    return F.when(inner != "", strip(inner)).otherwise(F.regexp_replace(ref, r"^[\[\]|]+|[\[\]|]+$", ""))


def link_safe(title: Column) -> Column:
    return F.translate(title, "|[]", "-()")


def link_shown(ref: Column) -> Column:
    return F.regexp_extract(ref, r"\[\[.*?\|(.*?)\]\]", 1)


def short_id(*parts: Column, separator: str = ":") -> Column:
    """First 16 hex digits of the sha256 of the joined parts."""
    return F.left(F.sha2(F.concat_ws(separator, *parts), 256), F.lit(16))


def claim_id(quote: Column, section: Column, start: Column) -> Column:
    return short_id(F.lower(strip(collapse(quote))), section, start.cast("string"), separator="\n")


def chunks(text: Column, size: int = 800, overlap: int = 100, separator: str = "\n\n") -> Column:
    """Array of chunks of whole paragraphs: a chunk closes before the paragraph that would take it over `size`.

    The next chunk starts with the last `overlap` characters. Paragraphs are never split. Without any paragraph a text
    that is not empty gives its first `size` characters.
    """
    parts = F.filter(F.transform(F.split(text, separator), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, part: Column) -> Column:
        grown = F.when(state["open"] == "", part).otherwise(F.concat(state["open"], F.lit("\n\n"), part))
        full = (state["open"] != "") & (F.length(state["open"]) + F.length(part) + 2 > size)
        tail = F.right(state["open"], F.lit(overlap))
        again = F.concat(tail, F.lit("\n\n"), part) if overlap else part
        return F.struct(F.when(full, F.array_append(state["done"], strip(state["open"]))).otherwise(state["done"]).alias("done"), F.when(full, again).otherwise(grown).alias("open"))

    end = lambda s: F.when(strip(s["open"]) != "", F.array_append(s["done"], strip(s["open"]))).otherwise(s["done"])
    made = once(F.aggregate(parts, start, step, end), lambda m: F.when(F.size(m) == 0, F.array(F.left(text, F.lit(size)))).otherwise(m))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(made)


def keyword_share(keywords: Column, text: Column) -> Column:
    """Share of keywords found in the text, case aside; 1 where none is asked for."""
    hits = F.size(F.filter(keywords, lambda k: F.contains(F.lower(text), F.lower(k))))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(hits / F.size(keywords))


def numbered_bold(body: Column, heading: str) -> Column:
    """Bold items of the numbered list under the first heading with a word, up to the next heading."""
    section = F.regexp_extract(body, rf"(?m)^\s*#[^\n]*{heading}[^\n]*\n((?:(?!\s*#)[^\n]*(?:\n|\z))*)", 1)
    return F.transform(F.regexp_extract_all(section, F.lit(r"(?m)^\s*\d+\.\s*\*\*(.*?)\*\*"), F.lit(1)), lambda t: F.left(collapse(strip(t)), F.lit(200)))


def section_slice(body: Column, name: str, size: int = 500) -> Column:
    return F.left(F.regexp_extract(body, rf"(?s)##[^#]*{name}.*?(?=##|\z)", 0), F.lit(size))


def percentages(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)\s*%"), F.lit(1)), lambda x: x.cast("double"))


def tidy(text: Column, limit: int) -> Column:
    """White space collapsed, double quotes made single, cut to a length."""
    return F.rtrim(F.left(F.replace(strip(collapse(text)), F.lit('"'), F.lit("'")), F.lit(limit)))


def pad_to(body: Column, filler: str, least: int) -> Column:
    """The body with the filler appended as often as it takes to reach a length."""
    times = F.greatest(F.ceil((F.lit(least) - F.length(body)) / F.lit(len(filler))), F.lit(0)).cast("int")
    return F.concat(body, F.repeat(F.lit(filler), times))


def readable_name(full_name: Column) -> Column:
    """Words of a repository's name; empty where they come to 40 characters or more."""
    words = F.initcap(F.translate(F.element_at(F.split(full_name, "/"), -1), "-_", "  "))
    return F.when(F.length(words) < 40, words).otherwise("")


def masked(key: Column) -> Column:
    """A key with all but four characters at each end starred; of short keys nothing shows."""
    n = F.length(key)
    return F.when(n == 0, "").when(n <= 8, "****").otherwise(F.concat(F.left(key, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(key, F.lit(4))))


def without_fences(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```\w*\n?", ""), r"\n?```$", ""))


def real_line_feeds(text: Column) -> Column:
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


# Least stars of each severity.
STARS = {5: "高", 4: "中到高", 3: "中", 1: "低"}


def severity(raw: Column) -> Column:
    """High, middling to high, middling or low, from stars or words."""
    stars = F.length(raw) - F.length(F.replace(raw, F.lit("★"), F.lit("")))
    high, middle = F.contains(raw, F.lit("高")), F.contains(raw, F.lit("中"))
    return (
        F.when(stars > 0, F.coalesce(*(F.when(stars >= n, F.lit(name)) for n, name in STARS.items())))
        .when(high & ~middle, "高").when(middle & high, "中到高").when(middle, "中")
        .otherwise(F.coalesce(F.nullif(strip(raw), F.lit("")), F.lit("中")))
    )


def injections(text: Column) -> Column:
    """First match of each injection pattern, up to 80 characters."""
    return F.filter(F.array(*(F.left(F.regexp_extract(text, f"(?i){p}", 0), F.lit(80)) for p in INJECTIONS)), lambda x: x != "")


def redacted(text: Column) -> Column:
    out = text
    for p in reversed(ACTIVE):
        out = F.when(F.rlike(text, F.lit(f"(?i){p}")), F.regexp_replace(text, f"(?i){p}", "[REMOVED]")).otherwise(out)
    return out


def within_length(text: Column, limit: int = 50_000) -> Column:
    return F.length(text) <= limit


def comment_skipped(message: Column, least: int = 15) -> Column:
    return (F.length(message) < least) | F.rlike(F.replace(message, F.lit(" "), F.lit("")), F.lit(SUMMONS))


def failure_kind(reason: Column) -> Column:
    """Kind of a failed verification from its reason."""
    return (
        F.when(F.contains(reason, F.lit("InternalServerError")), "provider_error")
        .when(F.contains(reason, F.lit("quote does not match")), "quote_offset_mismatch")
        .otherwise("empty_or_malformed_json")
    )
