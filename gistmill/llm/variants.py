"""Spelling variants: pairs of words one edit apart, by an even-partition pigeonhole join, and each word's usual form.

A word is cut into two segments of lengths given by its own. One edit leaves one of them whole, so that an equally long
word or one longer by a letter holds it, at its place or moved by one. Words are indexed under both segments; words of
equal and of one more length probe them.

A segment that very many words share is not met as a whole: its words are indexed under one more half of what is open,
and so on. In the end all but one letter is fixed, and words that still meet are near. Where a pair could meet under
both halves, only the first counts, so every candidate comes once and needs no distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Pairs of words under one segment from which it is cut further.
WORK = 1024


def vocabulary(docs: DataFrame, shortest: int = 6, least: int = 5, every: int = 199) -> DataFrame:
    """(word, n): runs of letters of the texts, A-Z lower-cased, that count, with their occurrences.

    A run whose h = crc32("<doc_id>:<run>") is divisible by `every` loses its letter h % length; a null doc_id is
    written as nothing. Results shorter than `shortest` or with fewer than `least` occurrences do not count.
    """
    text = F.translate(F.col("text"), UPPER, LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit(f"[a-z\\u00C0-\\u00FF]{{{shortest},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _key(word: Column, a: Column, b: Column) -> Column:
    """What lies outside of [a, b) of a word; the bar is no letter."""
    return F.concat(F.substring(word, F.lit(1), a), F.lit("|"), F.substring(word, b + 1, F.length(word)))


def _entries(rows: DataFrame) -> DataFrame:
    """(word, n, longer, l, a, b, key) for both halves of the open part [a, b) of each row.

    l, a and b are those of the indexed word; one that probes with a letter more (longer) has its open part up to b + 1.
    """
    half = F.col("a") + F.floor((F.col("b") - F.col("a")) / 2).cast("int")
    open_ = F.explode(F.array(F.struct(half.alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), half.alias("b"))))
    cut = rows.select("word", "n", "longer", "l", open_.alias("o")).select("word", "n", "longer", "l", "o.a", "o.b")
    return cut.withColumn("key", _key(F.col("word"), F.col("a"), F.col("b") + F.col("longer")))


def near_pairs(words: DataFrame, scratch: Scratch, shortest: int = 6, work: int = WORK) -> DataFrame:
    """(a, a_n, b, b_n): each pair of different words with one insertion, deletion or replacement between them, once."""
    own = words.select("word", "n", F.lit(0).alias("longer"), F.length("word").alias("l"))
    probes = words.where(F.length("word") > shortest).select("word", "n", F.lit(1).alias("longer"), (F.length("word") - 1).alias("l"))
    rows = own.unionByName(probes).withColumns({"a": F.lit(0), "b": F.col("l")})
    found, where = None, ["l", "a", "b", "key"]
    while True:
        entries = _entries(rows)
        own_, longer = F.count_if(F.col("longer") == 0), F.count_if(F.col("longer") == 1)
        size = entries.groupBy(*where).agg(own_.alias("x"), longer.alias("y")).where("x > 1 OR x = 1 AND y > 0")
        hot = (F.col("x").cast("double") * (F.col("x") + F.col("y")) > work) & (F.col("b") - F.col("a") > 1)
        met = scratch.cut(entries.join(size.select(*where, hot.alias("hot")), where), "met")
        cool = met.where(~F.col("hot"))
        left = cool.where("longer = 0").select(*where, F.col("word").alias("first"), F.col("n").alias("first_n"))
        right = cool.select(*where, "word", "n", "longer")
        mine, others = (F.substring(c, F.col("a") + 1, F.col("b") - F.col("a")) for c in ("first", "word"))
        fresh = (F.col("b") == F.col("l")) | (mine != others)  # else they meet under the first half, too
        pairs = left.join(right, where).where(((F.col("longer") == 1) | (F.col("first") < F.col("word"))) & fresh)
        pairs = pairs.where(F.levenshtein("first", "word", 1) == 1).select(F.col("first").alias("a"), F.col("first_n").alias("a_n"), F.col("word").alias("b"), F.col("n").alias("b_n"))
        found = pairs if found is None else found.unionByName(pairs)
        rows = met.where("hot").drop("hot", "key")
        if rows.isEmpty():
            return scratch.cut(found, "pairs")


def forms(pairs: DataFrame, words: DataFrame, times: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest n, the smaller one of equals, if its n is `times` that of the word."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    form_n = -F.col("best.less")
    usual = form_n >= times * F.col("n")
    got = words.join(best, "word", "left")
    return got.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(usual, F.col("best.form")).alias("form"), F.when(usual, form_n).alias("form_n"))


def roots(formed: DataFrame, scratch: Scratch) -> DataFrame:
    """`formed` with root: the end of a word's forms, itself if it has none. A step follows twice as many as the last."""
    links = scratch.cut(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "links")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        after = scratch.cut(links.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("moved")), "links")
        if after.where("moved").isEmpty():
            return formed.join(after.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
        links = after.drop("moved")


def group(docs: DataFrame, shortest: int = 6, least: int = 5, every: int = 199, work: int = WORK) -> DataFrame:
    """Each word of `vocabulary`: word, n, n_near (how many are one edit away), form, form_n (see `forms`), and root.

    Null texts have no words, repeated rows count as often as they come, texts of any length count whole, no documents
    give no rows, and other columns are ignored. A word's n falls by a factor of 5 at each step towards it from its
    root, so steps number fewer than 28.
    """
    scratch = Scratch(docs.sparkSession, "variants")
    words = scratch.cut(vocabulary(docs, shortest, least, every), "words")
    formed = scratch.cut(forms(near_pairs(words, scratch, shortest, work), words), "forms")
    return roots(formed, scratch).select("word", "n", "n_near", "form", "form_n", "root")
