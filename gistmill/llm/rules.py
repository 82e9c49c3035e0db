"""Quality rules with adaptive thresholds.

Counts per text are made in one pass. What is usual is learnt from the data: per language and source a mergeable
quantile sketch of each ratio, a histogram over buckets that widen with the value (relative error below 1/FINE), so that
sketches add up by bucket and partial sums are made before the shuffle. Every group's sketch is blended with `PRIOR`
documents' worth of its language's, and that with the whole table's, so that a small group leans on its language and a
large one on itself, without a size at which the rule changes. Thresholds are fences beyond the outer tenths of the
blended sketch; the only allowance besides is the sampling error of a ratio in a text of that length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_bytes, cut
from .words import hash_strings, split_words, window_hashes, word_codes

SPACE, SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 5
#: Buckets of a sketch for each doubling.
FINE = 256
#: So many documents of the language (of the whole table, for a language) are added to each sketch.
PRIOR = 200
#: Quantiles of a sketch, and how many times the distance from the middle to the outer ones the fences lie beyond these.
SHARES = {"q10": 0.1, "q50": 0.5, "q90": 0.9}
REACH = 3.0
#: Standard errors that a text's own ratio may lie beyond a fence.
ERRORS = 3.0
#: Parts that a blended sketch is counted in, so that its sums are whole numbers and do not depend on their order.
PARTS = 1_000_000
#: Ratios that are judged, in thousandths.
RATIOS = ("word_length", "symbols", "dup_lines", "repeats")


def _per_row(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def _line_repeats(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lists = pc.split_pattern(texts, "\n")
    lines = pc.list_flatten(lists)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False).astype(bool)
    codes, _ = word_codes(lines.filter(pa.array(real)))
    owner = owner[real]
    fresh = np.unique(owner * (int(codes.max(initial=0)) + 1) + codes)
    distinct = np.bincount(fresh // (int(codes.max(initial=0)) + 1), minlength=len(texts))
    return np.bincount(owner, minlength=len(texts)) - distinct


def _repeated_words(words: pa.Array, counts: np.ndarray) -> np.ndarray:
    """Words inside a window of five that the text has twice or more."""
    codes, distinct = word_codes(words)
    rolled = window_hashes(codes, hash_strings(distinct), WINDOW)
    bounds, out = np.concatenate([[0], np.cumsum(counts)]), np.zeros(len(counts), np.int64)
    for k in np.flatnonzero(counts > WINDOW).tolist():
        own = rolled[bounds[k] : bounds[k + 1] - WINDOW + 1]
        order = np.argsort(own)
        same = own[order][1:] == own[order][:-1]
        if same.any():
            twice = np.zeros(len(own), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            steps = np.zeros(counts[k] + 1, np.int64)
            np.add.at(steps, np.flatnonzero(twice), 1)
            np.add.at(steps, np.flatnonzero(twice) + WINDOW, -1)
            out[k] = int((np.cumsum(steps) > 0).sum())
    return out


def counts_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text; a null text is empty."""
    texts = pc.fill_null(texts, "").combine_chunks() if isinstance(texts, pa.ChunkedArray) else pc.fill_null(texts, "")
    words, counts = split_words(texts)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    return {
        "n_words": counts.astype(np.int64),
        "word_chars": _per_row(((raw & 0xC0) != 0x80) & ~SPACE[raw], starts),
        "n_symbols": _per_row(SYMBOL[raw], starts),
        "n_dup_lines": _line_repeats(texts),
        "n_repeat_words": _repeated_words(words, counts),
    }


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        got = counts_of(batch.column("text"))
        keep = [k for k, n in enumerate(batch.schema.names) if n != "text"]
        lines = pc.add(pc.count_substring(pc.fill_null(batch.column("text"), ""), "\n"), 1).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(got[n], pa.int64()) for n in NAMES), lines], [*(batch.schema.names[k] for k in keep), *NAMES, "n_lines"])


def bucket(value: Column) -> Column:
    """Sketch bucket of a whole number from 0: exact below 2 FINE, then FINE buckets for each doubling."""
    shift = F.greatest(F.floor(F.log2(F.greatest(value, F.lit(1)).cast("double"))).cast("int") - FINE.bit_length() + 1, F.lit(0))
    return (shift * FINE + F.call_function("shiftright", value, shift)).cast("int")


def bucket_top(b: Column) -> Column:
    """The largest number of a bucket."""
    shift = F.greatest((b / FINE).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", (b - shift * FINE + 1).cast("long"), shift) - 1


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and ratio, the counts by bucket; at most FINE rows for each doubling of the values, however many documents a group has."""
    ratios = F.explode(F.create_map(*[x for name in RATIOS for x in (F.lit(name), F.col(name))]))
    return measured.select(*keys, ratios.alias("ratio", "value")).groupBy(*keys, "ratio", bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """Values at the shares, per group and ratio, read off the merged counts."""
    w = Window.partitionBy(*keys, "ratio").orderBy("bucket")
    whole = Window.partitionBy(*keys, "ratio")
    run = sketch.withColumn("upto", F.sum("n").over(w)).withColumn("docs", F.sum("n").over(whole))
    return run.groupBy(*keys, "ratio").agg(F.max("docs").alias("docs"), *(F.min(F.when(F.col("upto") >= F.col("docs") * s, bucket_top(F.col("bucket")))).alias(n) for n, s in shares.items()))


def blended(sketch: DataFrame, keys: list[str], prior: DataFrame, size: int) -> DataFrame:
    """Sketches per `keys` with `size` documents' worth of the prior's added; n in parts of a document.

    prior: ratio, bucket, n and some of the keys, in parts too, or the plain sketch of everything.
    """
    shared = [c for c in prior.columns if c not in ("bucket", "n")]
    whole = F.sum("n").over(Window.partitionBy(*shared))
    share = prior.select(*shared, "bucket", F.floor(F.col("n") / whole * PARTS).alias("share"))
    own = sketch.groupBy(*keys, "ratio", "bucket").agg((F.sum("n") * PARTS).alias("n"))
    borrowed = sketch.select(*keys, "ratio").distinct().join(share, shared).select(*keys, "ratio", "bucket", (F.col("share") * size).alias("n"))
    return own.unionByName(borrowed).groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source) and for each ratio a struct (low, high), of the blended sketches; a row per group."""
    every = sketch.groupBy("ratio", "bucket").agg(F.sum("n").alias("n"))
    own = blended(sketch, ["lang", "source"], blended(sketch, ["lang"], every, prior), prior)
    q = quantiles(own, ["lang", "source"], SHARES)
    low, high = F.col("q10") - REACH * (F.col("q50") - F.col("q10")), F.col("q90") + REACH * (F.col("q90") - F.col("q50"))
    limits = q.select("lang", "source", "ratio", F.struct(low.alias("low"), high.alias("high")).alias("fence"))
    return limits.groupBy("lang", "source").agg(*(F.max(F.when(F.col("ratio") == n, F.col("fence"))).alias(f"fence_{n}") for n in RATIOS))


def inside(ratio: str) -> Column:
    """Whether a text's ratio is within its group's fences, give or take the sampling error of a text of its length.

    A share of n things may reach the upper score bound of the fence's share at n; a repeated window counts about two
    windows of words at once, so repeats have n_words / 10 things. A mean word length may lie off by the error of n
    lengths that scatter by half the fence. Shares have no lower fence: few symbols or repeats are no fault.
    """
    low, high = F.col(f"fence_{ratio}")["low"], F.col(f"fence_{ratio}")["high"]
    if ratio == "word_length":
        room = ERRORS * high / 2 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
        return F.col(ratio).between(low - room, high + room)
    n = F.greatest(F.col("n_lines" if ratio == "dup_lines" else "n_words"), F.lit(1)) / (2.0 * WINDOW if ratio == "repeats" else 1.0)
    p = F.least(F.greatest(high / 1000, F.lit(0.0)), F.lit(1.0))
    z2 = ERRORS * ERRORS
    upper = (p + z2 / 2 / n + ERRORS * F.sqrt(p * (1 - p) / n + z2 / 4 / n / n)) / (1 + z2 / n)
    return F.col(ratio) <= F.greatest(upper * 1000, high)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang and source of each row of `docs` with its counts and ratios (in thousandths, whole numbers)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))
    counted = plain.mapInArrow(_measure, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in NAMES) + ", n_lines long")
    per = lambda a, b: F.when(F.col(b) > 0, F.floor(F.col(a) * 1000 / F.col(b))).otherwise(0).cast("long")
    return counted.withColumns({"word_length": per("word_chars", "n_words"), "symbols": per("n_symbols", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words")})


def judge(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """Counts of every row of `docs` with base_failed and kept.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated windows. kept: not base_failed and each
    ratio inside the fences of the row's group. Sketches are made of rows that pass the base rules. A null lang or
    source is a group of its own, null and empty texts fail, repeated rows are judged alike, an empty table gives none.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = cut(measure(docs).withColumn("base_failed", failed), "rules")
    sketch = cut(sketches(measured.where(~F.col("base_failed")), ["lang", "source"]), "sketch")
    # written, so that the planner knows the size of the limits: few groups are broadcast, many are joined by sorting
    limits = cut(fences(sketch, prior), "limits")
    kept = ~F.col("base_failed")
    for n in RATIOS:
        kept = kept & F.coalesce(inside(n), F.lit(True))
    return measured.join(limits, ["lang", "source"], "left").select("doc_id", *NAMES, "base_failed", kept.alias("kept"), *RATIOS)


def passing(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The rows of `docs` whose doc_id has a kept row, all columns; the joined filter."""
    verdicts = judge(docs, prior).where("kept").select("doc_id").distinct()
    return docs.join(verdicts, "doc_id", "left_semi")
