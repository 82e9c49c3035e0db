"""A verifier benchmark made of source records: reports with claims of known truth, each with its place in the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .prefix import running

# The texts and names of the benchmark's format.
PLATFORMS = ("github", "stackoverflow", "juejin")
OTHER_PLATFORM = {"github": "Juejin", "stackoverflow": "GitHub", "juejin": "Stack Overflow"}
LENGTHS = ("short", "medium", "long")
FILLER = "This background passage describes how the review separates direct source evidence from interpretation. It intentionally avoids adding measurements, named entities, or new factual conclusions. "
FIRST_SECTION, PAIN_SECTION, LAST_SECTION = "核心发现", "用户痛点深度分析", "机会与建议"
LEADS = (
    "The evidence review begins with a direct observation. ",
    "A separate passage preserves the wording needed for verification. ",
    "The review also records this conclusion. ",
)
CLOSING = "Further review should preserve direct citations and distinguish evidence from interpretation."
SCOPE = "The evidence suggests the same concern affects every software team without exception."
MISSING = "An independent deployment reduced operating cost during the previous quarter."
NUMBER = "Exactly 97% of affected users abandoned the tool within one week."
BOTH = "The report shows both that the tooling concern never occurs and that it occurs in the reviewed sources."
#: (mutation, verdict, contradicts itself) by index % 3, of reports without and with a flaw.
CLEAN = (("supported_control", "supported", False), ("exaggerated_scope", "partially", False), ("missing_evidence", "unverifiable", False))
FLAWED = (("unsupported_number", "hallucination", False), ("wrong_attribution", "contradicted", False), ("categorical_contradiction", "contradicted", True))
MEDIUM, LONG = 4800, 8100


def pairs(records: DataFrame, platforms: tuple[str, ...] = PLATFORMS) -> DataFrame:
    """(platform, index, ordinal, first, second): neighbours by id within each platform, a last odd one left out.

    index counts a platform's pairs from 0, ordinal all pairs in the order of `platforms`. records: id, platform, title,
    content. Positions are running sums over ranges, so a platform of any size takes many tasks.
    """
    rows = records.where(F.col("platform").isin(*platforms)).select("id", "platform", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("content", F.lit("")).alias("content"))
    numbered = running(rows, ["platform"], ["id", F.xxhash64("title", "content")], {"nth": F.lit(1)})
    counts = numbered.groupBy("platform").agg(F.floor(F.max("nth") / 2).alias("own"))  # a row for each platform
    place = F.array_position(F.array(*map(F.lit, platforms)), F.col("platform"))
    before = counts.select(F.col("own").alias("_n"), place.alias("_at"))
    offset = counts.withColumn("_place", place).join(F.broadcast(before), F.col("_at") < F.col("_place"), "left").groupBy("platform").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_before"))
    index = F.floor((F.col("nth") - 1) / 2)
    two = numbered.withColumn("index", index).groupBy("platform", "index").agg(*(F.max(F.when(F.col("nth") % 2 == k, F.struct("id", "title", "content"))).alias(n) for k, n in ((1, "first"), (0, "second"))))
    return two.where("second IS NOT NULL").join(F.broadcast(offset), "platform").select("platform", "index", (F.col("_before") + F.col("index")).alias("ordinal"), "first", "second")


def _by(n: Column, values: list[Column]) -> Column:
    return F.element_at(F.array(*values), (n % len(values) + 1).cast("int"))


def reports(paired: DataFrame) -> DataFrame:
    """A report for each pair: id, its strata, report_title, report_body, sources, and claims with [start, end) in the body.

    A third of the reports is short, padded to a medium length at the end, or to a long one before the second claim, by
    ordinal. Six of ten indices state claims as a numbered list (controlled), the others in sentences (naturalistic).
    Odd indices hold a flaw. The first two claims are true of the first source; the third is a mutation by index % 3.
    """
    first, second = (T.tidy(F.col(f"{x}.title"), 100) for x in ("first", "second"))
    index, platform = F.col("index"), F.col("platform")
    flagged, listed = index % 2 == 1, index % 10 < 6
    pick = lambda k: F.when(flagged, _by(index, [F.lit(v[k]) for v in FLAWED])).otherwise(_by(index, [F.lit(v[k]) for v in CLEAN]))
    other = F.element_at(F.create_map(*(F.lit(x) for kv in OTHER_PLATFORM.items() for x in kv)), platform)
    said = {
        "supported_control": F.concat(F.lit('The reviewed sources are titled "'), first, F.lit('" and "'), second, F.lit('".')),
        "exaggerated_scope": F.lit(SCOPE), "missing_evidence": F.lit(MISSING), "unsupported_number": F.lit(NUMBER),
        "wrong_attribution": F.concat(F.lit('The source titled "'), first, F.lit('" was published as a '), other, F.lit(" item.")),
        "categorical_contradiction": F.lit(BOTH),
    }
    rows = paired.select(
        platform, index, F.col("ordinal"), F.col("first"), F.col("second"), flagged.alias("flagged"), listed.alias("listed"),
        _by(F.col("ordinal"), [F.lit(x) for x in LENGTHS]).alias("length_bucket"), pick(0).alias("mutation_type"), pick(1).alias("verdict"), pick(2).alias("internal_contradiction"),
        F.concat(F.lit('The first source is titled "'), first, F.lit('".')).alias("one"),
        F.concat(F.lit('The source states: "'), T.tidy(F.col("first.content"), 150), F.lit('".')).alias("two"),
    ).withColumn("three", F.coalesce(*(F.when(F.col("mutation_type") == k, v) for k, v in said.items())))

    bold = lambda n, c: F.concat(F.lit(f"{n}. **"), F.col(c), F.lit("**"))
    lead = lambda k, c: F.concat(F.lit(LEADS[k]), F.col(c))
    gap, pad = F.lit("\n\n"), "\n\n" + FILLER
    opening = F.concat(F.lit(f"## {FIRST_SECTION}\n\n"), F.when(F.col("listed"), bold(1, "one")).otherwise(lead(0, "one")), gap)
    rest = F.when(F.col("listed"), F.concat(bold(2, "two"), gap, bold(3, "three"))).otherwise(F.concat(lead(1, "two"), gap, F.lit(f"## {PAIN_SECTION}\n\n"), lead(2, "three")))
    length = F.col("length_bucket")
    body = F.when(length == "long", F.concat(T.pad_to(opening, pad, LONG), gap, rest)).when(length == "medium", T.pad_to(F.concat(opening, rest), pad, MEDIUM)).otherwise(F.concat(opening, rest))
    rows = rows.withColumn("report_body", F.concat(body, F.lit(f"\n\n## {LAST_SECTION}\n\n{CLOSING}\n")))

    last = F.when(F.col("listed"), FIRST_SECTION).otherwise(PAIN_SECTION)
    ids = lambda *c: F.array(*(F.col(f"{x}.id").cast("string") for x in c))
    claims = F.array(*(_claim(F.col(c), s, v, i) for c, s, v, i in (
        ("one", F.lit(FIRST_SECTION), F.lit("supported"), ids("first")), ("two", F.lit(FIRST_SECTION), F.lit("supported"), ids("first")), ("three", last, F.col("verdict"), ids("first", "second")),
    )))
    source = lambda c: F.struct(F.col(f"{c}.id").cast("string").alias("id"), platform.alias("platform"), F.col(f"{c}.title").alias("title"), F.left(f"{c}.content", F.lit(800)).alias("content"))
    number = (index + 1).cast("string")
    return rows.select(
        T.short_id(platform, index.cast("string"), F.col("first.id").cast("string"), F.col("second.id").cast("string")).alias("id"), platform, index.alias("index"),
        F.when(F.col("listed"), "controlled").otherwise("naturalistic").alias("stratum"), "length_bucket", "flagged", "mutation_type", "internal_contradiction",
        F.when(F.col("listed"), "complete").otherwise("pending_independent_review").alias("annotation_status"), F.when(F.col("listed"), "constructed").otherwise("draft_by_construction").alias("annotation_method"),
        F.concat(F.lit("Verifier benchmark "), platform, F.lit(" "), number).alias("report_title"), "report_body", F.array(source("first"), source("second")).alias("sources"), claims.alias("claims"),
    )


def _claim(quote: Column, section: Column, verdict: Column, ids: Column) -> Column:
    start = (F.position(quote, F.col("report_body")) - 1).cast("long")
    corrected = verdict.isin("partially", "contradicted", "hallucination")
    return F.struct(
        T.claim_id(quote, section, start).alias("claim_id"), quote.alias("quote"), section.alias("section"), start.alias("start"),
        (start + F.length(quote)).alias("end"), verdict.alias("verdict"), ids.alias("source_ids"), corrected.alias("needs_correction"),
    )


def claims_of(made: DataFrame) -> DataFrame:
    """A row for each claim of the reports, with whether its place cuts it out of the report."""
    each = made.select("id", "report_body", F.inline("claims"))
    cut = F.substring("report_body", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return each.withColumn("cuts_out", cut == F.col("quote")).drop("report_body")


def manifest(made: DataFrame) -> DataFrame:
    """One row: numbers of reports, of flagged, clean and pending ones, and whether nothing is pending."""
    pending = F.count_if(F.col("annotation_status") != "complete")
    return made.agg(F.count(F.lit(1)).alias("reports"), F.count_if("flagged").alias("flagged"), F.count_if(~F.col("flagged")).alias("clean"), pending.alias("pending"), (pending == 0).alias("complete"))
