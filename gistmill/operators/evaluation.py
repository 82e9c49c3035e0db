"""Scores of extraction, ranking and verification against gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from .prefix import running


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1, each 0 where undefined."""
    p, r = V.ratio(tp, tp + fp), V.ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), V.ratio(2 * p * r, p + r).alias("f1")]


def confusion(pairs: DataFrame, keys: list[str], gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Confusion counts and accuracy per group of yes/no/error predictions; no keys means one row for all."""
    g, p = F.col(gold), F.col(predicted)
    by = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((g == "yes") & (p == "yes")).alias("true_positive"),
        F.count_if((g == "no") & (p == "no")).alias("true_negative"),
        F.count_if((g == "no") & (p == "yes")).alias("false_positive"),
        F.count_if((g == "yes") & (p == "no")).alias("false_negative"),
        F.count_if(p == "error").alias("error"),
    )
    return by.withColumn("accuracy", V.ratio(F.col("true_positive") + F.col("true_negative"), F.col("n")))


def failure_modes(pairs: DataFrame, groupings: list[str], fields: list[str]) -> DataFrame:
    """(grouping, value, name, count, total, rate) of failures in each group of several groupings, counts over 0 only.

    pairs: gold, predicted (yes/no/error), g_ and p_ columns of each categorical field, and the grouping columns.
    """
    g, p = F.col("gold"), F.col("predicted")
    both = (g == "yes") & (p == "yes")
    sums = [F.count_if((g == "no") & (p == "yes")).alias("c0"), F.count_if(g == "no").alias("t0"), F.count_if((g == "yes") & (p == "no")).alias("c1"), F.count_if(g == "yes").alias("t1")]
    names = ["false_positive_requirement", "false_negative_requirement"]
    for k, f in enumerate(fields, 2):
        sums += [F.count_if(both & ~F.col(f"g_{f}").eqNullSafe(F.col(f"p_{f}"))).alias(f"c{k}"), F.count_if(both).alias(f"t{k}")]
        names.append(f"{f}_mismatch")
    which = F.coalesce(*(F.when(F.grouping(c) == 0, F.lit(c)) for c in groupings))
    by = pairs.groupingSets([[F.col(c)] for c in groupings], *groupings).agg(which.alias("grouping"), *sums)
    rows = F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"c{k}").alias("count"), F.col(f"t{k}").alias("total")) for k, n in enumerate(names)))
    value = F.coalesce(*(F.col(c).cast("string") for c in groupings))
    return by.select("grouping", value.alias("value"), F.inline(rows)).where("count > 0").withColumn("rate", V.ratio(F.col("count"), F.col("total")))


def duplicate_titles(rows: DataFrame, title: str) -> DataFrame:
    """One row: rows beyond the first of each matching form of the title, and their share."""
    by = rows.groupBy(T.matching_form(F.col(title)).alias("_t")).agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.sum(F.when(F.col("_t") != "", F.col("n") - 1).otherwise(0)).alias("duplicates"), F.sum("n").alias("rows")).withColumn("rate", V.ratio(F.col("duplicates"), F.col("rows")))


def field_agreement(compared: DataFrame) -> DataFrame:
    """(field, agreed, total, rate) from joins.compare_fields."""
    return compared.groupBy("field").agg(F.count_if("agreed").alias("agreed"), F.count(F.lit(1)).alias("total")).withColumn("rate", F.when(F.col("total") == 0, 1.0).otherwise(V.ratio(F.col("agreed"), F.col("total"))))


def auroc(rows: DataFrame, label: str, risk: str) -> DataFrame:
    """Area under the ROC curve, ties a half; null with one class.

    Grouped by risk first; what lies below each distinct value is a running sum over ranges of values.
    """
    by = rows.groupBy(F.col(risk).alias("r")).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    below = running(by, [], ["r"], {"upto": F.col("neg")})
    wins = F.col("pos") * (F.col("upto") - F.col("neg") / 2)
    return below.withColumn("wins", wins).agg(F.try_divide(F.sum("wins"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auroc"))


def average_precision(rows: DataFrame, label: str, risk: str) -> DataFrame:
    """Mean over positives of the precision at their risk, rows of one risk taken together."""
    by = rows.groupBy(F.col(risk).alias("r")).agg(F.count_if(F.col(label)).alias("pos"), F.count(F.lit(1)).alias("n"))
    upto = running(by, [], [F.desc("r")], {"pos_upto": F.col("pos"), "n_upto": F.col("n")})
    part = F.col("pos") * F.col("pos_upto") / F.col("n_upto")
    return upto.withColumn("part", part).agg(F.try_divide(F.sum("part"), F.sum("pos").cast("double")).alias("average_precision"))


def verdict_metrics(matched: DataFrame, verdicts: list[str]) -> DataFrame:
    """(verdict, precision, recall, f1) from joins.matched_last with expected and predicted verdict columns."""
    spread = matched.withColumn("verdict", F.explode(F.array(*map(F.lit, verdicts))))
    e, p = F.col("expected").eqNullSafe(F.col("verdict")), F.col("predicted").eqNullSafe(F.col("verdict"))
    by = spread.groupBy("verdict").agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"))
    return by.select("verdict", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def binary_metrics(matched: DataFrame, positive: list[str]) -> DataFrame:
    e, p = F.coalesce(F.col("expected").isin(positive), F.lit(False)), F.coalesce(F.col("predicted").isin(positive), F.lit(False))
    return matched.agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn")).select(*prf(F.col("tp"), F.col("fp"), F.col("fn")))


def prompt_score(rows: DataFrame, passing: float = 0.7) -> DataFrame:
    """Score and verdict of extractions (struct got) against expectations (struct want).

    Sentiment and emotion count a quarter each, confidence and title words 0.15, pain point and use case words 0.1.
    """
    want, got = "want", "got"
    same = lambda f: F.when(F.col(f"{got}.{f}").eqNullSafe(F.col(f"{want}.{f}")), 1.0).otherwise(0.0)
    words = lambda f: T.keyword_share(F.coalesce(F.col(f"{want}.{f}_keywords"), F.array().cast("array<string>")), F.coalesce(F.col(f"{got}.{f}"), F.lit("")))
    sure = V.range_score(F.col(f"{got}.confidence"), F.col(f"{want}.confidence_min"), F.col(f"{want}.confidence_max"))
    score = same("sentiment") * 0.25 + same("emotion") * 0.25 + sure * 0.15 + words("title") * 0.15 + words("pain_point") * 0.1 + words("use_case") * 0.1
    return rows.withColumn("score", F.round(score, 4)).withColumn("passed", score >= passing)


def reviewed(predictions: DataFrame, gold: DataFrame, key: str, text: list[str], other: list[str]) -> DataFrame:
    """Predictions as a reviewer leaves them: categorical fields set to gold, text fields where Dice is below 0.5.

    edited lists the fields that changed. A flipped presence copies every field.
    """
    j = predictions.select(key, *(F.col(c).alias(f"p_{c}") for c in ["present", *text, *other])).join(gold.select(key, *(F.col(c).alias(f"g_{c}") for c in ["present", *text, *other])), key)
    flipped = ~F.col("p_present").eqNullSafe(F.col("g_present"))
    edit = {c: flipped | (T.bigram_dice(F.col(f"g_{c}"), F.col(f"p_{c}")) < 0.5) for c in text} | {c: ~F.col(f"p_{c}").eqNullSafe(F.col(f"g_{c}")) for c in other} | {"present": flipped}
    edited = F.array_compact(F.array(*(F.when(e, F.lit(c)) for c, e in edit.items())))
    return j.select(key, *(F.when(e, F.col(f"g_{c}")).otherwise(F.col(f"p_{c}")).alias(c) for c, e in edit.items()), edited.alias("edited"))


# How suitable a project is by the words in its titles, the first kind that has one.
FITS = (
    (50.0, ("ios", "android", "mobile")),
    (20.0, ("kernel", "driver", "firmware")),
    (75.0, ("cli", "command", "terminal", "shell")),
    (85.0, ("web", "app", "dashboard", "browser", "ui")),
    (60.0, ()),
)


def fit_kind(title: Column) -> Column:
    """Place in FITS of the first kind that has a word in the title; of several titles the least counts."""
    text = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(*(F.when(F.rlike(text, F.lit("|".join(words))), F.lit(k)) for k, (_, words) in enumerate(FITS) if words), F.lit(len(FITS) - 1))


def scored(kind: Column, n: Column) -> Column:
    """struct(suitability, demand, feasibility, freshness, overall) of a cluster of n titles of a kind."""
    fit = F.element_at(F.array(*(F.lit(v) for v, _ in FITS)), (kind + 1).cast("int"))
    demand = F.least(n * 12.0, F.lit(100.0))
    overall = F.round(fit * 0.35 + demand * 0.30 + 70 * 0.20 + 50 * 0.15, 1)
    return F.struct(fit.alias("suitability"), demand.alias("demand"), F.lit(70.0).alias("feasibility"), F.lit(50.0).alias("freshness"), overall.alias("overall"))


def heuristic_score(titles: Column, n: Column) -> Column:
    """`scored` of a cluster whose titles are one text."""
    return scored(fit_kind(titles), n)
