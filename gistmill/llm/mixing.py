"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the output over its share of the input. Each document's number of copies is the
inverse of the Poisson distribution with that mean at a point in [0, 1) taken from a hash of seed and document, so it
is the same in every run and on every machine, and expected output shares equal the targets without any coordination
between tasks. All of it is DataFrame expressions; the copies are dealt to the tasks at random and sorted there by
a hash of document and copy, which is a shuffle of the whole without a pass to find range bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "mix-1"
#: Without given targets a source's weight is its size to this power, which lifts small sources and lowers large ones.
POWER = 0.5
#: Up to so many sources their rates are broadcast; beyond, they are joined, and the planner splits hot sources.
BROADCAST_SOURCES = 20_000
#: Rates above this are split: whole copies below it, a Poisson number of the rest, so that the inversion stays short.
LARGEST_MEAN = 32.0


def hash_point(*parts: Column) -> Column:
    """A number in [0, 1) with 52 random bits from the md5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_steps(mean: Column) -> Column:
    """Array of the distribution function of a Poisson variable at 0, 1, 2, ... as far as doubles go."""
    far = F.ceil(mean + 10 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("upto"))
    step = lambda a, k: F.struct((a["p"] * mean / k).alias("p"), F.concat(a["upto"], F.array(F.element_at(a["upto"], -1) + a["p"] * mean / k)).alias("upto"))
    return F.aggregate(F.sequence(F.lit(1), far), start, step, lambda a: a["upto"])


def rates(docs: DataFrame, targets: dict[str, float] | None = None, size: Column | None = None, power: float = POWER, epochs: float = 1.0) -> DataFrame:
    """One row per source: source, share, target, rate and the distribution steps of its Poisson part.

    targets: weights by source, scaled to sum to 1; sources without one get none. epochs: output size over input size.
    A null source is a source of its own, the empty string's.
    """
    size = F.coalesce(F.length("text"), F.lit(0)) + 1 if size is None else size
    sums = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("mix_source"), size.cast("long").alias("mix_size")).groupBy("mix_source").agg(F.sum("mix_size").alias("size"))
    if targets:
        weight = F.coalesce(F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("mix_source")], F.lit(0.0))
    else:
        weight = F.pow(F.col("size").cast("double"), power)
    weighed = sums.withColumn("weight", weight)
    total = weighed.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.round(F.lit(epochs) * F.try_divide("weight", "all_weight") * F.col("all_size") / F.col("size"), 9)
    out = weighed.crossJoin(F.broadcast(total)).withColumn("rate", F.coalesce(rate, F.lit(0.0)))
    whole = F.greatest(F.ceil(F.col("rate") - LARGEST_MEAN), F.lit(0)).cast("int")
    return out.select("mix_source", F.col("rate"), whole.alias("whole"), poisson_steps(F.col("rate") - whole).alias("steps"))


def replicate(docs: DataFrame, targets: dict[str, float] | None = None, size: Column | None = None, power: float = POWER, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """The rows of `docs`, each as often as its Poisson number says, with copy (from 0), mix_rate and shuffle_key.

    Rows with one doc_id get one number (the point is a hash of the id); a null id counts as the empty string. Copies
    come in the order of shuffle_key within each partition, and partitions are dealt by it. Own columns named copy,
    mix_rate or shuffle_key are replaced. An empty table gives no rows.
    """
    table = rates(docs, targets, size, power, epochs)
    few = table.select("mix_source").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    plain = docs.drop("copy", "mix_rate", "shuffle_key").withColumn("mix_source", F.coalesce(F.col("source").cast("string"), F.lit("")))
    joined = plain.join(F.broadcast(table) if few else table, "mix_source")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    point = hash_point(F.lit(seed), name)
    # the point's place among the steps is the inverse; without a lambda, since one that names another column may be
    # moved to a side of the join that does not have it
    number = F.col("whole") + F.array_position(F.sort_array(F.array_append("steps", point)), point).cast("int") - 1
    copies = joined.withColumn("mix_n", number).where("mix_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("mix_n") - 1)))
    keyed = copies.withColumn("shuffle_key", F.xxhash64(F.lit(seed), name, "copy")).withColumnRenamed("rate", "mix_rate")
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key").select(*(c for c in docs.columns if c not in ("copy", "mix_rate", "shuffle_key")), "copy", "mix_rate", "shuffle_key")

