"""Vector expressions and retrieval."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

DIMENSIONS = 384


def token_bucket(token: Column, dims: int = DIMENSIONS) -> Column:
    """Bucket of a token: its sha256's first two bytes modulo the dimensions."""
    return (F.conv(F.left(F.sha2(token, 256), F.lit(4)), 16, 10).cast("int") % dims).cast("int")


def hash_embedding(docs: DataFrame, key: str, text: str, dims: int = DIMENSIONS) -> DataFrame:
    """Sparse unit vectors of token counts: (key, bucket, weight) rows; a text without tokens has none."""
    tokens = docs.select(key, F.explode(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != "")).alias("token"))
    counts = tokens.groupBy(key, token_bucket(F.col("token"), dims).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)).cast("double"))
    return counts.select(key, "bucket", (F.col("n") / norm).alias("weight"))


def dense(sparse: DataFrame, key: str, dims: int = DIMENSIONS) -> DataFrame:
    """(key, vector) with array<float> from bucket and weight rows."""
    filled = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    return filled.select(key, F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)).cast("float")).alias("vector"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, not below 0; 0 for zero vectors."""
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)))


@F.pandas_udf(DoubleType())
def cosine_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same on Arrow batches with numpy, for long vectors of one length."""
    x, y = np.stack(a.to_numpy()).astype(float), np.stack(b.to_numpy()).astype(float)
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    return pd.Series(np.maximum(0.0, np.divide((x * y).sum(axis=1), norm, out=np.zeros(len(x)), where=norm > 0)))


def nearest(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k vectors most similar to the one query row, with score; ties to the smaller key.

    `query` must be a single row: it is what is broadcast.
    """
    asked = query.select(F.col(vector).alias("_q")).limit(1)
    scored = vectors.crossJoin(F.broadcast(asked)).withColumn("score", cosine(F.col(vector), F.col("_q"))).drop("_q")
    return scored.orderBy(F.desc("score"), key).limit(k)


def nearest_sparse(vectors: DataFrame, queries: DataFrame, key: str, by: str, k: int, least: float = 0.0) -> DataFrame:
    """(by, key, score): the k keys most similar to each query of `by`, from (by, key, bucket, weight) and (by, bucket, weight).

    Scores, to nine digits, under `least` are left out; ties to the smaller key.
    """
    met = vectors.join(queries.select(by, "bucket", F.col("weight").alias("_q")), [by, "bucket"])
    scored = met.groupBy(by, key).agg(F.round(F.sum(F.col("weight") * F.col("_q")), 9).alias("score")).where(F.col("score") >= least)
    return scored.withColumn("_nth", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))).where(F.col("_nth") <= k).drop("_nth")


def context_text(ranked: DataFrame, order: list, source: str, title: str, text: str, by: list[str] | None = None) -> DataFrame:
    """One row, or one for each value of `by`: passages headed by their source, in order, with rules between them."""
    part = F.concat(F.lit("[来源: "), F.col(source), F.lit(" | "), F.col(title), F.lit("]\n"), F.col(text))
    by = by or []
    rows = ranked.withColumn("_nth", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order))).select(*by, "_nth", part.alias("part"))
    return (rows.groupBy(*by) if by else rows).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_nth", "part"))), lambda x: x["part"]), "\n\n---\n\n").alias("context"))
