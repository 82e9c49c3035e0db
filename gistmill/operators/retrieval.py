"""Embedding hooks, an inverted-file index for approximate search, and retrieval that falls back on words."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.vectors import DIMENSIONS
from .prefix import running

Embedder = Callable[[list[str]], np.ndarray]
#: Vectors that centres are fitted on, at most; cells, at most; rows and queries of a cell that are compared in one go.
SAMPLE, MOST_CELLS, PART, ASKED = 16_384, 4096, 16_384, 1024


def hashed_tokens(texts: list[str]) -> np.ndarray:
    """Unit vectors of token counts in buckets by sha256, zero for texts without tokens: the default embedding."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, t in zip(out, texts, strict=True):
        for token in t.lower().split():
            row[int.from_bytes(hashlib.sha256(token.encode()).digest()[:2], "big") % DIMENSIONS] += 1
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-30)


def embedded(rows: DataFrame, text: str, embed: Embedder = hashed_tokens, batch: int = 64) -> DataFrame:
    """Rows with `embedding`, an array<float> by a model that takes a list of texts; null texts are empty ones.

    The model is called on the executors, `batch` texts at a time; it is imported and loaded there by `embed` itself.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                got = np.asarray(embed([t or "" for t in part.column(text).to_pylist()]), np.float32)
                offsets = pa.array(np.arange(len(got) + 1, dtype=np.int32) * got.shape[1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(got.ravel()))], [*part.schema.names, "embedding"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, embedding array<float>")


#: White space in the sense of Unicode.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def _counts(text: str | None, known: dict[str, int]) -> Counter:
    """Tokens of a text by bucket; known: buckets found before."""
    out: Counter = Counter()
    text = (text or "").lower()
    # split() also takes four control characters for white space
    tokens = SPACE.split(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
    for token, n in Counter(tokens).items():
        if token:
            if token not in known:
                if len(known) > 200_000:
                    known.clear()
                known[token] = int.from_bytes(hashlib.sha256(token.encode()).digest()[:2], "big") % DIMENSIONS
            out[known[token]] += n
    return out


@F.pandas_udf(BinaryType())
def packed_vector(texts: pd.Series) -> pd.Series:
    """The unit vector of a text's token counts in buckets (see `hash_embedding`) as doubles, null without tokens."""
    known: dict[str, int] = {}

    def of(text: str | None) -> bytes | None:
        counts, out = _counts(text, known), np.zeros(DIMENSIONS)
        norm = sum(n * n for n in counts.values()) ** 0.5
        for b, n in counts.items():
            out[b] = n / norm
        return out.tobytes() if counts else None

    return texts.map(of)


@F.pandas_udf(DoubleType())
def hashed_score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Product of the unit vector of a text's token counts with a packed one; of the vectors only a number leaves the row."""
    known: dict[str, int] = {}
    unpacked: dict[bytes, list[float]] = {}

    def of(text: str | None, packed: bytes) -> float:
        if packed not in unpacked:
            if len(unpacked) > 1000:
                unpacked.clear()
            unpacked[packed] = np.frombuffer(packed).tolist()
        q, counts, total = unpacked[packed], _counts(text, known), 0.0
        norm = sum(n * n for n in counts.values()) ** 0.5
        for b, n in sorted(counts.items()):
            total += n / norm * q[b]
        return total

    for texts, queries in batches:
        yield pd.Series([of(t, q) for t, q in zip(texts, queries, strict=True)], dtype="float64")


def nearest_texts(rows: DataFrame, text: str, queries: DataFrame, asked: str, by: str, k: int, least: float = 0.0) -> DataFrame:
    """rows with score, the k most similar to the text of their `by`'s query; scores, to nine digits, under `least` go.

    queries: (by, asked), one row for each `by`; their vectors, 3 kB each, are broadcast. A row's product is made within
    the row, so what is shuffled is the best k of each task and query. Rows that tie are taken in the order of their
    other columns.
    """
    q = queries.select(by, packed_vector(asked).alias("_q")).where("_q IS NOT NULL")
    scored = rows.join(F.broadcast(q), by).withColumn("score", F.round(hashed_score(text, "_q"), 9)).drop("_q").where(F.col("score") >= least)
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), *(c for c in rows.columns if c != by)))
    return scored.withColumn("_nth", nth).where(F.col("_nth") <= k).drop("_nth")


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Unit vectors as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, key: str, vector: str, dims: int | None = None) -> DataFrame:
    """(key, vector) of vectors that have a direction: no null or non-finite component, not all zero, of `dims` if given."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(key).alias("key"), x.cast("array<float>").alias("vector")).where(fine & F.col("key").isNotNull())
    return rows.where(F.size("vector") == dims) if dims else rows


def centres(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most `cells` unit centres by spherical k-means, on the `sample` vectors whose keys hash lowest.

    The sample is what the driver holds. The length that most of it has is that of the index; others are left out.
    """
    got = vectors.orderBy(F.xxhash64("key"), "key").limit(sample).toArrow()
    if not got.num_rows:
        return np.zeros((0, 0))
    lists = got.column("vector").combine_chunks()
    lengths = pc.list_value_length(lists)
    dims = np.bincount(lengths.to_numpy()).argmax()
    x = _matrix(lists.filter(pc.equal(lengths, pa.scalar(dims, pa.int32()))), dims)
    x = np.unique(np.round(x, 12), axis=0)
    rng = np.random.default_rng(seed)
    middle = x[np.sort(rng.choice(len(x), min(cells, len(x)), replace=False))]
    for _ in range(rounds):
        near = (x @ middle.T).argmax(axis=1)
        total = np.zeros_like(middle)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        middle = np.where(size > 0, total / np.maximum(size, 1e-30), middle)
    return middle


def _nearest_cells(middle: np.ndarray, many: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = _matrix(b.column("vector"), middle.shape[1]) @ middle.T
            cells = np.argsort(-near, axis=1, kind="stable")[:, :many].astype(np.int32)
            offsets = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("vector"), pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))], ["key", "vector", "cells"])

    return run


@dataclass
class Index:
    """An inverted file: vectors as Parquet partitioned by their nearest centre, and the centres beside them."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, vectors: DataFrame, path: str, key: str, vector: str, cells: int | None = None, sample: int = SAMPLE) -> Index:
        """Fit centres on a bounded sample (see `centres`), then write every usable vector under its cell.

        cells: the square root of the number of vectors unless given. Rows repeated with a key stay rows of their own.
        """
        rows = usable(vectors, key, vector)
        cells = cells or min(MOST_CELLS, max(1, round(rows.count() ** 0.5)))
        middle = centres(rows, cells, sample)
        spark = vectors.sparkSession
        schema = "cell int, centre array<double>"
        spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(middle)], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        index = cls(spark, path)
        index._write(rows, "overwrite")
        return index

    def add(self, vectors: DataFrame, key: str, vector: str) -> None:
        """Append vectors under the centres that there are."""
        self._write(usable(vectors, key, vector), "append")

    @cached_property
    def middle(self) -> np.ndarray:
        got = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").toArrow()
        return np.array(got.column("centre").to_pylist(), float).reshape(got.num_rows, -1 if got.num_rows else 0)

    def _write(self, rows: DataFrame, mode: str) -> None:
        kind = rows.schema["key"].dataType.simpleString()
        if not len(self.middle):
            rows.withColumn("cell", F.lit(0)).where("false").write.mode(mode).parquet(f"{self.path}/vectors")
            return
        own = rows.where(F.size("vector") == self.middle.shape[1]).mapInArrow(_nearest_cells(self.middle, 1), f"key {kind}, vector array<float>, cells array<int>")
        dealt = own.select("key", "vector", F.element_at("cells", 1).alias("cell")).withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(8)))
        dealt.repartition("cell", "_salt").drop("_salt").write.mode(mode).partitionBy("cell").parquet(f"{self.path}/vectors")

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        """(key, vector, cell) of all cells, or of some: only their folders are read."""
        rows = self.spark.read.parquet(f"{self.path}/vectors")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, key: str, vector: str, k: int = 10, probes: int = 8, part: int = PART, asked: int = ASKED) -> DataFrame:
        """(query_id, rank, key, score): the k rows most similar to each query among its `probes` nearest cells.

        Scores are cosines to nine digits, ties to the smaller key; a row under the query's own id is no hit. With as
        many probes as cells the result is exact. Queries without a direction have no hits; of vectors under one query id
        the smallest asks.
        Of a cell, `part` rows on average meet `asked` queries in a task, so neither a large cell nor one that many
        queries ask for is held at once; what the driver gets is a row for each cell.
        """
        kind = queries.schema[key].dataType.simpleString()
        own = self.spark.read.parquet(f"{self.path}/vectors").schema["key"].dataType.simpleString()
        schema = f"query_id {kind}, key {own}, score double"
        if not len(self.middle):
            return self.spark.createDataFrame([], f"query_id {kind}, rank int, key {own}, score double")
        dims = self.middle.shape[1]
        asking = usable(queries, key, vector, dims).groupBy("key").agg(F.min("vector").alias("vector"))
        probed = asking.mapInArrow(_nearest_cells(self.middle, probes), f"key {kind}, vector array<float>, cells array<int>")
        probed = probed.select(F.col("key").alias("query_id"), F.col("vector").alias("query"), F.explode("cells").alias("cell"))
        wanted = {r["cell"]: r["n"] for r in probed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        rows = self.vectors(sorted(wanted))
        held = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        split = [(c, -(-held[c] // part), -(-wanted[c] // asked)) for c in held]
        sized = lambda df: df.join(F.broadcast(self.spark.createDataFrame(split, "cell int, parts int, blocks int")), "cell")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        sent = sized(rows).withColumn("part", deal("key", "parts")).withColumn("block", each("blocks"))
        posed = sized(probed).withColumn("block", deal("query_id", "blocks")).withColumn("part", each("parts"))
        by = ["cell", "part", "block"]
        met = sent.groupBy(*by).cogroup(posed.groupBy(*by)).applyInArrow(_best(k, dims), schema)
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
        return met.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "key", "score")


def _best(k: int, dims: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        """The k best rows for each query of a cell's part."""
        asked, ids = queries.column("query_id").combine_chunks(), rows.column("key").combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if rows.num_rows and queries.num_rows:
            code = pa.concat_arrays([asked, ids.cast(asked.type)]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            rank = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
            x = _matrix(rows.column("vector"), dims)
            for at in range(0, queries.num_rows, 64):
                score = np.round(_matrix(queries.column("query").slice(at, 64), dims) @ x.T, 9)
                for q, s in enumerate(score, at):
                    s[code[queries.num_rows :] == code[q]] = -2
                    best = np.lexsort((rank, -s))[:k] if len(s) <= 4 * k else _leading(s, rank, k)
                    best = best[s[best] > -2]
                    out.append((np.full(len(best), q), best, s[best]))
        q, r, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"query_id": asked.take(pa.array(q)), "key": ids.take(pa.array(r)), "score": pa.array(s, pa.float64())})

    return run


def _leading(s: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    least = -np.partition(-s, k - 1)[k - 1]
    near = np.flatnonzero(s >= least)
    return near[np.lexsort((rank[near], -s[near]))[:k]]


def with_fallback(hits: DataFrame, rows: DataFrame, queries: DataFrame, key: str, title: Column, body: Column, most: int = 50) -> DataFrame:
    """`hits` (query_id, rank, key, score), and for queries without a hit the first rows that hold their words.

    queries: (query_id, word). A query that no vector answers gets at most `most` rows, by key, whose title or body
    contains its word in any case; their score is null. An empty word is in every row.
    """
    open_ = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    text = rows.select(F.col(key).alias("key"), F.lower(F.concat_ws("\n", title, body)).alias("_text"))
    met = text.join(F.broadcast(open_), F.contains(F.col("_text"), F.lower("word"))).select("query_id", "key")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("key"))
    found = met.withColumn("rank", nth).where(F.col("rank") <= most).withColumn("score", F.lit(None).cast("double"))
    return hits.unionByName(found.select(*hits.columns))


def within_budget(ranked: DataFrame, order: list, length: Column, budget: int, by: list[str] | None = None) -> DataFrame:
    """The leading rows whose lengths together stay within a budget; stops at the first that does not fit.

    Lengths are running sums over ranges of rows, so a key of any size takes many tasks; order leaves no ties.
    """
    return running(ranked, by or [], order, {"_used": length}).where(F.col("_used") <= budget).drop("_used")


def truncated_to_budget(ranked: DataFrame, order: list, text: str, budget: int, by: list[str] | None = None) -> DataFrame:
    """The leading rows within a budget, the one that overflows cut to what is left."""
    size = F.coalesce(F.length(text), F.lit(0))
    rows = running(ranked, by or [], order, {"_used": size})
    left = F.lit(budget) - (F.col("_used") - size)
    return rows.withColumn("_left", left).where("_left > 0").withColumn(text, F.left(text, F.col("_left").cast("int"))).drop("_left", "_used")


def need_link(title: Column, shown: Column | None = None) -> Column:
    """A wiki link to a page of needs, with what would end it taken out of the title."""
    safe = T.link_safe(title)
    return F.concat(F.lit("[[02-需求池/"), safe, F.lit("|"), T.link_safe(shown) if shown is not None else safe, F.lit("]]"))
