"""Exact top-k inner-product search with a ball tree per shard.

Vectors are dealt by a hash to shards of bounded size and queries to blocks; a task gets one shard and one block, builds
the shard's ball tree and runs branch and bound for all queries of the block at once: a node is entered by those queries
whose upper bound q.c + |q| r reaches their current kth score, the child with the higher bound first. Every query
starts with the kth score it reaches on a small fixed sample of all vectors, so that shards share a bound from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 2048, 64
#: Vectors of the sample that gives each query its first kth score; so many are broadcast, whatever the input.
SAMPLE_ROWS = 1024
SCALE = 1024.0
NONE = -np.iinfo(np.int64).max


def whole_vectors(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id, v (array<long>: floor of scale times each component), copies: how many rows hold that.

    Null ids, null or empty vectors and those with a null or non-finite component are left out; components beyond 2^62
    are held there.
    """
    real = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(1 << 62)), F.lit(-(1 << 62))).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & real).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))


class Products:
    """Exact integer inner products of rows; in doubles as long as every sum is below 2^53."""

    def __init__(self, rows: np.ndarray, largest: int):
        top = max(int(np.abs(rows).max(initial=0)), largest)
        self.kind = float if rows.shape[1] * top * top < 1 << 53 else np.int64 if rows.shape[1] * top * top < 1 << 63 else object
        self.rows = rows.astype(self.kind)

    def __call__(self, part: slice, queries: np.ndarray) -> np.ndarray:
        got = queries.astype(self.kind) @ self.rows[part].T
        return np.clip(got, NONE + 1, -NONE).astype(np.int64) if self.kind is object else got.astype(np.int64)


class BallTree:
    """Rows in an order where every node is a slice, with its center and radius."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, k: int, largest: int):
        # of equal vectors no more than the 2 k first rows can be among the best k of any query: its own id has k at most
        order = np.lexsort((ids, *rows.T[::-1]))
        rows, ids = rows[order], ids[order]
        fresh = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
        nth = np.arange(len(ids)) - np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
        rows, ids = rows[nth < 2 * k], ids[nth < 2 * k]
        self.nodes: list[tuple[slice, np.ndarray, float, int, int]] = []
        self.points, self.order = rows.astype(float), np.arange(len(ids))
        self.root = self._build(0, len(ids))
        self.ids, self.products = ids[self.order], Products(rows[self.order], largest)
        del self.points

    def _build(self, a: int, b: int) -> int:
        own = self.points[self.order[a:b]]
        center = own.mean(axis=0)
        away = np.sqrt(((own - center) ** 2).sum(axis=1))
        radius, left, right = float(away.max()), -1, -1
        if b - a > LEAF_ROWS and radius > 0:
            far = own[int(away.argmax())]
            other = own[int(((own - far) ** 2).sum(axis=1).argmax())]
            line = own @ (far - other)
            order = np.argsort(line, kind="stable")
            self.order[a:b] = self.order[a:b][order]
            middle = a + (b - a) // 2
            left, right = self._build(a, middle), self._build(middle, b)
        self.nodes.append((slice(a, b), center, radius, left, right))
        return len(self.nodes) - 1

    def search(self, queries: np.ndarray, own_ids: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Best scores and ids, k of each query, NONE where there are fewer; nothing below `first` is looked for."""
        plain = queries.astype(float)
        norms = np.sqrt((plain**2).sum(axis=1))
        scores, found = np.full((len(queries), k), NONE), np.full((len(queries), k), np.iinfo(np.int64).max)
        kth = first.astype(float)

        def bound(node: int, active: np.ndarray) -> np.ndarray:
            _, center, radius, _, _ = self.nodes[node]
            upper = plain[active] @ center + norms[active] * radius
            return np.maximum(upper + np.abs(upper) * 1e-9 + 1 + norms[active] * 1e-6, float(NONE))

        def visit(node: int, active: np.ndarray, upper: np.ndarray) -> None:
            part, _, _, left, right = self.nodes[node]
            active = active[upper >= kth[active]]
            if not len(active):
                return
            if left < 0:
                for at in range(part.start, part.stop, 4096):
                    piece = slice(at, min(part.stop, at + 4096))
                    got = self.products(piece, queries[active])
                    got[self.ids[piece][None, :] == own_ids[active][:, None]] = NONE
                    good = got.max(axis=1) >= kth[active]
                    rows = active[good]
                    every = np.concatenate([scores[rows], got[good]], axis=1)
                    names = np.concatenate([found[rows], np.broadcast_to(self.ids[piece], got[good].shape)], axis=1)
                    best = np.lexsort((names, -every), axis=-1)[:, :k]
                    scores[rows], found[rows] = np.take_along_axis(every, best, 1), np.take_along_axis(names, best, 1)
                    kth[rows] = np.maximum(kth[rows], scores[rows, -1])
                return
            a, b = bound(left, active), bound(right, active)
            early = a >= b
            visit(left, active[early], a[early])
            visit(right, active, b)
            visit(left, active[~early], a[~early])

        visit(self.root, np.arange(len(queries)), np.full(len(queries), np.inf))
        return scores, found


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each query, ties to the smaller vec_id.

    Queries are the vectors whose id is divisible by `every`, of different vectors under one id the smallest; candidates
    are all rows under other ids, repeated ones as often as they come. Vectors of another length than the query's are no
    candidates. An empty table, or one without queries, gives no rows. Other columns are ignored.
    """
    whole = whole_vectors(vectors, scale).withColumn("d", F.size("v"))
    totals = whole.agg(F.coalesce(F.sum(F.least("copies", F.lit(k))), F.lit(0)).alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    shards, blocks, top = max(1, math.ceil(totals["n"] / SHARD_ROWS)), max(1, math.ceil((totals["q"] or 0) / BLOCK_ROWS)), int(totals["top"] or 0)
    spark = vectors.sparkSession
    some = whole.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE_ROWS).collect()
    sample = spark.sparkContext.broadcast([(r["vec_id"], r["d"], np.array(r["v"], np.int64)) for r in some])

    def first_bound(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = {d: (np.array([i for i, e, _ in sample.value if e == d]), np.stack([v for _, e, v in sample.value if e == d])) for d in {e for _, e, _ in sample.value}}
        for batch in batches:
            out = []
            for doc, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids, rows = by_size.get(len(v), (np.zeros(0), np.zeros((0, len(v)))))
                got = Products(rows, top)(slice(None), np.array([v], np.int64))[0][ids != doc]
                out.append(int(np.sort(got)[-k]) if len(got) >= k else NONE)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "first"])

    asking = whole.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    queries = asking.mapInArrow(first_bound, "vec_id long, v array<long>, d int, first long")
    spread = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # every block of queries meets every shard once; both sizes are fixed, so a task's share is
    # rows repeated are one until here; k of them are all that the best k of a query can hold
    rows = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int")))).drop("copies", "copy")
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and asked.num_rows:
            ids = rows["vec_id"].to_numpy()
            tree = BallTree(_matrix(rows["v"], rows.num_rows), ids, k, top)
            own = asked["vec_id"].to_numpy()
            scores, found = tree.search(_matrix(asked["v"], asked.num_rows), own, asked["first"].to_numpy(), k)
            real = scores > NONE
            out.append((np.repeat(own, k).reshape(-1, k)[real], found[real], scores[real]))
        parts = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.table({n: pa.array(p, pa.int64()) for n, p in zip(("query_id", "vec_id", "score"), parts, strict=True)})

    keys = ["d", "shard", "block"]
    best = dealt.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
