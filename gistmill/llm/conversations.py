"""Prefix trie of conversations by chained digests.

Every turn is a digest of its role and text; the digest of a prefix chains those of its turns, so equal prefixes of
different conversations meet under one (depth, digest), a node. Texts never leave the scan.

A node belongs to its smallest member. The nodes of one owner are a run of depths, a chain: whoever is the smallest
member at a depth is so below it. Subtree sums explode nodes to their ancestors with the nodes of a chain added first:
a chain's sums go to every prefix above its top, and within a chain they are running sums from below. So a node of
depth d costs no d rows, and what is exploded is as many rows as there are prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import running
from .common import Scratch

#: Turns whose digests one task chains in a row; longer conversations chain the ends of their blocks, too.
BLOCK = 1024
#: Conversation ids that are joined to one piece of text before they are hashed.
PIECE = 1 << 16


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, n): a row for each turn, without its text; n is its length in code points."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    mark = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(mark, 256)).alias("digest"), F.length(text).cast("long").alias("n"))


def rebuilt(ordered: DataFrame, most: int = 6, every: int = 100) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations, and (conv_id, p, digest, n), their turns from 0, from turns numbered by `nth` from 1.

    A conversation c begins with the first h turns of conversation c - c % every and goes on with its own after the
    first h, where h is crc32(c) % most.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    lead = F.col("conv_id") - F.col("conv_id") % every
    top = ordered.where((F.col("conv_id") == lead) & (F.col("nth") < most))
    tops = top.groupBy(F.col("conv_id").alias("lead")).agg(F.array_sort(F.collect_list(F.struct("nth", "digest", "n"))).alias("top"))
    ids = ordered.where("nth = 1").select("conv_id")
    taken = ids.select("conv_id", lead.alias("lead"), h.cast("int").alias("h")).join(tops, "lead").where("h > 0")
    head = taken.select("conv_id", F.posexplode(F.slice("top", F.lit(1), F.col("h"))).alias("p", "x")).select("conv_id", F.col("p").cast("long").alias("p"), "x.digest", "x.n")
    size = tops.select("lead", F.size("top").alias("size"))
    own = ordered.withColumns({"h": h, "lead": lead}).where("nth > h").join(size, "lead", "left")
    shift = F.least(F.coalesce("size", F.lit(0)), F.col("h"))
    return ids, head.unionByName(own.select("conv_id", (shift + F.col("nth") - F.col("h") - 1).alias("p"), "digest", "n"))


def _chained(block: int):
    """Digests of prefixes within a block, from rows sorted by (conv_id, p)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, b""
        for batch in batches:
            conv, place, digests = (batch.column(c).to_pylist() for c in ("conv_id", "p", "digest"))
            out, parent = [], []
            for c, p, d in zip(conv, place, digests, strict=True):
                if at != (c, p // block):
                    at, last = (c, p // block), b""
                parent.append(last)
                last = hashlib.sha256(last + d).digest()
                out.append(last)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("p"), pa.array(out, pa.binary()), pa.array(parent, pa.binary()), batch.column("n")], ["conv_id", "p", "digest", "parent", "n"])

    return run


def _block_heads(block: int):
    """For every block after the first: the chain of the ends of those before it, and the digest of the prefix before it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            out = []
            for c, p, end in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "p", "digest")), strict=True):
                if at != c:
                    at, chain, whole = c, b"", end
                else:
                    whole = hashlib.sha256(chain + end).digest()
                chain = hashlib.sha256(chain + end).digest()
                out.append({"conv_id": c, "block": p // block + 1, "chain": chain, "before": whole})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("chain", pa.binary()), ("before", pa.binary())]))

    return run


def prefixes(rows: DataFrame, scratch: Scratch, size: int = BLOCK) -> DataFrame:
    """(conv_id, depth, digest, parent, n): every prefix of one turn or more; parent is the digest of the one before."""
    block = F.floor(F.col("p") / size)
    dealt = rows.withColumn("block", block).repartition("conv_id", "block").sortWithinPartitions("conv_id", "p")
    inner = scratch.cut(dealt.drop("block").mapInArrow(_chained(size), "conv_id long, p long, digest binary, parent binary, n long"), "inner")
    ends = inner.where(F.col("p") % size == size - 1).select("conv_id", "p", "digest")
    heads = ends.repartition("conv_id").sortWithinPartitions("conv_id", "p").mapInArrow(_block_heads(size), "conv_id long, block long, chain binary, before binary")
    depth = (F.col("p") + 1).alias("depth")
    short = inner.where(F.col("p") < size).select("conv_id", depth, "digest", "parent", "n")
    joined = inner.where(F.col("p") >= size).withColumn("block", block).join(heads, ["conv_id", "block"])
    parent = F.when(F.length("parent") == 0, F.col("before")).otherwise(_sha(F.col("chain"), F.col("parent")))
    return short.unionByName(joined.select("conv_id", depth, _sha(F.col("chain"), F.col("digest")).alias("digest"), parent.alias("parent"), "n"))


def _joined(size_limit: int):
    """Ids of each node joined by commas, from rows sorted by (digest, conv_id).

    A node wholly in this task comes out hashed. What may go on in another task, or is large, comes out in pieces.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, ids, size, cut, first, piece = TaskContext.get().partitionId(), None, [], 0, False, True, 0
        out: list[dict] = []

        def close(whole: bool) -> None:
            nonlocal ids, size, piece
            text = ",".join(ids)
            hashed = hashlib.sha256(text.encode()).hexdigest() if whole else None
            out.append({"digest": at, "part": part, "piece": piece, "ids": None if whole else text, "hash": hashed})
            ids, size, piece = [], 0, piece + 1

        schema = pa.schema([("digest", pa.binary()), ("part", pa.int32()), ("piece", pa.int32()), ("ids", pa.string()), ("hash", pa.string())])
        for batch in batches:
            for d, c in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if d != at:
                    if at is not None:
                        close(not first and not cut)
                        first = False
                    at, cut, piece = d, False, 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
                if size > size_limit:
                    close(False)
                    cut = True
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if at is not None:
            close(False)
        yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of nodes from their pieces in order."""
    at, state, begun, out = None, None, False, []
    for batch in batches:
        for d, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if d != at:
                if at is not None:
                    out.append((at, state.hexdigest()))
                at, state, begun = d, hashlib.sha256(), False
            if ids:  # a piece may be empty where a full one was closed just before
                state.update((b"," if begun else b"") + ids.encode())
                begun = True
    if at is not None:
        out.append((at, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], ["digest", "hash"])


def member_hashes(members: DataFrame, scratch: Scratch, piece: int = PIECE) -> DataFrame:
    """(digest, ends_sha256) from (digest, conv_id): SHA-256 of the ids of each digest, ascending and joined by commas.

    Ids of one digest cover as many tasks as they need; the one task that a hash takes by its nature gets them as text
    in pieces of 64 kB and holds one at a time.
    """
    dealt = members.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    parts = scratch.cut(dealt.mapInArrow(_joined(piece), "digest binary, part int, piece int, ids string, hash string"), "members")
    cut = parts.where("hash IS NULL").repartition("digest").sortWithinPartitions("digest", "part", "piece")
    rest = cut.select("digest", "ids").mapInArrow(_hashed, "digest binary, hash string")
    return parts.where("hash IS NOT NULL").select("digest", "hash").unionByName(rest).withColumnRenamed("hash", "ends_sha256")


def trie(conversations: DataFrame, most: int = 6, every: int = 100, block: int = BLOCK, piece: int = PIECE) -> DataFrame:
    """The nodes of the prefix trie of the rebuilt conversations, as in the module's and `rebuilt`'s docstrings.

    Turns are ordered by (turn, digest of role and text), null turns first, so rows that tie have one order. Rows
    repeated are turns like others. Null roles and texts are empty. Rows without a conv_id belong to no conversation.
    Conversations without turns are members of the root. No conversations: no nodes. Other columns are ignored.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    numbered = running(turns(conversations), ["conv_id"], ["turn", "digest"], {"nth": F.lit(1)})
    ids, rows = rebuilt(numbered, most, every)
    ids = scratch.cut(ids, "ids")
    paths = scratch.cut(prefixes(rows, scratch, block), "prefixes")

    plain = paths.groupBy("depth", "digest").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"), F.min("n").alias("n"))
    plain = scratch.cut(plain, "plain")
    children = plain.groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = plain.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = scratch.cut(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n")}), "nodes")

    chains = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.min_by("parent", "depth").alias("parent"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    chains = scratch.cut(chains, "chains")
    above = paths.select("conv_id", "depth", "digest").join(chains.drop("parent"), "conv_id").where("depth < top")
    hanging = above.groupBy("digest").agg(F.sum("leaf").alias("leaf_below"), F.sum("saved").alias("saved_below"))
    owners = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("above"))
    tops = chains.where("top > 1").join(owners, "parent").select("conv_id", F.col("top").alias("depth"), "above")

    last = paths.groupBy("conv_id").agg(F.max_by("digest", "depth").alias("digest"))
    empty = ids.join(last, "conv_id", "left_anti").select("conv_id", F.unhex(F.lit("")).alias("digest"))
    hashes = member_hashes(last.unionByName(empty).select("digest", "conv_id"), scratch, piece)
    nothing = F.sha2(F.lit(""), 256)

    summed = running(nodes.drop("parent", "n"), ["conv_id"], [F.col("depth").desc()], {"leaf": F.col("leaf"), "saved": F.col("saved")})
    root = ids.agg(F.min("conv_id").alias("root_id"), F.count(F.lit(1)).alias("n_convs"))
    parent = F.when(F.col("depth") == 1, F.col("root_id")).otherwise(F.coalesce("above", "conv_id"))
    inner = summed.join(hanging, "digest", "left").join(tops, ["conv_id", "depth"], "left").crossJoin(F.broadcast(root.select("root_id")))
    inner = inner.select(
        "digest", "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaf") + F.coalesce("leaf_below", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("saved_below", F.lit(0))).alias("saved_tokens"),
    )
    total = chains.agg(F.coalesce(F.count_if(F.col("top") == 1), F.lit(0)).alias("tops"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    top = root.where("n_convs > 0").crossJoin(total).select(
        F.unhex(F.lit("")).alias("digest"), F.col("root_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.col("tops").alias("n_children"), F.coalesce("leaf", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
    )
    return inner.unionByName(top).join(hashes, "digest", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)).drop("digest")
