"""Components of verified links among ids that share keys, without forming all pairs of a group.

Where ids have sketches, parities of the number of features per cell of the feature domain, these come first: they never
differ in more cells than the sets in features, so a group falls into the parts whose ids are joined by sketches that
allow the threshold, before any content moves, and equal parts of several groups are one. Then every key compares its
most central id, the one under the most keys, with the others: ids go with their content to the central id, a bounded
number to a task, and are compared there. Links are contracted into components, and keys whose ids are all in one are
done. The other keys are merged into families where they share ids, and the ids of a family are dealt to blocks of
bounded size and compared exactly inside the task, by counting common features; a block gives a spanning forest of its
links, so at most one row per id leaves it. Families that are still open after that have their blocks compared two by
two. So no link is lost, groups of copies are settled by one comparison per member, and what leaves a task grows with its
ids, not with their square.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_runs, mix64, trim

#: Ids, and bytes of their packed content, that are compared with one central id or with each other in one go.
BLOCK, BLOCK_BYTES = 4096, 4 << 20
#: Rows, and bytes of packed content, of a comparing task on average.
TASK_ROWS, TASK_BYTES = 8192, 16 << 20
#: Rows of a task that compares sketches on average.
SKETCH_ROWS = 20_000
#: Bytes of packed content that are unpacked at a time where rows are compared one by one.
SLICE_BYTES = 1 << 20
#: Edges that a task holds at a time where it makes stars of them.
EDGES = 1 << 18
#: Sketches have at least two cells a feature, 2^6 to 2^(LEVELS + 5) of them.
LEVELS = 16

Sets = Callable[[list[bytes]], list[np.ndarray]]


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a task, `EDGES` at a time, as one (smallest id, id) for each other id that they join."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        held += [] if batch is None else [batch]
        if not held or batch is not None and sum(x.num_rows for x in held) < EDGES:
            continue
        ids = np.concatenate([x.column(c).to_numpy() for c in "ab" for x in held])
        ids, place = np.unique(ids, return_inverse=True)
        label = join_labels(np.arange(len(ids)), *np.split(place, 2))
        held, others = [], np.flatnonzero(label != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[label[others]]), pa.array(ids[others])], ["a", "b"])


def _fewer(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, with the same components: distinct ones, those of a task as stars around smallest ids."""
    rows = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return rows.mapInArrow(_stars, "a long, b long")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, component) for every id of `edges` (a, b): component is the smallest id that it is connected with.

    Each task makes stars of its own edges, so that few edges are done in one round. Ids take their smallest neighbour's
    label, labels are followed two steps, and the edges are rewritten in labels and made distinct, until none joins two
    labels. Each round's tables are written to the shared folder.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    rest = scratch.cut(_fewer(edges), "edges")
    labels = scratch.cut(rest.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")), "labels")
    while not rest.isEmpty():
        parent = rest.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
        again = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
        parent = scratch.cut(parent.join(again, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "parents")
        renamed = labels.join(parent.withColumnRenamed("node", "component"), "component", "left").select("id", F.coalesce("up", "component").alias("component"))
        renamed = scratch.cut(renamed, "labels")
        a, b = (parent.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")) for c in "ab")
        moved = rest.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("up_a", "a").alias("a"), F.coalesce("up_b", "b").alias("b"))
        moved = scratch.cut(_fewer(moved), "edges")
        scratch.drop(rest, labels, parent)
        rest, labels = moved, renamed
    scratch.drop(rest)
    return labels


def sketch(features: np.ndarray) -> bytes:
    """For each cell of the hashed feature domain whether it holds an odd number of features, one bit a cell.

    Two sketches differ in no more bits than their sets in features. A sketch of half the cells is the two halves of the
    larger one combined by exclusive or, so two sketches meet at the coarser size.
    """
    many = 1 << min(max((2 * len(features) - 1).bit_length(), 6), LEVELS + 5)
    odd = np.bincount((mix64(features) & np.uint64(many - 1)).astype(np.int64), minlength=many) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Sketches:
    """Sketches of many rows, folded to each number of cells for the rows that have as many."""

    def __init__(self, rows: list[bytes]):
        self.level = np.array([len(r).bit_length() - 4 for r in rows])
        self.tables, self.places = [np.zeros((0, 1), np.uint64)] * LEVELS, [np.zeros(0, np.int64)] * LEVELS
        held, table = np.zeros(0, np.int64), np.zeros((0, 1 << LEVELS), np.uint64)
        for k in reversed(range(LEVELS)):
            own, half = np.flatnonzero(self.level == k), 1 << k
            mine = np.frombuffer(b"".join(rows[i] for i in own.tolist()), np.uint64).reshape(-1, half)
            table, held = np.concatenate([table[:, :half] ^ table[:, half:], mine]), np.concatenate([held, own])
            self.tables[k], self.places[k] = table, np.full(len(rows), -1)
            self.places[k][held] = np.arange(len(held))

    def near(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether the sketches of rows x and y differ in at most `most` bits, at the most cells that both have."""
        ok, level = np.zeros(len(x), bool), np.minimum(self.level[x], self.level[y])
        for k in np.unique(level).tolist():
            todo, (table, place) = np.flatnonzero(level == k), (self.tables[k], self.places[k])
            for at in range(0, len(todo), (1 << 20) >> k or 1):
                own = todo[at : at + ((1 << 20) >> k or 1)]
                ok[own] = np.bitwise_count(table[place[x[own]]] ^ table[place[y[own]]]).sum(axis=1, dtype=np.int64) <= most[own]
        return ok


def join_labels(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (each the smallest place it joins) after x and y are joined too."""
    while len(apart := np.flatnonzero(label[x] != label[y])):
        one, two = label[x[apart]], label[y[apart]]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(again := label[label], label):
            label = again
    return label


def _near(num: int, den: int):
    """Rows of groups (key, one, two), parted into what is joined by sketches that allow a Jaccard similarity of num/den.

    Out go (key, id) rows of the parts of two ids and more, the key made of the part's ids, so that equal parts are one.
    """

    def run(table: pa.Table) -> pa.Table:
        key, one, two, ids, n = (table[c].to_numpy() for c in ("key", "one", "two", "id", "n"))
        order = np.lexsort((n, two, one, key))
        key, one, two, ids, n = (x[order] for x in (key, one, two, ids, n))
        raw = table["sketch"].to_pylist()
        known = Sketches([raw[k] for k in order.tolist()])
        group = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        label, active, step = np.arange(len(ids)), np.arange(len(ids)), 0
        while len(active):  # sizes rise within a group, so a row is done at the first partner too large for it
            step += 1
            active = active[active + step < len(ids)]
            active = active[(group[active + step] == group[active]) & (num * n[active + step] <= den * n[active])]
            for at in range(0, len(active), 1 << 15):
                x = active[at : at + (1 << 15)]
                x = x[label[x] != label[x + step]]
                ok = known.near(x, x + step, (n[x] + n[x + step]) * (den - num) // (den + num))
                label = join_labels(label, x[ok], x[ok] + step)
        trim()
        order = np.argsort(label, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], label[order][1:] != label[order][:-1]]))
        sizes = np.diff(np.append(starts, len(order)))
        names = np.add.reduceat(mix64(ids[order].view(np.uint64) + np.uint64(1)), starts).view(np.int64)
        keep = np.repeat(sizes > 1, sizes)
        return pa.table({"key": pa.array(np.repeat(names, sizes)[keep], pa.int64()), "id": pa.array(ids[order][keep], pa.int64())})

    return run


def common(own: np.ndarray, of_own: np.ndarray, sets: list[np.ndarray], of: np.ndarray) -> np.ndarray:
    """How many elements of each set are in `own` under the set's group; of_own, of: groups of elements and of sets."""
    size = np.array([len(s) for s in sets])
    if not len(own) or not size.sum():
        return np.zeros(len(sets), np.int64)
    place = lambda features, groups: mix64(features ^ mix64(groups.astype(np.uint64) + np.uint64(1)))
    known, flat = np.sort(place(own, of_own)), place(np.concatenate(sets), np.repeat(of, size))
    hit = known[np.minimum(np.searchsorted(known, flat), len(known) - 1)] == flat
    return np.diff(np.concatenate([[0], np.cumsum(hit)])[np.concatenate([[0], np.cumsum(size)])])


def _edges(a: list, b: list) -> pa.Table:
    low, high = np.array(a, np.int64), np.array(b, np.int64)
    return pa.table({"a": pa.array(np.minimum(low, high)), "b": pa.array(np.maximum(low, high))})


def _star(sets_of: Sets, num: int, den: int):
    """Links (a, b) between central ids and the ids sent to them."""

    def run(table: pa.Table) -> pa.Table:
        pivot, salt, ids = (table[c].to_numpy() for c in ("pivot", "salt", "id"))
        order = np.lexsort((ids, ids != pivot, salt, pivot))
        group = np.cumsum(np.concatenate([[False], (pivot[order][1:] != pivot[order][:-1]) | (salt[order][1:] != salt[order][:-1])]))
        packed = table["packed"].combine_chunks()
        lengths = pc.binary_length(packed).to_numpy(zero_copy_only=False)[order]
        found, own, own_group = [np.zeros((2, 0), np.int64)], np.zeros(0, np.uint64), -1
        for start, stop in byte_runs(lengths, SLICE_BYTES):
            part, of = order[start:stop], group[start:stop]
            sets = sets_of(packed.take(pa.array(part)).to_pylist())
            size = np.array([len(s) for s in sets])
            center = np.flatnonzero(ids[part] == pivot[part])
            # the centers of this slice, and the one that the last slice ended with
            groups, centers = of[center], [sets[k] for k in center.tolist()]
            if of[0] == own_group and of[0] not in groups:
                groups, centers = np.concatenate([[own_group], groups]), [own, *centers]
            of_size = np.zeros(of[-1] - of[0] + 1, np.int64)
            of_size[groups - of[0]] = [len(c) for c in centers]
            both = common(np.concatenate([*centers, own[:0]]), np.repeat(groups, [len(c) for c in centers]), sets, of)
            linked_ = (den * both >= num * (size + of_size[of - of[0]] - both)) & (ids[part] != pivot[part]) & (both > 0)
            found.append(np.stack([pivot[part[linked_]], ids[part[linked_]]]))
            if len(groups) and groups[-1] == of[-1]:
                own, own_group = centers[-1], of[-1]
        trim()
        a, b = np.concatenate(found, axis=1)
        return _edges(a, b)

    return run


def forest(sets: list[np.ndarray], component: np.ndarray, block: np.ndarray | None, num: int, den: int) -> list[tuple[int, int]]:
    """Places of rows whose links join all components that links join: at most one link per row.

    block: only rows of different blocks are compared. Common features are counted through the rows that hold each.
    """
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        apart = component[0] != component[1] and (block is None or block[0] != block[1])
        return [(0, 1)] if apart and den * both >= num * (len(sets[0]) + len(sets[1]) - both) else []
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holders = np.bincount(codes)
    keep = holders[codes] > 1
    codes, owner = codes[keep], owner[keep]
    order = np.argsort(codes, kind="stable")
    rows, starts = owner[order], np.cumsum(np.where(holders > 1, holders, 0)) - holders
    begin = np.searchsorted(owner, np.arange(len(sets) + 1))
    component, left, out = component.copy(), len(np.unique(component)), []
    for x in range(len(sets) - 1):
        if left == 1:
            break
        own = codes[begin[x] : begin[x + 1]]
        many = holders[own]
        places = np.repeat(starts[own] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        both = np.bincount(rows[places], minlength=len(sets))
        near = (den * both >= num * (size[x] + size - both)) & (component != component[x])
        near[: x + 1] = False
        if block is not None:
            near &= block != block[x]
        for y in np.flatnonzero(near).tolist():
            if component[y] != component[x]:
                out.append((x, y))
                component[component == component[y]] = component[x]
                left -= 1
    return out


def _blocks(sets_of: Sets, num: int, den: int, across: bool):
    """Links (a, b) that join components within groups (key, one, two)."""

    def run(table: pa.Table) -> pa.Table:
        key, one, two, ids, component, block = (table[c].to_numpy() for c in ("key", "one", "two", "id", "component", "block"))
        order = np.lexsort((ids, two, one, key))
        packed = table["packed"].combine_chunks()
        key, one, two = key[order], one[order], two[order]
        bounds = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])])).tolist()
        a, b = [], []
        # groups are unpacked some at a time, a group always whole
        starts = np.array([*bounds, len(order)])
        lengths = np.add.reduceat(pc.binary_length(packed).to_numpy(zero_copy_only=False)[order], bounds)
        for first, last in byte_runs(lengths, SLICE_BYTES):
            part = order[starts[first] : starts[last]]
            sets = sets_of(packed.take(pa.array(part)).to_pylist())
            for g in range(first, last):
                at, end = starts[g] - starts[first], starts[g + 1] - starts[first]
                rows = part[at:end]
                if end - at > 1:
                    for x, y in forest(sets[at:end], component[rows], block[rows] if across else None, num, den):
                        a.append(ids[rows[x]])
                        b.append(ids[rows[y]])
        trim()
        return _edges(a, b)

    return run


def _dealt(rows: DataFrame, by: list[str], tasks: int) -> DataFrame:
    return rows.withColumn("task", F.pmod(F.xxhash64(*by), F.lit(tasks)).cast("int"))


def _compared(rows: DataFrame, by: list[str], content: DataFrame, run) -> DataFrame:
    """run over rows (id, ...) with their content, those of equal `by` in one task."""
    size = rows.join(content.select("id", "bytes"), "id").agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(16, math.ceil(size[0] / TASK_ROWS), math.ceil((size[1] or 0) / TASK_BYTES))
    dealt = _dealt(rows, by, tasks).join(content.select("id", "packed"), "id")
    return dealt.groupBy("task").applyInArrow(run, "a long, b long").distinct()


def _in_blocks(rows: DataFrame, across: bool | None) -> DataFrame:
    """Rows with (key, block, blocks) dealt to groups (key, one, two): across: a key's blocks by twos; not across: each
    block by itself; None: both."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if across is not False else F.col("block")
    rows = rows.withColumn("other", other)
    rows = rows.where("other <> block") if across else rows
    return rows.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("other", "blocks")


def with_near_sketch(scratch: Scratch, members: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (key, id), keys made anew, of the ids that their sketches leave together; known: (id, n, sketch) of every id."""
    sizes = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    blocked = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = scratch.cut(_in_blocks(blocked, None).drop("block"), "blocked")
    tasks = max(16, math.ceil(rows.count() / SKETCH_ROWS))
    seen = _dealt(rows, ["key", "one", "two"], tasks).join(known, "id").select("task", "key", "one", "two", "id", "n", "sketch")
    near = scratch.cut(seen.groupBy("task").applyInArrow(_near(num, den), "key long, id long").distinct(), "near")
    scratch.drop(rows)
    return near


def linked(scratch: Scratch, members: DataFrame, content: DataFrame, sets_of: Sets, num: int, den: int) -> DataFrame:
    """(id, component) of the ids that are linked, directly or through others.

    members: distinct (key, id) rows; content: (id, packed, bytes), one row for every id, bytes the length of packed;
    sets_of gives the sorted distinct features of packed contents. Ids link when the Jaccard similarity of their features
    is num/den or more and they share a key.
    """
    degree = members.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    central = members.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("back"))).alias("c"))
    pivots = scratch.cut(central.select("key", (-F.col("c.back")).alias("pivot")), "pivots")
    pairs = scratch.cut(members.join(pivots, "key").where("id <> pivot").select("pivot", "id").distinct(), "pairs")
    salts = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts"))
    sent = pairs.join(salts, "pivot").select("pivot", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), "id")
    centers = salts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("pivot").alias("id"))
    found = scratch.cut(_compared(sent.unionByName(centers), ["pivot", "salt"], content, _star(sets_of, num, den)), "links")
    labels = components(found, scratch)
    # the central id of a key is done there: it was compared with all others; keys in one component are done
    named = members.join(pivots.withColumnRenamed("pivot", "id"), ["key", "id"], "left_anti").join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    still = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("id").alias("first")).where("least < most")
    open_ = scratch.cut(named.join(still.select("key", "first"), "key").select("first", "id").distinct(), "open")
    scratch.drop(pairs, pivots)
    if open_.isEmpty():
        return labels
    # keys that share ids are one family: its ids are compared once, however many keys they share
    families = components(open_.select(F.col("first").alias("a"), F.col("id").alias("b")), scratch).select("id", F.col("component").alias("key"))
    families = scratch.cut(families.join(content.select("id", "bytes"), "id"), "families")
    for across in (False, True):
        named = families.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"), "bytes")
        size = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("many"), F.sum("bytes").alias("all_bytes"))
        blocks = F.greatest(F.ceil(F.col("many") / BLOCK), F.ceil(F.col("all_bytes") / BLOCK_BYTES)).cast("int")
        still = size.where("least < most").select("key", blocks.alias("blocks"))
        still = still.where("blocks > 1") if across else still
        blocked = named.join(still, "key").select("key", "id", "component", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
        rows = scratch.cut(_in_blocks(blocked, across), "blocked")
        if rows.isEmpty():
            break
        more = scratch.cut(_compared(rows, ["key", "one", "two"], content, _blocks(sets_of, num, den, across)), "links")
        scratch.drop(rows)
        if not more.isEmpty():
            found = found.unionByName(more)
            labels = components(found, scratch)
    return labels
