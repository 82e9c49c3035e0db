"""Removal of byte strings that an earlier document has, by hash-compared suffix sorting.

Every string of `length` bytes is named by its anchor: the gram inside it with the smallest hash, so that equal strings
have equal anchors at equal offsets, and strings that follow each other mostly share one. Anchors that only one document
has settle their strings; they meet by packed key exchange. For the others the stretch of text whose strings share the
anchor is sent to the anchor's bucket, where suffixes are sorted: prefix polynomial hashes give the longest common
extension of two suffixes by binary search, so a comparison in the mergesort takes a logarithmic number of steps, and
suffixes found equal are verified byte by byte. Of equal strings all but those of the smallest doc_id are removed.

An anchor that more than `HOT_IDS` documents have is split: its strings are dealt one by one, by their own hash, so that
equal strings still meet and any number of tasks shares the anchor. Texts of more than `WORK_BYTES` are taken in slices
that overlap by one byte less than a string.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import keys
from .common import Scratch, by_bytes, mix64, pack_text, text_bytes, unpack

LENGTH, GRAM = 50, 20
#: Bytes of stretches that a task packs at a time, and that a sorting task holds on average.
PACK_BYTES, SORT_BYTES = 8 << 20, 8 << 20
#: Bytes of text or stretches that are hashed and sorted at a time; the arrays made of them take about a hundred times that.
WORK_BYTES = 1 << 19
#: Documents under an anchor from which its strings are dealt one by one; up to that an anchor's stretches fit in one piece of work.
HOT_IDS = 8192
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LETTERS = mix64(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers_of(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers modulo 2^64; tables of up to 2^21 are kept."""
    bits = max(n - 1, 1).bit_length()
    return (_powers if bits <= 21 else _powers.__wrapped__)(int(base), bits)[:n]


class HashedText:
    """A byte buffer with prefix polynomial hashes modulo 2^64 over scrambled bytes."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.powers = powers_of(BASE, len(raw) + 1)
        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTERS[raw] * self.powers[:-1], dtype=np.uint64)])

    def equal(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n bytes from x and from y have one hash: each side is shifted by the other's power."""
        return (self.prefix[x + n] - self.prefix[x]) * self.powers[y] == (self.prefix[y + n] - self.prefix[y]) * self.powers[x]

    def extension(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the longest common extension of the suffixes at x and y, up to limit, by binary search."""
        out = limit.astype(np.int64)
        rest = np.flatnonzero(~self.equal(x, y, out))
        x, y, low, high = x[rest], y[rest], np.zeros(len(rest), np.int64), out[rest] - 1
        while (low < high).any():
            middle = (low + high + 1) >> 1
            same = self.equal(x, y, middle)  # closed ones have middle = low, which is equal, so they stay
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        out[rest] = low
        return out

    def order(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the suffix at x is below that at y, and whether they are equal, comparing up to limit bytes."""
        n = self.extension(x, y, limit)
        level = n >= limit
        last = len(self.raw) - 1
        return ~level & (self.raw[np.minimum(x + n, last)] < self.raw[np.minimum(y + n, last)]), level

    def verified(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether the limit bytes from x and y are the same, byte by byte."""
        out = np.ones(len(x), bool)
        for a in range(0, len(x), 1 << 16):
            part = slice(a, a + (1 << 16))
            n = limit[part]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            differs = self.raw[np.repeat(x[part], n) + step] != self.raw[np.repeat(y[part], n) + step]
            out[part] = np.bincount(np.repeat(np.arange(len(n)), n), differs, minlength=len(n)) == 0
        return out


def suffix_sort(text: HashedText, at: np.ndarray, limit: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes within segments; (order, class of each place in that order).

    at, limit: where each suffix starts and how many of its bytes count, one limit within a segment; segment: numbers
    that rise along the input. Runs of 1, 2, 4, ... suffixes are merged by finding each suffix's rank in the
    neighbouring run, all runs at once. Classes number the distinct suffixes, verified byte by byte.
    """
    order = np.arange(len(at))
    if not len(at):
        return order, order
    starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    sizes = np.diff(np.append(starts, len(at)))
    start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    width = 1
    while width < sizes.max():
        active = np.flatnonzero(size > width)
        inside = active - start[active]
        pair = inside // (2 * width) * (2 * width)
        right = (inside - pair) >= width
        # where the other run begins and ends; a last run without a neighbour stays as it is
        other = start[active] + pair + np.where(right, 0, width)
        stop = np.minimum(start[active] + pair + np.where(right, width, 2 * width), start[active] + size[active])
        low, high = other.copy(), np.maximum(stop, other)
        mine = order[active]
        while len(still := np.flatnonzero(low < high)):
            middle = (low[still] + high[still]) >> 1
            me = mine[still]
            # equal suffixes keep their order: those of the left run come before those of the right
            below, level = text.order(at[order[middle]], at[me], limit[me])
            go = below | (level & right[still])
            low[still], high[still] = np.where(go, middle + 1, low[still]), np.where(go, high[still], middle)
        place = start[active] + pair + (inside - pair - np.where(right, width, 0)) + (low - other)
        order[place] = mine
        width *= 2
    first, second = order[:-1], order[1:]
    same = segment[first] == segment[second]
    same[same] = text.equal(at[first[same]], at[second[same]], limit[first[same]])
    real = same.copy()
    real[same] = text.verified(at[first[same]], at[second[same]], limit[first[same]])
    if (same & ~real).any():  # a hash collision: sort the segments that have one by their bytes
        for s in np.unique(segment[first[same & ~real]]):
            own = np.flatnonzero(segment[order] == s)
            by = sorted(order[own].tolist(), key=lambda i: text.raw[at[i] : at[i] + limit[i]].tobytes())
            order[own] = by
        first, second = order[:-1], order[1:]
        real = segment[first] == segment[second]
        real[real] = text.verified(at[first[real]], at[second[real]], limit[first[real]])
    return order, np.concatenate([[0], np.cumsum(~real)])


def anchors(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(owner, start, number of strings, anchor place, anchor hash) of each stretch of strings that share an anchor.

    raw: texts one after the other, ending at `ends`. The strings of a stretch start at start, start + 1, ...
    """
    n, wide = len(raw), length - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    if n < length:
        return none
    text = HashedText(raw)
    grams = mix64((text.prefix[gram:] - text.prefix[:-gram]) * powers_of(INVERSE, n - gram + 1))
    least, chosen, have = grams, np.arange(len(grams), dtype=np.int32), 1
    while have < wide:  # the first smallest of 1, 2, 4, ... neighbours, then of all in the window
        step = min(have, wide - have)
        later = least[step:] < least[:-step]
        least, chosen = np.where(later, least[step:], least[:-step]), np.where(later, chosen[step:], chosen[:-step])
        have += step
    begin = np.concatenate([[0], ends[:-1]])
    counts = np.maximum(ends - begin - length + 1, 0)
    owner = np.repeat(np.arange(len(ends)), counts)
    if not len(owner):
        return none
    start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)
    place = chosen[start]
    fresh = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
    # least hashes are small; scrambled again, they fall evenly into ranges
    return owner[fresh], start[fresh], np.diff(np.append(fresh, len(owner))), place[fresh], mix64(grams[place[fresh]] ^ BASE)


def _slices(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, text of each, place in it) of the texts; a long one slice by slice, so that every string is in one."""
    if len(texts) > 1 or len(texts[0]) <= 2 * WORK_BYTES:
        yield np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), np.arange(len(texts)), np.zeros(len(texts), np.int64)
        return
    for at in range(0, len(texts[0]) - length + 1, WORK_BYTES):
        own = np.frombuffer(texts[0], np.uint8, min(WORK_BYTES + length - 1, len(texts[0]) - at), at)
        yield own, np.array([len(own)]), np.zeros(1, np.int64), np.full(1, at)


def _keys(buckets: int, length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, names = keys.Packer(buckets), [n for n, _ in keys.PACKED]
        for part in by_bytes(batches, "text", WORK_BYTES):
            docs = part.column("doc_id").to_numpy()
            for raw, ends, which, _ in _slices([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()], length):
                owner, _, _, _, hashes = anchors(raw, ends, length)
                for rows in packer.add(hashes, docs[which[owner]]):
                    yield pa.RecordBatch.from_arrays(keys.batch_of(rows), names)
        for rows in packer.end():
            yield pa.RecordBatch.from_arrays(keys.batch_of(rows), names)

    return run


STRETCHES = [("bucket", pa.int32()), ("numbers", pa.binary()), ("content", pa.binary()), ("cuts", pa.binary())]
STRETCHES_SQL = "bucket int, numbers binary, content binary, cuts binary"


def _gather(raw: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    return raw[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _works(name: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """Places of stretches, in the order of their keys, about WORK_BYTES at a time; a key's stretches stay together."""
    order = np.argsort(name, kind="stable")
    ends, begins = np.cumsum(size[order]), np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
    at = 0
    while at < len(order):
        done = ends[at - 1] if at else 0
        stop = int(np.searchsorted(ends, done + WORK_BYTES, side="right"))
        k = int(np.searchsorted(begins, max(stop, at + 1), side="right")) - 1
        stop = int(begins[k]) if begins[k] > at and stop < len(order) else int(begins[k + 1]) if stop < len(order) and k + 1 < len(begins) else len(order)
        yield order[at:stop]
        at = stop


def _covered(raw: np.ndarray, at: np.ndarray, size: np.ndarray, name: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether a smaller document has a stretch equal to this one under its key: equal hashes, verified byte by byte."""
    later = np.zeros(len(at), bool)
    if not len(at):
        return later
    text = HashedText(raw)
    value = (text.prefix[at + size] - text.prefix[at]) * powers_of(INVERSE, len(raw) + 1)[at]
    order = np.lexsort((docs, value, size, name))
    first, second = order[:-1], order[1:]
    same = (name[first] == name[second]) & (size[first] == size[second]) & (value[first] == value[second])
    real = same.copy()
    real[same] = text.verified(at[first[same]], at[second[same]], size[first[same]])
    if (same & ~real).any():  # a hash collision: these are sorted as suffixes
        order = np.lexsort((docs, size, name))
        change = (name[order][1:] != name[order][:-1]) | (size[order][1:] != size[order][:-1])
        sorted_, classes = suffix_sort(text, at[order], size[order], np.concatenate([[0], np.cumsum(change)]))
        order = order[sorted_]
    else:
        classes = np.concatenate([[0], np.cumsum(~real)])
    starts = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    later[order] = docs[order] > np.minimum.reduceat(docs[order], starts)[classes]
    return later


class Stretches:
    """Collects stretches of a task and yields them dealt to buckets; of equal ones those of the smallest document go."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.held = buckets, [], 0

    def add(self, raw: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """columns: doc, tag, start in the document, anchor offset, size, key of each stretch; raw: their bytes."""
        self.parts.append((raw, columns))
        self.held += len(raw)
        if self.held >= PACK_BYTES:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        raw = np.concatenate([r for r, _ in self.parts])
        doc, tag, start, offset, size, name = (np.concatenate([c[i] for _, c in self.parts]) for i in range(6))
        self.parts, self.held = [], 0
        at = np.cumsum(size) - size
        later = np.zeros(len(at), bool)
        for own in _works(name, size):
            n = size[own]
            later[own] = _covered(_gather(raw, at[own], n), np.cumsum(n) - n, n, name[own], doc[own])
        bucket = (name >> (keys.KEY_BITS - 30)) * self.buckets >> 30
        chosen = np.flatnonzero(~later)
        chosen = chosen[np.argsort(bucket[chosen], kind="stable")]
        bounds = np.searchsorted(bucket[chosen], np.arange(self.buckets + 1))
        rows: list[tuple] = []
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = chosen[bounds[b] : bounds[b + 1]]
            numbers = keys._squeeze(np.concatenate([c[own] for c in (doc, tag, start, offset, size, name)]))
            rows.append((b, numbers, zstandard.ZstdCompressor(level=1).compress(_gather(raw, at[own], size[own]).tobytes()), None))
        gone = np.flatnonzero(later)
        # whole stretches that a smaller document of this task has are cut already; any sorting task hands them on
        if len(gone):
            rows.append((int(doc[gone[0]]) % self.buckets, None, None, keys._squeeze(np.concatenate([doc[gone], tag[gone], start[gone], start[gone] + size[gone]]))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), STRETCHES, strict=True)], [n for n, _ in STRETCHES])


def _stretches(buckets: int, length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Stretches(buckets)
        for part in by_bytes(batches, "packed", WORK_BYTES // 4):
            texts = [unpack(t) for t in part.column("packed").to_pylist()]
            docs = part.column("doc_id").to_numpy()
            tag = np.where(part.column("repeated").to_numpy(zero_copy_only=False), [zlib.crc32(t) + 1 for t in texts], 0).astype(np.int64)
            asked = []  # (text, key) pairs as one number: the text's place is small beside the key's 48 bits
            for lists in (part.column("keys"), part.column("hot")):
                own = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                asked.append((own << keys.KEY_BITS) + pc.list_flatten(lists).to_numpy(zero_copy_only=False))
            for raw, ends, which, base in _slices(texts, length):
                owner, start, many, place, hashes = anchors(raw, ends, length)
                name = (hashes >> np.uint64(64 - keys.KEY_BITS)).astype(np.int64)
                pair = (which[owner] << keys.KEY_BITS) + name
                hot = np.isin(pair, asked[1])
                shift = base - np.concatenate([[0], ends[:-1]])
                for split in (False, True):
                    own = np.flatnonzero(hot if split else np.isin(pair, asked[0]) & ~hot)
                    o, s, n, p, k = (x[own] for x in (owner, start, many, place, name))
                    if split and len(own):  # each string by itself, under its own hash
                        o, p = np.repeat(o, n), np.repeat(p, n)
                        s = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                        n = np.ones(len(s), np.int64)
                        text = HashedText(raw)
                        values = (text.prefix[s + length] - text.prefix[s]) * powers_of(INVERSE, len(raw) + 1)[s]
                        k = (mix64(values) >> np.uint64(64 - keys.KEY_BITS)).astype(np.int64)
                    size = n + length - 1
                    at = which[o]
                    yield from out.add(_gather(raw, s, size), docs[at], tag[at], s + shift[o], p - s, size, k)
        yield from out.end()

    return run


def _cuts(raw: np.ndarray, numbers: np.ndarray, length: int) -> list[np.ndarray]:
    """(doc, tag, start, end) columns of the byte spans to remove from stretches laid one after the other in raw."""
    doc, tag, start, offset, size, name = numbers
    at = np.cumsum(size) - size
    later = _covered(raw, at, size, name, doc)
    cuts = [np.stack([doc[later], tag[later], start[later], (start + size)[later]])]
    # strings of different stretches under one anchor: those at one offset from it may be equal
    order = np.lexsort((doc[~later], name[~later]))
    own = np.flatnonzero(~later)[order]
    group = np.concatenate([[0], np.cumsum(name[own][1:] != name[own][:-1])])
    several = np.bincount(group)[group] > 1
    own, group = own[several], group[several]
    if not len(own):
        return cuts
    many = size[own] - length + 1
    which = np.repeat(np.arange(len(own)), many)
    step = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
    behind = offset[own][which] - step
    by = np.lexsort((doc[own][which], behind, group[which]))
    pair = group[which][by] * (length + 1) + behind[by]
    segment = np.concatenate([[0], np.cumsum(pair[1:] != pair[:-1])])
    sorted_, classes = suffix_sort(HashedText(raw), (at[own][which] + step)[by], np.full(len(by), length, np.int64), segment)
    place = by[sorted_]
    docs = doc[own][which][place]
    least = np.minimum.reduceat(docs, np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]])))[classes]
    gone = np.zeros(len(which), bool)
    gone[place] = docs > least
    # neighbouring strings of a stretch that go are one cut
    edge = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | (which[1:] != which[:-1])]))
    last = np.flatnonzero(gone & np.concatenate([~gone[1:] | (which[1:] != which[:-1]), [True]]))
    e = own[which[edge]]
    return [*cuts, np.stack([doc[e], tag[e], start[e] + step[edge], start[e] + step[last] + length])]


def _sort(length: int):
    def run(table: pa.Table) -> pa.Table:
        cuts = [keys._unsqueeze(x).reshape(4, -1) for x in table["cuts"].drop_null().to_pylist()]
        table = table.filter(pc.is_valid(table["numbers"]))
        if table.num_rows:
            numbers = np.concatenate([keys._unsqueeze(x).reshape(6, -1) for x in table["numbers"].to_pylist()], axis=1)
            raw = np.frombuffer(b"".join(unpack(x) for x in table["content"].to_pylist()), np.uint8)
            at = np.cumsum(numbers[4]) - numbers[4]
            for own in _works(numbers[5], numbers[4]):
                cuts += _cuts(_gather(raw, at[own], numbers[4][own]), numbers[:, own], length)
        columns = np.concatenate([*cuts, np.zeros((4, 0), np.int64)], axis=1)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "tag", "start", "end"), columns, strict=True)})

    return run


def spans(scratch: Scratch, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, tag, start, end) byte spans to remove, overlapping ones included.

    tag is 0, or tells the texts of a repeated doc_id apart (crc32 + 1). Null ids take no part.
    """
    plain = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    total = text_bytes(plain)
    buckets = keys.bucket_count(total * 2 / (length - GRAM + 2))
    packed = plain.mapInArrow(_keys(buckets, length), keys.PACKED_SQL)
    met = scratch.cut(keys.shared(packed).select(F.explode("members").alias("doc_id"), "key"), "anchors")
    # a document may be told twice under a hot key, which makes the count no smaller
    hot = met.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > HOT_IDS).select("key", F.lit(True).alias("is_hot"))
    told = met.join(hot, "key", "left").groupBy("doc_id").agg(F.collect_set(F.expr("case when is_hot is null then key end")).alias("keys"), F.collect_set(F.expr("case when is_hot then key end")).alias("hot"))
    repeated = plain.groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("repeated"))
    wanted = told.join(repeated, "doc_id")
    texts = plain.mapInArrow(pack_text, "doc_id long, packed binary").join(wanted, "doc_id")
    parts = max(16, round(total * 1.5 / SORT_BYTES))
    return texts.mapInArrow(_stretches(parts, length), STRETCHES_SQL).groupBy("bucket").applyInArrow(_sort(length), "doc_id long, tag long, start long, end long")


def _union(spans_: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans_):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _removed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in by_bytes(batches, "packed", WORK_BYTES // 4):
        rows = []
        for doc, data, found in zip(part.column("doc_id").to_pylist(), part.column("packed").to_pylist(), part.column("spans").to_pylist(), strict=True):
            text = unpack(data)
            tag = zlib.crc32(text) + 1
            gone = _union([(s["start"], s["end"]) for s in found or () if s["tag"] in (0, tag)])
            kept, at = [], 0
            for a, b in gone:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            rows.append((doc, len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(b"".join(kept)).hexdigest()))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], names)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of `docs`.

    Removed is each byte covered by a `length`-byte string that also starts in a document of smaller doc_id, judged on
    the whole input. Null texts are empty; a row with a null id is kept whole and gives no strings; rows repeated with
    an id are not each other's copies; very long texts count whole; other columns are left out; an empty table gives no
    rows.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    found = scratch.cut(spans(scratch, docs, length), "spans").groupBy("doc_id").agg(F.collect_list(F.struct("tag", "start", "end")).alias("spans"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = plain.mapInArrow(pack_text, "doc_id long, packed binary").join(found, "doc_id", "left").select("doc_id", "packed", "spans")
    return texts.mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
