"""Which 64-bit keys occur under more than one id, for many keys per id.

Signatures, bands and anchors come by the hundred for every document, and nearly all occur once. Shuffled as rows they
would outweigh the text several times. Here a task packs about half a million (key, id) pairs, sorted by key and dealt to
buckets by key range, into one compressed blob per bucket, about six bytes a pair; a bucket's blobs are merged with
numpy and only the shared keys come back as rows. A key that many ids of one task share is not sent with all of them:
its ids are sent as a row of their own that any merging task hands on, and the key's bucket sees two of them, so no task
gathers a hot key. An id is one 64-bit integer, or such an integer with a 32-bit number below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, trim

#: Pairs that a task packs at a time, and pairs that a merging task holds on average.
PACK_PAIRS, MERGE_PAIRS = 1 << 19, 1 << 19
#: A key with more ids in one pack leaves as rows.
HOT_IDS = 64
#: Keys are compared by their upper 48 bits; what is found is verified by the callers.
KEY_BITS = 48

PACKED = [("bucket", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary()), ("subs", pa.binary()), ("hot", pa.binary()), ("key", pa.int64()), ("members", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int32()))]
PACKED_SQL = "bucket int, keys binary, ids binary, subs binary, hot binary, key long, members array<long>, numbers array<int>"


def _squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8").ravel()


def bucket_count(pairs: float) -> int:
    return max(16, int(pairs / MERGE_PAIRS) + 1)


def _sorted(keys: np.ndarray, ids: np.ndarray, subs: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct (key, id, number) rows in order, where each key starts and how many rows it has."""
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same])) if len(keys) else order
    order[tied] = order[tied][np.lexsort((subs[order[tied]], ids[order[tied]], keys[tied]))]  # most keys occur once
    ids, subs = ids[order], subs[order]
    fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]) | (subs[1:] != subs[:-1])])[: len(keys)]
    keys, ids, subs = keys[fresh], ids[fresh], subs[fresh]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys, ids, subs, starts, np.diff(np.append(starts, len(keys)))


class Packer:
    """Collects (key, id, number) rows of a task; add() and end() yield packed rows as dictionaries of columns."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.held = buckets, [], 0

    def add(self, keys: np.ndarray, ids: np.ndarray, numbers: np.ndarray | None = None) -> Iterator[dict[str, list]]:
        self.parts.append(((keys >> np.uint64(64 - KEY_BITS)).astype(np.int64), ids.astype(np.int64), np.zeros(len(keys), np.int64) if numbers is None else numbers.astype(np.int64)))
        self.held += len(keys)
        if self.held >= PACK_PAIRS:
            yield from self.end()

    def end(self) -> Iterator[dict[str, list]]:
        if not self.held:
            return
        keys, ids, subs, starts, sizes = _sorted(*(np.concatenate([p[i] for p in self.parts]) for i in range(3)))
        self.parts, self.held = [], 0
        nth = np.arange(len(keys)) - np.repeat(starts, sizes)
        hot = sizes > HOT_IDS
        rows: dict[str, list] = {name: [] for name, _ in PACKED}

        def row(**given) -> None:
            for name in rows:
                rows[name].append(given.get(name))

        for a, n in zip(starts[hot].tolist(), sizes[hot].tolist(), strict=True):
            row(bucket=int(ids[a]) % self.buckets, key=int(keys[a]), members=ids[a : a + n], numbers=subs[a : a + n])
        hot_keys = keys[starts[hot]]
        kept = (nth < 2) | ~np.repeat(hot, sizes)
        keys, ids, subs = keys[kept], ids[kept], subs[kept]
        bucket = (keys >> (KEY_BITS - 30)) * self.buckets >> 30
        bounds = np.searchsorted(bucket, np.arange(self.buckets + 1))
        hot_bucket = (hot_keys >> (KEY_BITS - 30)) * self.buckets >> 30
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            part = slice(bounds[b], bounds[b + 1])
            row(bucket=b, keys=_squeeze(np.diff(keys[part], prepend=0)), ids=_squeeze(ids[part]), subs=_squeeze(subs[part]), hot=hot_keys[hot_bucket == b].astype("<i8").tobytes())
        yield rows
        trim()


def batch_of(rows: dict[str, list]) -> list[pa.Array]:
    return [pa.array(rows[name], kind) for name, kind in PACKED]


def _merge(alike: bool, told: bool):
    def run(table: pa.Table) -> pa.Table:
        direct = table.filter(pc.is_valid(table["members"])).select(["key", "members", "numbers"])
        table = table.filter(pc.is_valid(table["keys"]))
        if not table.num_rows:
            return direct
        keys = np.concatenate([np.cumsum(_unsqueeze(x)) for x in table["keys"].to_pylist()])
        ids, subs = (np.concatenate([_unsqueeze(x) for x in table[c].to_pylist()]) for c in ("ids", "subs"))
        hot = np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in table["hot"].to_pylist()]))
        keys, ids, subs, starts, sizes = _sorted(keys, ids, subs)
        keep = np.repeat(sizes > 1, sizes)  # a key of one id is no key to be met
        keys, ids, subs, sizes = keys[keep], ids[keep], subs[keep], sizes[sizes > 1]
        starts = np.cumsum(sizes) - sizes
        names, keep = keys[starts], np.ones(len(starts), bool)
        if alike and len(starts):  # keys with the same ids tell the same: sets of ids are equal where two sums of scrambled ids are
            both = mix64(mix64(ids.astype(np.uint64) + np.uint64(1)) + subs.astype(np.uint64))
            sums = (np.add.reduceat(both, starts) >> np.uint64(16)).astype(np.int64)
            more = np.add.reduceat(mix64(both ^ np.uint64(0xD6E8FEB86659FD93)), starts)
            if told:
                sums = (sums & ~1) | (names >> (KEY_BITS - 1))
            plain = ~np.isin(names, hot)
            names = np.where(plain, -1 - sums, names)
            order = np.lexsort((more, names))
            again = np.concatenate([[False], (names[order][1:] == names[order][:-1]) & (more[order][1:] == more[order][:-1])])[: len(order)]
            keep[order[again & plain[order]]] = False
        chosen = np.repeat(keep, sizes)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[keep])]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[chosen], t)) for x, t in ((ids, pa.int64()), (subs, pa.int32()))]
        found = pa.table({"key": pa.array(names[keep], pa.int64()), "members": lists[0], "numbers": lists[1]})
        trim()
        return pa.concat_tables([found, direct.cast(found.schema)])

    return run


def told_apart(keys: np.ndarray, kind: int) -> np.ndarray:
    """64-bit keys with the upper bit set to a kind, 0 or 1; `is_kind` finds it again in what `shared` gives."""
    return (keys >> np.uint64(1)) | np.uint64(kind << 63)


def is_kind(key: Column, kind: int) -> Column:
    return F.when(key < 0, (-1 - key).bitwiseAND(F.lit(1))).otherwise(F.shiftright(key, KEY_BITS - 1)) == kind


def shared(packed: DataFrame, alike: bool = False, told: bool = False) -> DataFrame:
    """(key, members, numbers) rows for keys under more than one id; a key's ids are all members of its rows together.

    alike: keys with the same set of ids are given once a bucket, under one negative number in place of the key, so that
    a distinct over the rows leaves them once. told: of each kind of `told_apart` on its own. Members may come under one
    key several times, and sets of ids that fall on one number are members of it together.
    """
    return packed.where("bucket is not null").select(*(n for n, _ in PACKED)).groupBy("bucket").applyInArrow(_merge(alike, told), "key long, members array<long>, numbers array<int>")
