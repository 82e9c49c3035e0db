"""Exact set-similarity join on word n-grams by PartEnum signatures.

Sets with Jaccard similarity of at least a threshold differ in at most k elements, where k follows from their sizes.
Sets are banded by size so that one k serves a band and its lower neighbours. In a band the hashed feature domain is cut
into n1 groups of n2 parts; by the pigeonhole principle two sets that differ in k elements or fewer differ in at most
k2 elements in one group, so that they agree on all parts of some (n2 - k2)-subset of its parts. A signature is the
content of such a subset. A few groups more than needed are made, so that several of them must agree; then signatures
with next to no content, which unrelated sets share, can be left out by all but the few sets with many of them.

Signatures meet by packed key exchange, candidates are compared exactly on their whole sets, and links become components.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import keys
from .common import Scratch, by_bytes, mix64, packed_texts, text_bytes, unpack
from .linkage import linked, sketch, with_near_sketch
from .words import shingle_sets

#: Upper ends of size bands grow by this factor.
BAND = 1.5
#: Contents of fewer features are weak; groups beyond those needed, by which that many weak groups do no harm.
WEAK = 2


@dataclass(frozen=True)
class Plan:
    """How sets of up to `top` elements are signed: n1 groups of n2 parts, subsets leave k2 parts out."""

    top: int
    n1: int
    n2: int
    k2: int
    spare: int

    @property
    def subsets(self) -> np.ndarray:
        return np.array(list(combinations(range(self.n2), self.n2 - self.k2)))


@lru_cache(maxsize=None)
def bands(num: int, den: int, upto: int) -> tuple[int, ...]:
    out = [1]
    while out[-1] < upto:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return tuple(out)


@lru_cache(maxsize=4096)
def plan(band: int, num: int, den: int, top: int) -> Plan | None:
    """The plan of a band, None where only equal sets are similar enough."""
    k = 2 * top * (den - num) // (den + num)
    if k == 0:
        return None
    if k <= 2:
        return Plan(top, 1, k + 2, k, 0)
    spare = 1 + k // 12
    return Plan(top, -(-(k + 1) // 2) + spare, 3, 1, spare)


def signatures(features: np.ndarray, num: int, den: int) -> np.ndarray:
    """Distinct 64-bit signatures of a set of hashed features; sets at least num/den similar share one, unless equal."""
    n = len(features)
    if not n:
        return np.zeros(0, np.uint64)
    ends = bands(num, den, 1 << max(4, (n * den // num).bit_length() + 1))
    out = []
    for band in range(bisect_left(ends, n), bisect_left(ends, n * den // num) + 1):
        p = plan(band, num, den, ends[band])
        if p is None:
            continue
        scrambled = mix64(features ^ np.uint64(band * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        cell = ((scrambled >> np.uint64(33)) % np.uint64(p.n1 * p.n2)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        counts = np.bincount(cell, minlength=p.n1 * p.n2)
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scrambled[order] * np.uint64(0xD6E8FEB86659FD93), dtype=np.uint64)])
        ends_at = np.cumsum(counts)
        content = (running[ends_at] - running[ends_at - counts]).reshape(p.n1, p.n2)
        subsets = p.subsets
        many = counts.reshape(p.n1, p.n2)[:, subsets].sum(axis=2)
        salt = mix64(np.arange(p.n1 * len(subsets), dtype=np.uint64) + np.uint64(band << 40)).reshape(p.n1, len(subsets))
        made = mix64(mix64(content)[:, subsets].sum(axis=2, dtype=np.uint64) ^ salt)
        weak = many < WEAK
        if p.spare and weak.any(axis=1).sum() <= p.spare:
            made = made[~weak]
        out.append(made.ravel())
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


PROFILE = [("doc_id", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("sketch", pa.binary()), ("mark", pa.binary())]
PROFILE_SQL = "doc_id long, n long, low long, high long, sketch binary, mark binary"


def _profile(size: int, num: int, den: int, buckets: int):
    """Size, name and sketch of each document's set, its text's mark, and the set's signatures packed for their buckets."""
    names = [n for n, _ in PROFILE] + [f"s_{n}" for n, _ in keys.PACKED]
    kinds = dict(zip(names, (t for _, t in PROFILE + keys.PACKED), strict=True))

    def batch(rows: dict[str, list | pa.Array]) -> pa.RecordBatch:
        many = len(next(iter(rows.values())))
        return pa.RecordBatch.from_arrays([pa.array(rows[n], kinds[n]) if n in rows else pa.nulls(many, kinds[n]) for n in names], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = keys.Packer(buckets), {}
        for part in by_bytes(batches, "text"):
            rows: dict[str, list] = {n: [] for n, _ in PROFILE[:5]}
            signed, owners = [], []
            for doc, own in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text"), size), strict=True):
                name = xxhash.xxh3_128_intdigest(own.tobytes())
                for n, v in zip(rows, (doc, len(own), (name & (1 << 64) - 1) - (1 << 63), (name >> 64) - (1 << 63), sketch(own)), strict=True):
                    rows[n].append(v)
                if doc is not None and name not in seen and len(own):  # equal sets are one; a task signs the first
                    if len(seen) > 200_000:
                        seen.clear()
                    seen[name] = True
                    got = signatures(own, num, den)
                    signed.append(got)
                    owners.append(np.full(len(got), doc, np.int64))
            yield batch(rows | {"mark": _marks(part.column("text"))})
            if signed:
                for packed in packer.add(np.concatenate(signed), np.concatenate(owners)):
                    yield batch({f"s_{n}": v for n, v in packed.items()})
        for packed in packer.end():
            yield batch({f"s_{n}": v for n, v in packed.items()})

    return run


def _marks(texts: pa.Array) -> list[bytes]:
    """128 bits by which a text is told from others under its id."""
    return [xxhash.xxh3_128_digest(t or b"") for t in texts.cast(pa.binary()).to_pylist()]


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, packed) of documents."""
    for part in by_bytes(batches, "text"):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_marks(part.column("text")), pa.binary()), packed_texts(part.column("text"))], ["id", "mark", "packed"])


def _sets(size: int):
    return lambda packed: shingle_sets(pa.array([unpack(x).decode() for x in packed], pa.string()), size)


def join(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of `docs`.

    Documents link when den * |intersection| >= num * |union| of their sets of `size`-word shingles. component_id is the
    smallest doc_id reachable by links. Null, empty and blank texts have an empty set and link with nothing, and so do
    rows with a null doc_id (their component is null). Rows repeated with one id count as one document, under its
    largest set if their texts differ. Very long texts count whole. Other columns are left out; an empty table gives no
    rows.
    """
    scratch = Scratch(docs.sparkSession, "partenum")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # signatures of a set are about 2 (den - num) / (den + num) of its size, times 3 / 2 for subsets and 1.7 for bands
    pairs = text_bytes(plain) / 6 * 5.1 * (den - num) / (den + num)
    signed = ", ".join(f"s_{x.strip()}" for x in keys.PACKED_SQL.split(","))
    both = scratch.cut(plain.mapInArrow(_profile(size, num, den, keys.bucket_count(pairs)), f"{PROFILE_SQL}, {signed}"), "profile")
    texts = both.where("n is not null").select(*(n for n, _ in PROFILE))
    profile = scratch.cut(texts.select("doc_id", "n", "low", "high"), "sizes")
    groups = scratch.cut(keys.shared(both.select(*(F.col(f"s_{n}").alias(n) for n, _ in keys.PACKED)), alike=True).select("key", "members"), "groups")
    known = profile.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.max(F.struct("n", "low", "high")).alias("s")).select("doc_id", "s.*")
    classes = known.groupBy("n", "low", "high").agg(F.min("doc_id").alias("rep"))
    member = scratch.cut(known.join(classes, ["n", "low", "high"]), "members")
    # signatures name any document that has a set, be it the largest of its id or not; from here on the smallest id of the
    # set's class stands for it. An id with several sets stands for the classes of them all: what meets is compared.
    every = profile.where("doc_id is not null and n > 0").distinct().join(classes, ["n", "low", "high"]).select("doc_id", "rep").distinct()
    named = groups.select("key", F.explode("members").alias("doc_id")).join(every, "doc_id").select("key", F.col("rep").alias("id")).distinct()
    named = scratch.cut(named, "named")
    chosen = ["doc_id", "n", "low", "high"]
    stands = texts.where("n > 0").join(member.where("doc_id = rep").select(*chosen), chosen, "left_semi")
    reps = scratch.cut(stands.select(F.col("doc_id").alias("id"), "n", "sketch", "mark").dropDuplicates(["id"]), "reps")
    scratch.drop(both, groups)
    met = with_near_sketch(scratch, named, reps.select("id", "n", "sketch"), num, den)
    scratch.drop(named)
    # only texts that sketches leave together move, and none is written before
    wanted = reps.join(met.select("id").distinct(), "id", "left_semi").select("id", "mark")
    texts = plain.where("doc_id is not null").mapInArrow(_packed, "id long, mark binary, packed binary").join(wanted, ["id", "mark"], "left_semi")
    content = scratch.cut(texts.withColumn("bytes", F.octet_length("packed")).dropDuplicates(["id"]).select("id", "packed", "bytes"), "content")
    scratch.drop(reps)
    labels = linked(scratch, met, content, _sets(size), num, den)
    scratch.drop(content, met)
    found = member.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    return profile.join(found, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def deduplicate(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of `docs`, same columns, of the documents that stand for their component; null ids stay."""
    reps = join(docs, size, num, den).where("doc_id = component_id").select("doc_id").distinct()
    keep = docs.where("doc_id is not null").join(reps, "doc_id", "left_semi").select(*docs.columns)
    return keep.unionByName(docs.where("doc_id is null"))
