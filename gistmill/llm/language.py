"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to `ORDER` bytes, frozen after counting. The code length of a byte is
that of coding it under the longest context there is, escaping to shorter ones (escape method C) and leaving out what
longer contexts hold, so that the 256 probabilities after any context add up to 1. The language that codes a text in
the fewest bits is predicted; the score is its posterior probability under equal priors.

Counts are over all learning texts. The tree keeps the contexts that a fixed share of its language's bytes supports, so
its size has a bound whatever the corpus; counts never grow with the depth, so what is kept is a tree.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, trim

ORDER = 4
#: Entries (context, byte) of one depth and language, and of the whole model, that the share of support allows at most.
ENTRIES, TOTAL = 1 << 16, 1 << 21
#: Before its first byte a text has this context: that of a line's begin.
EDGE = b"\n" * ORDER


def _pieces(texts: Iterable[bytes | None], limit: int = BATCH_BYTES) -> Iterator[tuple[list[int], bytes]]:
    """(rows, bytes) of about `limit` bytes: for each row ORDER bytes of context, then its text or a slice of it."""
    rows, parts, size = [], [], 0
    for row, text in enumerate(texts):
        text = text or b""
        for at in range(0, max(len(text), 1), limit):
            rows.append(row)
            parts += [EDGE if at == 0 else text[at - ORDER : at], text[at : at + limit]]
            size += ORDER + len(parts[-1])
            if size >= limit:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _codes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At each place the code of the byte there below the ORDER bytes before it; where rows begin; what is context only."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    begins = np.cumsum([0, *map(len, parts)])[:-1:2]
    code = data.astype(np.int64)
    for k in range(1, ORDER + 1):
        code[k:] += data[:-k].astype(np.int64) << (8 * k)
    context = (begins[:, None] + np.arange(ORDER)).ravel()
    return code, begins, context


def _add(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    index, distinct = pd.factorize(codes)
    return distinct, np.bincount(index, counts, len(distinct)).astype(np.int64)


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n) of a task's texts, added up here as far as memory goes."""
    held: dict[str, list] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (codes, n) in held.items():
            for at in range(0, len(codes), 1 << 16):
                part = codes[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(n[at : at + (1 << 16)])], ["lang", "code", "n"])
        held.clear()

    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        texts = batch.column("text").cast(pa.binary())
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            mine = texts.filter(pa.array(langs.indices.to_numpy(zero_copy_only=False) == i))
            for _, parts in _pieces(x.as_py() for x in mine):
                code, _, context = _codes(parts)
                got = _add(np.delete(code, context))
                if lang in held:
                    got = _add(np.concatenate([held[lang][0], got[0]]), np.concatenate([held[lang][1], got[1]]))
                held[lang] = got
        if sum(len(c) for c, _ in held.values()) > 1 << 20:
            yield from flush()
    yield from flush()
    trim()


def learning_rows(docs: DataFrame, fold: int = 2, of: int = 4) -> DataFrame:
    """(lang, text) of the documents to learn from: neither id, lang nor text null, crc32(id) mod `of` not `fold`."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return rows.where(F.crc32(F.col("doc_id").cast("string")) % of != fold).select("lang", "text")


def contexts(rows: DataFrame, entries: int = ENTRIES, total: int = TOTAL) -> DataFrame:
    """(lang, depth, code, n): how often a byte comes after `depth` bytes, where enough of the language's bytes support it.

    At each depth at most `entries` of a language are kept, fewer if there are so many languages that all of them would
    be more than `total`: an entry stays if its count is at least that share of its language's bytes.
    """
    counted = rows.mapInArrow(_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    whole = counted.groupBy("lang").agg(F.sum("n").alias("bytes"))
    langs = max(1, whole.count())
    share = max(1, min(entries, total // (langs * (ORDER + 1))))
    depths = F.explode(F.array(*(F.struct(F.lit(k).alias("depth"), F.col("code").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("code")) for k in range(ORDER + 1))))
    every = counted.select("lang", "n", depths.alias("d")).groupBy("lang", "d.depth", "d.code").agg(F.sum("n").alias("n"))
    return every.join(whole, "lang").where(F.col("n") * share >= F.col("bytes")).select("lang", "depth", "code", "n")


class Tree:
    """Context tree of one language: at each depth its entries and the totals of its contexts, in arrays by code."""

    def __init__(self, depth: np.ndarray, code: np.ndarray, n: np.ndarray):
        self.entries, self.nodes = [], []
        for k in range(ORDER + 1):
            at = np.flatnonzero(depth == k)
            at = at[np.argsort(code[at])]
            keys, count = code[at], n[at].astype(float)
            context, begin, seen = np.unique(keys >> 8, return_index=True, return_counts=True)
            total = np.add.reduceat(count, begin) if len(at) else np.zeros(0)
            rest, fresh = np.zeros(len(context)), np.zeros(len(context))
            if k:  # what the next shorter context holds beside the bytes that this one holds
                above_keys, above_log = self.entries[k - 1]
                covered = np.add.reduceat(2.0 ** above_log[np.searchsorted(above_keys, keys & ((1 << 8 * k) - 1))], begin) if len(at) else np.zeros(0)
                contexts_, totals, seens = self.nodes[k - 1][:3]
                shorter = np.searchsorted(contexts_, context & ((1 << 8 * (k - 1)) - 1))
                rest, fresh = np.round(totals[shorter] - covered), seens[shorter] - seen
            self.entries.append((keys, np.log2(count)))
            self.nodes.append((context, total, seen.astype(float), rest, fresh))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each code after the ORDER bytes before it."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        total, seen = np.full(len(codes), -1.0), np.zeros(len(codes))  # -1: no longer context was there
        for k in range(ORDER, -1, -1):
            keys, logs = self.entries[k]
            context, totals, seens, rest, fresh = self.nodes[k]
            if not len(keys):
                continue
            mine = codes[open_]
            node, there = _find(context, (mine >> 8) & ((1 << 8 * k) - 1))
            first = there & (total[open_] < 0)
            total[open_[first]], seen[open_[first]] = totals[node[first]], seens[node[first]]
            entry, hit = _find(keys, mine & ((1 << 8 * (k + 1)) - 1))
            n, u = total[open_], seen[open_]
            live = there & (u > 0)
            out[open_[live]] += np.log2(n[live] + u[live]) - np.where(hit[live], logs[entry[live]], np.log2(u[live]))
            # the next shorter context is met without the bytes of this one
            total[open_[there]], seen[open_[there]] = rest[node[there]], fresh[node[there]]
            open_ = open_[~hit]
        known = len(self.entries[0][0])
        out[open_] += np.log2(max(256 - known, 1))
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def learn(docs: DataFrame, entries: int = ENTRIES, total: int = TOTAL) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries of each language, ready for `Tree`: at most about `total` in all, the only thing that the driver gets."""
    got = contexts(learning_rows(docs), entries, total).toArrow()
    lang, columns = got.column("lang").to_numpy(), [got.column(c).to_numpy() for c in ("depth", "code", "n")]
    return {x: tuple(c[lang == x] for c in columns) for x in sorted(set(lang))}


def _scored(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, trees = list(shared.value), [Tree(*x) for x in shared.value.values()]
        for batch in batches:
            bits = np.zeros((len(trees), batch.num_rows))
            for rows, parts in _pieces(x.as_py() for x in batch.column("text").cast(pa.binary())):
                code, begins, context = _codes(parts)
                index, distinct = pd.factorize(code)
                for tree, sums in zip(trees, bits, strict=True):
                    each = tree.bits(distinct)[index]
                    each[context] = 0
                    np.add.at(sums, rows, np.add.reduceat(each, begins))
            best = bits.argmin(axis=0)
            ahead = np.clip(bits - bits.min(axis=0), 0, 1000)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([langs[b] for b in best], pa.string()), pa.array(1 / (2.0**-ahead).sum(axis=0))], [*batch.schema.names, "lang_pred", "score"])
        trim()

    return run


def identify(docs: DataFrame, fold: int = 2, of: int = 4, entries: int = ENTRIES, total: int = TOTAL) -> DataFrame:
    """Per row doc_id, held_out, lang_pred and score. Learning and predicting use nothing but texts (and lang, to learn).

    A null text, and one without a letter, is `und` with score 0; so is every text where there is nothing to learn from.
    Rows without a doc_id are predicted, but neither learnt from nor held out. Repeated rows are rows like others, texts
    of any length are read whole in slices, an empty table gives none, and other columns are ignored. Of languages with
    equal code lengths the first in order is taken.
    """
    model = learn(docs, entries, total)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == fold, F.lit(False)).alias("held_out")
    if not model:
        return rows.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    known = rows.withColumn("letters", letters).withColumn("text", F.when(F.col("letters"), F.col("text")))
    scored = known.mapInArrow(_scored(shared), "doc_id long, text string, letters boolean, lang_pred string, score double")
    return scored.select("doc_id", held, F.when(F.col("letters"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"))
