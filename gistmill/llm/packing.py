"""Best-fit packing by the sum-of-squares rule.

Documents become pieces of at most `capacity` tokens; full pieces are sequences of their own, and the others are packed
so that each goes where the sum of squared counts of open bins per residual gap becomes smallest. Token ids never leave
the task that made them: what is shuffled is a few integers per piece. Pieces are dealt by a hash to buckets of about
`bucket_pieces`, each packed by itself, so the work spreads over any number of machines at a cost of about one partly
filled sequence per bucket.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, cut

CAPACITY = 2048
#: About so many pieces are packed together; the loss from packing apart is below one sequence in a thousand.
BUCKET_PIECES = 8192


#: A word of Latin-1 letters with ASCII marks behind it: its two pre-tokens are sure, so each part is looked up alone.
PLAIN = re.compile(r"([a-z\xdf-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor share its cores already
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """Letters that byte-level vocabularies write for the UTF-8 bytes of Latin-1 characters."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(shown)]
    name = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(other)}
    return {c: "".join(name[b] for b in chr(c).encode()) for c in range(128, 256)}


class WordEncoder:
    """Token ids of whole texts for lower-casing byte-level vocabularies that drop white space.

    Such tokenizers never join characters across white space, so each distinct word of a batch is encoded once.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.letters = _byte_letters()

    def _words(self, words: list[str]) -> list[list[int]]:
        model, letters, parts, out, odd = self.tokenizer.model, self.letters, {"": []}, [], []

        def part(x: str) -> list[int]:
            if (ids := parts.get(x)) is None:
                ids = parts[x] = [t.id for t in model.tokenize(x if x.isascii() else x.translate(letters))]
            return ids

        for k, w in enumerate(words):
            if m := PLAIN.fullmatch(w):
                out.append(part(m[1]) + part(m[2]))
            else:
                out.append([])
                odd.append(k)
        for k, e in zip(odd, self.tokenizer.encode_batch([words[k] for k in odd], add_special_tokens=False), strict=True):
            out[k] = e.ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order as uint32, number of ids per text)."""
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # lower-casing must not make a special token
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        coded = pc.list_flatten(lists).dictionary_encode()
        codes, ids = coded.indices.to_numpy(zero_copy_only=False), self._words(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, starts = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), np.cumsum(sizes) - sizes
        per_word = sizes[codes]
        ends = np.cumsum(per_word)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - (ends - per_word), per_word)
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        totals = np.concatenate([[0], ends])[bounds]
        return flat[places], np.diff(totals)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        for batch in by_bytes(batches, "text", 6 << 20):
            ids, counts = encoder.encode(batch.column("text"))
            docs, rows, at = batch.column("doc_id").to_pylist(), [], 0
            for doc, n in zip(docs, counts.tolist(), strict=True):
                own = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                for k, start in enumerate(range(0, n + 1, capacity)):
                    part = own[start : start + capacity]
                    rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A null text is an empty one: just the end id."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, longest first.

    With N(g) open bins of residual gap g, putting a length s into a bin of gap g changes the sum of squares by
    2 (N(g - s) - N(g)) + 2, or by 1 - 2 N(g) if it fills the bin; opening a bin changes it by 2 N(capacity - s) + 1.
    The smallest change wins, a tie goes to the smallest gap, and a new bin is opened only if no open bin has room.
    """
    counts = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        here = counts[s:]
        change = 2 * (counts[: capacity + 1 - s] - here) + 2
        change[0] = 1 - 2 * here[0]
        change = np.where(here > 0, change, np.iinfo(np.int64).max)
        gap = s + int(np.argmin(change))
        if counts[gap]:
            b = open_bins[gap].pop()
            counts[gap] -= 1
        else:
            b, gap = made, capacity
            made += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            counts[gap - s] += 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """Every piece of every document with its sequence and place there.

    Empty and null texts are a piece of one token; longer texts are cut, none is dropped; rows repeated in `docs` are
    packed as often as they come; other columns are left out; an empty table gives no rows. sequence_id numbers are
    unique, not consecutive; offsets within a sequence are gapless from 0.
    """
    pieces = cut(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    buckets = max(1, round(pieces.where(F.col("length") < capacity).count() / bucket_pieces))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        pdf = pdf.assign(sequence_id=bins * buckets + int(pdf["bucket"].iloc[0]), offset=offsets)
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    dealt = pieces.where(F.col("length") < capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    packed = dealt.groupBy("bucket").applyInPandas(run, schema)
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)
