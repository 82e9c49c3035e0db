"""Words of many texts at once, as Arrow arrays: runs of anything but space and \\t \\n \\v \\f \\r."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import mix64

#: A text of more bytes is split into words in slices of about so many, which end at white space.
SLICE_BYTES = 4 << 20


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words in order, and how many each text has; a null text has none. lower: A-Z only."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = pc.list_flatten(lists)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.not_equal(flat, "")  # runs of white space at either end leave an empty piece
    return flat.filter(real), np.bincount(owner[real.to_numpy(zero_copy_only=False)], minlength=len(texts))


def word_codes(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dense code of each word and the distinct words, exactly."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hash_strings(distinct: pa.Array) -> np.ndarray:
    # numpy's objects are made some ten times faster than a list by way of Arrow's scalars
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.uint64, len(distinct))


def window_hashes(codes: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the `size` words from each place; the last size - 1 places have none."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    each, out = hashes[codes], np.zeros(n, np.uint64)
    for j in range(size):
        out = mix64(out + each[j : j + n] + np.uint64(j + 1))
    return out


def slices(text: bytes, ends: bytes, limit: int) -> Iterator[bytes]:
    """A text in slices of at least `limit` bytes, parted at (and without) one byte that matches `ends`."""
    stop, at = re.compile(ends), 0
    while at <= len(text):
        found = stop.search(text, min(at + limit, len(text)))
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end + 1


def _long_set(text: bytes, size: int) -> np.ndarray:
    """shingle_sets of one very long text: word hashes slice by slice, then the shingles of them all."""
    each = [np.zeros(0, np.uint64)]
    for part in slices(text, rb"[\x20\x09-\x0D]", SLICE_BYTES):
        codes, distinct = word_codes(split_words(pa.array([part], pa.binary()).cast(pa.string()), lower=True)[0])
        each.append(hash_strings(distinct)[codes])
    return _set(np.concatenate(each), size)


def _set(each: np.ndarray, size: int) -> np.ndarray:
    n = len(each)
    if n >= size:
        return np.unique(window_hashes(np.arange(n), each, size))
    return window_hashes(np.arange(n), each, n) ^ np.uint64(n) if n else np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its `size`-word shingles (A-Z lower-cased).

    A text with fewer words has the whole sequence as its one shingle; one without words has none.
    """
    if len(texts) == 1 and texts[0].is_valid and len(raw := texts.cast(pa.binary())[0].as_py()) > SLICE_BYTES:
        return [_long_set(raw, size)]
    words, counts = split_words(texts, lower=True)
    codes, distinct = word_codes(words)
    hashes = hash_strings(distinct)
    begin, many = np.cumsum(counts) - counts, np.maximum(counts - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), many)
    rolled = window_hashes(codes, hashes, size)[np.arange(len(owner)) + np.repeat(begin - (np.cumsum(many) - many), many)]
    order = np.argsort(rolled)
    # owners of 16 bits are sorted in one pass
    order = order[np.argsort(owner[order].astype(np.uint16 if len(counts) <= 1 << 16 else np.int64), kind="stable")]
    rolled, owner = rolled[order], owner[order]
    fresh = np.concatenate([[True], (rolled[1:] != rolled[:-1]) | (owner[1:] != owner[:-1])])[: len(order)]
    rolled, ends = rolled[fresh], np.cumsum(np.bincount(owner[fresh], minlength=len(counts))).tolist()
    out = [rolled[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    for k in np.flatnonzero(counts < size).tolist():
        out[k] = _set(hashes[codes[begin[k] : begin[k] + counts[k]]], size)
    return out
