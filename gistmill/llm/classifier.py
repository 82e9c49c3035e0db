"""Quality classifier: supervised subword embeddings.

Every word contributes learned vectors of itself, of its character n-grams, and of the pair it forms with the word
before, all hashed into one table; a document is the average of its vectors and a softmax layer gives the class. It is
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows. Averaging and the softmax's logit
are linear, so for scoring each table row is folded to one number and a batch costs one lookup per distinct word and
one per word pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, mix64
from .words import hash_strings, split_words, word_codes

BUCKETS = 1 << 17
DIMENSIONS = 12
#: At most about so many labelled documents are fitted on; more labels are thinned by a hash of their id.
SAMPLE = 3000
#: Words of one training document are averaged over all of it; its features are held as distinct hashes with counts.
EPOCHS, RATE, BATCH = 8, 0.6, 16
GRAMS = (2, 3)


def _word_features(words: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its character n-grams, all words in one array, and how many each word has.

    A word is marked where it begins and ends; n-grams that hold both a mark and letters differ from inner ones.
    """
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    points = np.frombuffer("".join(f"<{w}>" for w in words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    buckets, owners = [hashes], [np.arange(len(words))]
    for n in GRAMS:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        rolled = np.full(m, n, np.uint64)
        for j in range(n):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + points[j : j + m]
        inside = owner[:m] == owner[n - 1 :]
        buckets.append(mix64(rolled[inside]))
        owners.append(owner[:m][inside])
    own = np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return (np.concatenate(buckets)[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(own, minlength=len(words))


def _pair_features(codes: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bucket of each word with the one before, BUCKETS for a document's first; a repeated word has one bucket for all."""
    if not len(codes):
        return np.zeros(0, np.int64)
    each = hashes[codes]
    before = np.concatenate([each[:1], each[:-1]])
    pair = mix64(before * np.uint64(3) + mix64(each)) % np.uint64(BUCKETS)
    same = before == each
    pair = np.where(same, np.uint64(1), pair).astype(np.int64)
    pair[first] = BUCKETS
    return pair


def _starts(counts: np.ndarray) -> np.ndarray:
    starts = np.cumsum(counts) - counts
    return starts[counts > 0]


def features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text the distinct feature buckets and their share of all its features (which sums to 1)."""
    words, counts = split_words(texts)
    codes, distinct = word_codes(words)
    hashes = hash_strings(distinct)
    grams, sizes = _word_features(distinct, hashes)
    known = np.split(grams, np.cumsum(sizes)[:-1]) if len(sizes) else []
    pairs = _pair_features(codes, hashes, _starts(counts))
    out, at = [], 0
    for n in counts.tolist():
        own, times = np.unique(codes[at : at + n], return_counts=True)
        pair = pairs[at : at + n]
        ids = np.concatenate([*(known[c] for c in own), pair[pair < BUCKETS]]).astype(np.int64)
        weight = np.concatenate([*(np.full(len(known[c]), k, float) for c, k in zip(own, times, strict=True)), np.ones(int((pair < BUCKETS).sum()))])
        buckets, place = np.unique(ids, return_inverse=True)
        total = np.bincount(place, weight, minlength=len(buckets))
        out.append((buckets, total / max(total.sum(), 1)))
        at += n
    return out


@dataclass
class Model:
    table: np.ndarray  # BUCKETS x DIMENSIONS
    output: np.ndarray  # DIMENSIONS x 2
    bias: np.ndarray  # 2

    def folded(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the logit of class 1 over class 0, and the logit of a document without words."""
        return self.table @ (self.output[:, 1] - self.output[:, 0]), float(self.bias[1] - self.bias[0])


def fit(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Stochastic gradient descent on the softmax loss, in small batches, with a rate that falls to nothing."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)), np.zeros((DIMENSIONS, 2)), np.zeros(2))
    if not len(labels):
        return model
    model.output += rng.normal(0, 0.1, model.output.shape)
    steps, done = epochs * -(-len(labels) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            ids = np.concatenate([samples[r][0] for r in rows])
            weights = np.concatenate([samples[r][1] for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(samples[r][0]) for r in rows])
            hidden = np.zeros((len(rows), DIMENSIONS))
            vectors = model.table[ids] * weights[:, None]
            for d in range(DIMENSIONS):
                hidden[:, d] = np.bincount(owner, vectors[:, d], minlength=len(rows))
            logits = hidden @ model.output + model.bias
            logits -= logits.max(axis=1, keepdims=True)
            grad = np.exp(logits)
            grad /= grad.sum(axis=1, keepdims=True)
            grad[np.arange(len(rows)), labels[rows]] -= 1
            rate = RATE * (1 - done / steps)
            back = grad @ model.output.T
            model.output -= rate * hidden.T @ grad
            model.bias -= rate * grad.sum(axis=0) / len(rows)
            # the share of a feature in its document is small, so its vector moves at a rate scaled up to match
            np.subtract.at(model.table, ids, rate * 20 * weights[:, None] * back[owner])
            done += 1
    return model


class Scorer:
    """Scores of texts under a model whose table is folded to a number per bucket."""

    def __init__(self, folded: np.ndarray, bias: float):
        self.folded, self.bias = np.append(folded, 0.0), bias

    def score(self, texts: pa.Array) -> np.ndarray:
        words, counts = split_words(texts)
        codes, distinct = word_codes(words)
        hashes = hash_strings(distinct)
        grams, size = _word_features(distinct, hashes)
        value = np.bincount(np.repeat(np.arange(len(size)), size), self.folded[grams], minlength=len(size))
        pairs = _pair_features(codes, hashes, _starts(counts))
        owner = np.repeat(np.arange(len(counts)), counts)
        total = np.bincount(owner, value[codes] + self.folded[pairs], minlength=len(counts))
        n = np.bincount(owner, size[codes] + (pairs < BUCKETS), minlength=len(counts))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -500, 500)))


def thinning(share: float) -> tuple[int, int]:
    """How many of 2^20 values two parts of a hash may take so that about a share of all rows is left, down to 2^-40."""
    first = int(share * (1 << 20))
    return (first, 1 << 20) if first else (1, max(1, int(share * (1 << 40))))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, label) of at most about `sample` labelled documents that are not held out.

    Ids with crc32(id as text) mod 5 = 0 are held out. Null ids, labels other than 0 and 1, and ids with both labels
    are left out. The ids are thinned before the join, so only they are broadcast.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("most")).where("label = most")
    total = usable.count()
    if total > sample:
        h = F.xxhash64("doc_id", F.lit("sample"))
        low, high = (F.pmod(x, F.lit(1 << 20)) for x in (h, F.shiftrightunsigned(h, 20)))
        first, second = thinning(sample / total)
        usable = usable.where((low < first) & (high < second))
    return docs.select("doc_id", "text").join(F.broadcast(usable.select("doc_id", "label")), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "label")


def _features_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text", 1 << 20):
        got = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([a.astype("<i4").tobytes() for a, _ in got], pa.binary()), pa.array([b.astype("<f4").tobytes() for _, b in got], pa.binary()), batch.column("label")], ["doc_id", "ids", "weights", "label"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Features are made on the executors; the driver gets those of at most about `sample` documents and fits."""
    rows = training_rows(docs, labels.select("doc_id", F.col("quality").cast("int").alias("quality")), sample)
    rows = rows.select("doc_id", "text", "label").mapInArrow(_features_of, "doc_id long, ids binary, weights binary, label int")
    got = sorted(rows.collect(), key=lambda r: (r["doc_id"], bytes(r["ids"])))
    return fit([(np.frombuffer(r["ids"], "<i4").astype(np.int64), np.frombuffer(r["weights"], "<f4").astype(float)) for r in got], np.array([r["label"] for r in got], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, with `quality_score` added (an own column of that name is replaced).

    Null and empty texts get the score of a document without words.
    """
    folded, bias = model.folded()
    shared = docs.sparkSession.sparkContext.broadcast((folded.astype(np.float32).astype(float), bias))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in by_bytes(batches, "text", 2 << 20):
            scores = pa.array(scorer.score(pc.fill_null(batch.column("text"), "")), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, "quality_score"])

    plain = docs.drop("quality_score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", quality_score double"
    return plain.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Training never sees held-out rows; scores use the text alone."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels, sample))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
