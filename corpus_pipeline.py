"""Corpus pipeline: quality filter, near-duplicate removal, secret masking, source mixing and packing of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. In
every stage null and empty texts are documents like others (no words, no shingles, no secrets, one token), rows repeated
with an id are judged alike and stay as many, an empty table gives an empty table, and extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gistmill.llm import classifier, mixing, packing, partenum, secrets
from gistmill.llm.common import Scratch, release, table
from gistmill.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents scored below 0.3 by a model fitted on the stage's own labelled documents."""
    model = classifier.train(docs, table(spark, sf_dir, "labels"))
    return classifier.score(docs, model).where("quality_score >= 0.3").select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group linked by five-word shingles at similarity 0.8."""
    release(spark)  # shuffle files of the stages before
    return partenum.deduplicate(docs, size=5, num=4, den=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; every document stays."""
    release(spark)  # shuffle files of the stages before
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target weights, in shuffled order."""
    release(spark)  # shuffle files of the stages before
    return mixing.replicate(docs).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the token pieces of all documents into sequences of at most 2048 tokens."""
    release(spark)  # shuffle files of the stages before
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: A trained classifier, tokenizers and a packing rule are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`, each result written to the shared folder in between."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars"))
    scratch, last = Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name.split()[0].lower())
        if last is not None:
            scratch.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
