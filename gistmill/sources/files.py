"""File scans: JSON lines, CSV sheets, and Markdown documents with a header of fields."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Stages of documents and their folders.
STAGES = {"raw": "01-素材库", "need": "02-需求池", "draft": "03-初稿", "final": "04-终稿", "archive": "05-归档", "template": "06-模板", "knowledge": "07-知识库", "index": "08-索引"}
DOCUMENT = "path string, filename string, title string, fields map<string,string>, body string, modified timestamp, length long"


def jsonl(spark: SparkSession, path: str, schema: str, key: str | None = "id") -> DataFrame:
    """JSON lines under a schema; a line that does not parse fails the read, and so does a key that is null or repeated."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if key:
        bad = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).limit(1).collect()
        if bad:
            raise ValueError(f"{path}: {key} {bad[0][0]!r} is missing or repeated")
    return rows


def csv_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet with a header, quoted line feeds, and possibly a byte order mark; all columns are strings."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.toDF(*(c.lstrip("﻿").strip('"') for c in rows.columns))


def _header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    def split(text: str) -> tuple[dict[str, str], str]:
        if not text.startswith("---"):
            return {}, text
        end = text.find("\n---", 3)
        if end < 0:
            return {}, text
        try:
            got = yaml.safe_load(text[3:end]) or {}
        except yaml.YAMLError:
            got = {}
        got = got if isinstance(got, dict) else {}
        return {str(k): ", ".join(map(str, v)) if isinstance(v, list) else str(v) for k, v in got.items() if v is not None}, text[end + 4 :].lstrip("\n")

    for pdf in batches:
        parts = [split(bytes(c).decode("utf-8", "replace")) for c in pdf["content"]]
        names = [p.rsplit("/", 1)[-1] for p in pdf["path"]]
        fields = [f for f, _ in parts]
        yield pd.DataFrame({"path": pdf["path"], "filename": names, "title": [f.get("标题") or f.get("title") or n.removesuffix(".md") for f, n in zip(fields, names, strict=True)], "fields": fields, "body": [b for _, b in parts], "modified": pdf["modificationTime"], "length": pdf["length"]})


def documents(spark: SparkSession, path: str, first: datetime | None = None, last: datetime | None = None) -> DataFrame:
    """Markdown files of a folder: header fields as a map (lists joined by commas), and the body.

    A header that does not parse gives no fields; without an end to the header the whole text is the body. first, last:
    only files modified between the two, others are not opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(path)
    if first is not None:
        files = files.where(F.col("modificationTime").between(F.lit(first), F.lit(last)))
    return files.mapInPandas(_header, DOCUMENT)


def settings(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, value) of the YAML files below a folder: a row for each leaf, its names joined by dots.

    Numbers, booleans and texts are written as text, lists as JSON, null as null. A file that does not parse, or holds no
    mapping, has one row with an empty name and its fault as value.
    """

    def leaves(node: object, name: str) -> Iterator[tuple[str, str | None]]:
        if isinstance(node, dict) and node:
            for k, v in node.items():
                yield from leaves(v, f"{name}.{k}" if name else str(k))
        else:
            yield name, None if node is None else json.dumps(node, ensure_ascii=False, default=str) if isinstance(node, list | dict | bool) else str(node)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            out = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    got = yaml.safe_load(bytes(content).decode("utf-8-sig"))
                    found = list(leaves(got, "")) if isinstance(got, dict) else [("", "no mapping")]
                except (yaml.YAMLError, UnicodeDecodeError) as e:
                    found = [("", str(e).split("\n")[0])]
                out += [(p, n, v) for n, v in found]
            yield pd.DataFrame(out, columns=["path", "name", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yml,yaml}").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, name string, value string")


def file_counts(spark: SparkSession, folders: dict[str, tuple[str, str]]) -> DataFrame:
    """(name, files): how many files below each named folder fit its pattern; only the listing is read, no contents."""
    counts = None
    for name, (path, pattern) in folders.items():
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path")
        one = found.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("files"))
        counts = one if counts is None else counts.unionByName(one)
    return counts if counts is not None else spark.createDataFrame([], "name string, files long")


def stage_folder(stage):
    """Folder of a stage column; the root for others."""
    return F.coalesce(F.create_map(*[x for k, v in STAGES.items() for x in (F.lit(k), F.lit(v))])[stage], F.lit(""))


def changed(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (path, modified, length) whose state (path, hash) is missing or differs, with hash."""
    hashed = files.withColumn("hash", F.md5(F.concat_ws(":", "path", F.col("modified").cast("string"), F.col("length").cast("string"))))
    return hashed.join(state.select("path", F.col("hash").alias("_known")), "path", "left").where(~F.col("hash").eqNullSafe(F.col("_known"))).drop("_known")
