"""One file a document: a writer with staged files, and a listing that reads only what changed."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import text as T
from .files import documents, stage_folder
from .sinks import markdown

FORMAT = "gistmill_documents"
#: Files that a commit moves at a time.
MOVERS = 16


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, by its scheme, and the path in it; without a scheme it is a local (or mounted) one."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
    return fs.LocalFileSystem(), path


@dataclass
class _Written(WriterCommitMessage):
    """What one task attempt has staged: its folder, and the names of its files there and in the end."""

    folder: str
    names: list[str] = field(default_factory=list)


class DocumentSource(DataSource):
    """Rows (folder, filename, text) as files folder/filename below a path that all executors see."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "folder string, filename string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _DocumentWriter(self.options["path"], overwrite)


class _DocumentWriter(DataSourceWriter):
    """Each attempt of a task writes into a staging folder of its own; the driver moves those of the attempts that count.

    So a task that dies, or runs twice, leaves nothing in the end. A file of the same name is overwritten; with overwrite
    all other documents go once the new ones are staged.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staging = path.rstrip("/"), overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> _Written:
        store, root = store_of(self.path)
        c = TaskContext.get()
        done = _Written(f"{self.staging}/{c.partitionId()}-{c.taskAttemptId()}")
        store.create_dir(f"{root}/{done.folder}")
        for n, r in enumerate(rows):
            with store.open_output_stream(f"{root}/{done.folder}/{n}") as out:
                out.write((r["text"] or "").encode())
            done.names.append(f"{r['folder']}/{r['filename']}" if r["folder"] else r["filename"])
        return done

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = store_of(self.path)
        moves = {name: f"{root}/{m.folder}/{n}" for m in messages if m for n, name in enumerate(m.names)}
        if self.overwrite:
            for found in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
                if found.type == fs.FileType.File and "/_staging-" not in found.path and found.path.removeprefix(f"{root}/") not in moves:
                    store.delete_file(found.path)
        for folder in {name.rpartition("/")[0] for name in moves}:
            store.create_dir(f"{root}/{folder}" if folder else root)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda kv: store.move(kv[1], f"{root}/{kv[0]}"), moves.items()))
        self._clear(store, root)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*store_of(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


def write_document_files(docs: DataFrame, path: str, mode: str = "append") -> None:
    """Documents (stage, title, fields: map, body) as Markdown files with a header, in their stage's folder.

    The name is the title's safe form; of documents of one name one stays. Null fields and bodies are empty. The driver
    holds the names of what is written, to move it; written documents are whole or not there.
    """
    docs.sparkSession.dataSource.register(DocumentSource)
    text = markdown(F.coalesce("fields", F.create_map().cast("map<string,string>")), F.coalesce("body", F.lit("")))
    rows = docs.select(stage_folder(F.col("stage")).alias("folder"), F.concat(T.safe_filename(F.coalesce("title", F.lit(""))), F.lit(".md")).alias("filename"), text.alias("text"))
    rows.dropDuplicates(["folder", "filename"]).write.format(FORMAT).mode(mode).save(path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, length) of the Markdown files below a folder; no contents are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


class CachedDocuments:
    """The documents of a folder, kept as Parquet, with the times and sizes of the files that they were read from.

    refresh() lists the folder and reads the files that are new or have another time or size, which the scan finds by
    their range of times; nothing changed, nothing is read. Within `ttl` seconds of the last look the folder is not even
    listed. Documents whose files are gone go.
    """

    def __init__(self, spark: SparkSession, path: str, cache: str, ttl: float = 0.0):
        self.spark, self.path, self.cache, self.ttl, self.looked = spark, path, cache, ttl, float("-inf")
        self.versions = 0

    def _kept(self) -> DataFrame | None:
        store, root = store_of(self.cache)
        found = [f.base_name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("version=") and store.get_file_info(f"{f.path}/_SUCCESS").type == fs.FileType.File]
        self.versions = max((int(n.split("=")[1]) for n in found), default=0)
        return self.spark.read.parquet(f"{self.cache}/version={self.versions}") if found else None

    def refresh(self) -> DataFrame:
        kept = self._kept()
        if kept is not None and time.monotonic() - self.looked < self.ttl:
            return kept
        self.looked = time.monotonic()
        now, marks = listing(self.spark, self.path), ["path", "modified", "length"]
        old = kept.select(*marks) if kept is not None else self.spark.createDataFrame([], "path string, modified timestamp, length long")
        fresh = now.join(old, marks, "left_anti")
        size = fresh.agg(F.count(F.lit(1)).alias("n"), F.min("modified").alias("first"), F.max("modified").alias("last")).first()
        gone = kept is not None and not old.join(now, marks, "left_anti").isEmpty()
        if kept is not None and not size["n"] and not gone:
            return kept
        read = documents(self.spark, self.path, size["first"], size["last"]) if size["n"] else None
        rows = None if read is None else read.join(fresh, marks, "left_semi").select("path", "filename", "title", "fields", "body", "modified", "length")
        still = None if kept is None else kept.join(now, marks, "left_semi")
        both = rows if still is None else still if rows is None else still.unionByName(rows)
        if both is None:
            return documents(self.spark, self.path)
        both.write.mode("overwrite").parquet(f"{self.cache}/version={self.versions + 1}")
        return self.spark.read.parquet(f"{self.cache}/version={self.versions + 1}")


def write_lines_in_order(rows: DataFrame, path: str, order: list[str], batch: int) -> None:
    """Rows as JSON lines with sorted names, in part files whose contents follow each other in the order.

    A batch is a folder of its own, so a run that goes on after a break appends batches and rewrites a broken one; the
    files of all batches by name are the whole in order. Rows are dealt by range, so no task sorts them all.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    dealt.select(line.alias("value")).write.mode("overwrite").text(f"{path}/batch={batch:08d}")


def finished_batches(path: str) -> list[int]:
    """Batches that were written whole."""
    store, root = store_of(path)
    found = [f for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.startswith("batch=")]
    return sorted(int(f.base_name.split("=")[1]) for f in found if store.get_file_info(f"{f.path}/_SUCCESS").type == fs.FileType.File)


def line_files(path: str) -> list[str]:
    """The part files of the finished batches, in the order in which they make one file of lines."""
    store, root = store_of(path)
    parts = []
    for b in finished_batches(path):
        found = store.get_file_info(fs.FileSelector(f"{root}/batch={b:08d}"))
        parts += sorted(f.path for f in found if f.base_name.startswith("part-"))
    return parts
