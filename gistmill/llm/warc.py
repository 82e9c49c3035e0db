"""WARC archives: records written in segments with chunked transfer framing, read back and reassembled.

Archives are plain WARC 1.1 files, written through Spark's text writer (a record is one "line" whose last line feed is
the separator), so that the commit protocol covers them on any file system; a file holds a bounded number of bounded
segments. A page's payload is framed as chunks and cut into segments; the first is a response record, the others
continuation records of it. Reading parses whole files by Content-Length, groups continuation records by origin
identifier, orders them by segment number, verifies the total length, and decodes the chunks.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, cut, shared_dir

SEGMENT_BYTES, CHUNK_BYTES = 32 << 10, 8 << 10
#: Segments in a file; with SEGMENT_BYTES this bounds what a reading task holds.
FILE_RECORDS = 1000
#: Payloads of at least so many bytes are stored once, and further copies revisit them.
REVISIT_BYTES = 1000
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; ValueError if the framing is broken. Extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        if size < 0 or end + 2 + size + 2 > len(body) + (size == 0) * 2:
            raise ValueError("broken chunk")
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
        if body[at - 2 : at] != b"\r\n":
            raise ValueError("broken chunk")


def record(kind: str, block: bytes, **fields: str | int | None) -> bytes:
    """A WARC record without the line feed that ends it. Fields are named in lower case with _ for -; None is left out."""
    names = "".join(f"{'-'.join('WARC' if p == 'warc' else 'ID' if p == 'id' else 'URI' if p == 'uri' else p.title() for p in k.split('_'))}: {re.sub(r'[\r\n]', ' ', str(v))}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\n{names}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r"


def identifier(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def records_of(page_id: int | None, url: str | None, payload: bytes, digest: str, first_id: int | None, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page: a revisit of the response of `first_id`, or a response and its continuations."""
    own = identifier(page_id, digest)
    about = {"warc_target_uri": url, "warc_payload_digest": f"sha1:{digest}"}
    if first_id is not None and first_id != page_id:
        yield record("revisit", b"", warc_record_id=own, **about, warc_refers_to=identifier(first_id, digest), warc_profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return
    block = HEAD + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield record("response", block, warc_record_id=own, **about)
        return
    for k, part in enumerate(parts, 1):
        last = {"warc_segment_total_length": len(block)} if k == len(parts) else {}
        if k == 1:
            yield record("response", part, warc_record_id=own, **about, warc_segment_number=1)
        else:
            yield record("continuation", part, warc_record_id=f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}{k}')}>", warc_target_uri=url, warc_segment_origin_id=own, warc_segment_number=k, **last)


def _encode(segment: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "payload"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first_id")), strict=True)
            out = [r for row in rows for r in records_of(*row, segment)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return run


def write(pages: DataFrame, path: str | None = None, segment: int = SEGMENT_BYTES) -> str:
    """Write a record per row of `pages` (page_id, url, html) and return the folder.

    Of rows with one payload of at least 1000 bytes those with the largest page_id are responses (all, if that id is
    repeated) and the others revisit it; a null id is below all, and a null html an empty payload. Only copies' keys
    are grouped, so the payloads themselves are joined with a table that has a row per repeated payload.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    keys = plain.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = plain.join(keys.select("digest", "first_id"), "digest", "left").select("page_id", "url", "payload", "digest", "first_id")
    lines = joined.mapInArrow(_encode(segment), "record binary").select(F.col("record").cast("string"))
    lines.write.option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)
    return path


HEADER = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(lower-case header fields, block) of each record of an archive; ValueError where a record is cut short."""
    at = 0
    while at < len(data):
        head = HEADER.match(data, at)
        if not head:
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1].decode().split("\r\n"))}
        end = head.end() + int(fields["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut short")
        yield fields, data[head.end() : end]
        at = end + 4


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    for batch in batches:
        for data in batch.column("content"):
            whole = data.as_py()
            rows = [
                {"kind": f["warc-type"], "record_id": f["warc-record-id"], "uri": f.get("warc-target-uri"), "digest": f.get("warc-payload-digest"), "refers_to": f.get("warc-refers-to"), "origin": f.get("warc-segment-origin-id") or f["warc-record-id"], "segment": int(f.get("warc-segment-number", 0)), "total": int(t) if (t := f.get("warc-segment-total-length")) else None, "block": b}
                for f, b in parse(gzip.decompress(whole) if whole[:2] == b"\x1f\x8b" else whole)
            ]
            for i in range(0, len(rows), 100):
                yield pa.RecordBatch.from_pylist(rows[i : i + 100], schema=PARSED)


PARSED = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
PARSED_SQL = "kind string, record_id string, uri string, digest string, refers_to string, origin string, segment int, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives in a folder, one row each; a file is parsed whole by its records' lengths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_parse, PARSED_SQL)


def _payloads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payload of reassembled blocks, as often as the record came; ok tells whether lengths, numbers and digest hold."""
    for batch in by_bytes(batches, "block"):
        out = []
        for r in batch.to_pylist():
            ok, payload = r["whole"], b""
            try:
                head, _, body = (r["block"] or b"").partition(b"\r\n\r\n")
                payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            except ValueError:
                ok = False
            digest = hashlib.sha1(payload).hexdigest()
            ok = bool(ok and r["digest"] in (None, f"sha1:{digest}"))
            out += [{"record_id": r["record_id"], "uri": r["uri"], "payload": payload, "payload_bytes": len(payload), "payload_digest": digest, "ok": ok}] * r["times"]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("record_id", pa.string()), ("uri", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("ok", pa.bool_())]))


def reassemble(records: DataFrame) -> DataFrame:
    """record_id, uri, payload, payload_bytes, payload_digest, ok of each response record.

    Unsegmented records pass by the shuffle. Segments are grouped by origin, so a group is one record; of a record that
    was written several times the segments come several times each and the record as often. ok is false if numbers
    are missing, the length is not the total, the chunk framing is broken or the digest differs.
    """
    alone = records.where("kind = 'response' and segment = 0").select("record_id", "uri", "digest", "block", F.lit(True).alias("whole"), F.lit(1).alias("times"))
    parts = records.where("segment > 0").groupBy("origin").agg(
        F.max(F.when(F.col("kind") == "response", F.struct("uri", "digest"))).alias("about"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.max("segment").alias("last"),
    )
    times = F.greatest((F.size("parts") / F.col("last")).cast("int"), F.lit(1))
    picked = F.filter("parts", lambda x, i: i % times == 0)
    block = F.aggregate(picked, F.lit(b""), lambda a, x: F.concat(a, x["block"]))
    whole = (F.size("parts") == times * F.col("last")) & F.coalesce(F.octet_length(block) == F.col("total"), F.lit(False)) & F.forall(picked, lambda x: x["segment"].isNotNull())
    joined = parts.select(F.col("origin").alias("record_id"), F.col("about.uri").alias("uri"), F.col("about.digest").alias("digest"), block.alias("block"), whole.alias("whole"), times.alias("times"))
    return alone.unionByName(joined).mapInArrow(_payloads, "record_id string, uri string, payload binary, payload_bytes long, payload_digest string, ok boolean")


def page_of(record_id: str):
    return F.nullif(F.split_part(F.col(record_id), F.lit(":"), F.lit(3)), F.lit("")).cast("long")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of archives that `write` made: page_id, payload_bytes, payload_digest, record_type, refers_to, ok.

    A revisit has the length and digest of the payload that it refers to.
    """
    records = read_records(spark, path)
    made = cut(reassemble(records).drop("payload", "uri"), "payloads")
    again = cut(records.where("kind = 'revisit'").select("record_id", "refers_to", "digest"), "revisits")
    known = made.groupBy("record_id").agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"), F.min("ok").alias("ok"))
    found = again.join(known.withColumnRenamed("record_id", "refers_to"), "refers_to", "left")
    responses = made.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "ok")
    revisits = found.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), page_of("refers_to").alias("refers_to"), (F.coalesce("ok", F.lit(False)) & (F.concat(F.lit("sha1:"), "payload_digest") == F.col("digest"))).alias("ok"))
    return responses.unionByName(revisits)
