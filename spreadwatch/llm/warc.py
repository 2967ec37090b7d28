"""WARC archives as a chunked record table.

An archive is a table of (record_id, chunk_no, data, running_digest): concatenating the ``data``
of a record's chunks in order gives the bytes of one WARC record, and concatenating records gives
a WARC file. A payload of any size is cut into chunks of bounded size before it goes to Python;
digests are carried from chunk to chunk, so neither writing nor reading holds a whole record.
The table is written by Spark's own writer, so it lives in any store and survives lost tasks;
``export_files`` and ``import_files`` turn it into ordinary ``.warc`` files and back.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadwatch.llm.common import scratch, shared_dir

CRLF = "\r\n"
CHUNK_BYTES = 256 << 10
#: Payloads from this size on are stored once and revisited by the others.
REVISIT_BYTES = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE = "record_id string, chunk_no long, data binary, running_digest string"
READ = "record_id string, page_id long, url string, record_type string, refers_to long, stored_bytes long, declared_digest string, stored_digest string, intact boolean"


def records(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` as records: row (a number of its own), page_id, url, payload, payload_digest, payload_bytes, refers_to.

    Of equal payloads of at least ``min_bytes`` bytes the largest page_id keeps the payload;
    the others refer to it and carry none. A null page_id keeps its own payload.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    # the number is taken at the scan, so that a task that runs again gives its rows the same record ids
    rows = pages.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", payload.alias("payload")).withColumns(
        {"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")}
    )
    shared = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    shared = scratch(shared, "payloads")  # a plain table, so that Spark can split a join on one hot payload
    other = F.when(F.col("page_id") != F.col("first_page"), F.col("first_page"))
    return rows.join(shared, ["payload_digest", "payload_bytes"], "left").withColumn("refers_to", other).drop("first_page")


def _header(date: str):
    """The record's header bytes as a string column: WARC fields, then the HTTP head of the block."""
    url = F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\r\n]", "%0A")
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF * 2),
    )
    revisit = F.col("refers_to").isNotNull()
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), F.col("record_id"), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("WARC-Page-ID: "), F.col("page_id").cast("string"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To-Page-ID: "), F.col("refers_to").cast("string"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *fields), F.lit(CRLF * 2), http)


def _carry_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each chunk the SHA-1 of the record's payload up to its end; chunks come in order."""
    record, sha = None, None
    for batch in batches:
        running = []
        for rid, kind, data in zip(batch.column("record_id"), batch.column("kind"), batch.column("data"), strict=True):
            if (rid := rid.as_py()) != record:
                record, sha = rid, hashlib.sha1()
            if kind.as_py() == "payload":
                sha.update(data.as_buffer())
            running.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("record_id"), batch.column("chunk_no"), batch.column("data"), pa.array(running, pa.string())],
            ["record_id", "chunk_no", "data", "running_digest"],
        )


def archive(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """The archive table of ``pages`` (page_id, url, html), one record a row.

    Null html is an empty payload, a null url is about:blank, a null page_id has no page field and
    reads back as null; rows that repeat a page_id are records of their own. An empty table gives
    an empty archive; other columns are ignored.
    """
    name = F.md5(F.concat_ws(":", F.col("row").cast("string"), F.col("payload_digest")))
    record_id = F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    rows = records(pages).withColumn("record_id", record_id)
    n_chunks = F.when(F.col("refers_to").isNotNull(), 0).otherwise(F.ceil(F.col("payload_bytes") / chunk_bytes)).cast("long")
    # one row per chunk number; each takes its own piece, so that no array of pieces is ever built
    numbered = rows.withColumn("n_chunks", n_chunks).withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") + 1)))
    head, tail = F.col("chunk_no") == 0, F.col("chunk_no") > F.col("n_chunks")
    part = F.substring(F.col("payload"), ((F.col("chunk_no") - 1) * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    kind = F.when(head, "header").when(tail, "end").otherwise("payload")
    data = F.when(head, F.encode(_header(date), "UTF-8")).when(tail, F.encode(F.lit(CRLF * 2), "UTF-8")).otherwise(part)
    chunks = numbered.select("record_id", "chunk_no", kind.alias("kind"), data.alias("data"))
    return chunks.mapInArrow(_carry_digests, ARCHIVE)


def write_archive(pages: DataFrame, path: str, **options) -> None:
    """Write the archive table of ``pages`` to ``path``."""
    archive(pages, **options).write.parquet(path)


def _field(name: str, head: str) -> str | None:
    found = re.search(rf"(?im)^{name}:[ \t]*(.*?)\r?$", head)
    return found[1] if found else None


class _Reader:
    """Follows one record at a time through its chunks, keeping the header, a digest and a count."""

    def __init__(self) -> None:
        self.record, self.out = None, []

    def feed(self, record: str, chunk_no: int, data, running: str) -> None:
        if record != self.record:
            self.close()
            self.record, self.head, self.sha, self.n, self.expected, self.ok = record, bytes(data).decode(), hashlib.sha1(), 0, 1, chunk_no == 0
            fields, _, http = self.head.partition(CRLF * 2)
            self.fields, self.length = fields, int(_field("Content-Length", fields) or 0) - len(http.encode())
            return
        self.ok &= chunk_no == self.expected
        self.expected += 1
        if self.n < self.length:
            self.sha.update(data)
            self.n += len(data)
            self.ok &= self.sha.hexdigest() == running

    def close(self) -> None:
        if self.record is None:
            return
        number = lambda x: None if x is None else int(x)
        kind, digest = _field("WARC-Type", self.fields), (_field("WARC-Payload-Digest", self.fields) or "").removeprefix("sha1:")
        good = self.ok and self.n == self.length and (kind == "revisit" or self.sha.hexdigest() == digest)
        self.out.append({
            "record_id": self.record, "page_id": number(_field("WARC-Page-ID", self.fields)), "url": _field("WARC-Target-URI", self.fields),
            "record_type": kind, "refers_to": number(_field("WARC-Refers-To-Page-ID", self.fields)), "stored_bytes": self.n,
            "declared_digest": digest, "stored_digest": self.sha.hexdigest(), "intact": good,
        })
        self.record = None


_READ_ARROW = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("stored_bytes", pa.int64()), ("declared_digest", pa.string()), ("stored_digest", pa.string()), ("intact", pa.bool_()),
])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = _Reader()
    for batch in batches:
        for rid, no, data, run in zip(*(batch.column(c) for c in ("record_id", "chunk_no", "data", "running_digest")), strict=True):
            reader.feed(rid.as_py(), no.as_py(), data.as_buffer(), run.as_py())
        if reader.out:
            yield pa.RecordBatch.from_pylist(reader.out, _READ_ARROW)
            reader.out = []
    reader.close()
    if reader.out:
        yield pa.RecordBatch.from_pylist(reader.out, _READ_ARROW)


def read_records(chunks: DataFrame) -> DataFrame:
    """The records of an archive table, each checked against its digests (``intact``)."""
    ordered = chunks.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return ordered.mapInArrow(_read, READ)


def page_records(chunks: DataFrame) -> DataFrame:
    """Per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact.

    A revisit takes the size of the payload from the record that it refers to. Null page_ids and
    urls come back as they were written, rows that repeat a page_id are records of their own (all
    of them responses, if that page_id is the one that stays), an empty archive gives no rows.
    """
    found = read_records(chunks)
    sizes = found.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("stored_bytes").alias("there"), F.col("stored_digest").alias("declared_digest")).distinct()
    return found.join(sizes, ["refers_to", "declared_digest"], "left").select(
        "page_id",
        "url",
        F.when(F.col("record_type") == "revisit", F.col("there")).otherwise(F.col("stored_bytes")).alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("declared_digest")).otherwise(F.col("stored_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
        "intact",
    )


def export_files(chunks: DataFrame, folder: str) -> DataFrame:
    """Write ``part-N.warc`` files into a folder that all executors share; returns (path, n_bytes)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        path, n = f"{folder}/part-{task.partitionId():05d}.warc", 0
        with open(temp := f"{path}.{task.taskAttemptId()}", "wb") as out:
            for batch in batches:
                for data in batch.column("data"):
                    n += out.write(data.as_buffer())
        os.replace(temp, path)  # a repeated task replaces the file as a whole
        yield pa.RecordBatch.from_pylist([{"path": path, "n_bytes": n}])

    ordered = chunks.repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return ordered.mapInArrow(write, "path string, n_bytes long")


def _file_chunks(path: str, chunk_bytes: int) -> Iterator[dict]:
    """The archive rows of one WARC file, read record by record in pieces of bounded size."""
    with open(path, "rb") as file:
        while line := file.readline():
            if not line.startswith(b"WARC/"):
                continue
            head = line
            while (line := file.readline()) not in (b"\r\n", b""):
                head += line
            text = head.decode()
            left, rid = int(_field("Content-Length", text) or 0), (_field("WARC-Record-ID", text) or "")[10:-1]
            http = b""
            while left and not http.endswith(b"\r\n\r\n") and (line := file.readline(left)):
                http, left = http + line, left - len(line)
            sha, no = hashlib.sha1(), 0
            yield {"record_id": rid, "chunk_no": 0, "data": head + b"\r\n" + http, "running_digest": sha.hexdigest()}
            while left and (data := file.read(min(left, chunk_bytes))):
                sha.update(data)
                left, no = left - len(data), no + 1
                yield {"record_id": rid, "chunk_no": no, "data": data, "running_digest": sha.hexdigest()}
            yield {"record_id": rid, "chunk_no": no + 1, "data": file.read(4), "running_digest": sha.hexdigest()}


def import_files(spark: SparkSession, paths: list[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The archive table of WARC files in a shared folder, one task a file."""
    schema = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("running_digest", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0):
                rows, size = [], 0
                for row in _file_chunks(path.as_py(), chunk_bytes):
                    rows.append(row)
                    size += len(row["data"])
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(read, ARCHIVE)


def op10_warc_archive(spark, sf_dir):
    import uuid

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = f"{shared_dir(spark)}/scratch/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    damaged = F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("long")
    return page_records(spark.read.parquet(path)).select(
        F.when(F.col("intact"), F.col("page_id")).otherwise(damaged).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP10_SQL = """
WITH t AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first_page FROM t
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM r
"""
