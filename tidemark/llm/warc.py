"""WARC archives with revisit resolution.

Only headers (page id, URL, payload digest) are shuffled by digest: they tell
each digest's original, the record with the smallest id. Every later record of
that digest becomes a revisit record that refers to it; it is written from its
header alone. Responses are written by the tasks that read them. Which rows
are responses they learn from a Bloom filter of the revisits, of bounded size,
and from the hashes of the responses that it takes for revisits, which the
headers tell exactly. The pages are read twice: for the headers and for the
records. Where more than KEY_BLOCK responses are taken for revisits, the rows
that two filters leave in doubt, and no others, move once to a join with the
exact keys, in a third read; there are never more than three.

Records are written with fresh headers by a data source of this module, each as
a gzip member of its own, so that it can be read alone; a file is closed once
it holds FILE_BYTES, and a record is never split. Tasks write below _open, and
the driver moves the files of the tasks that count when all are done, so
a lost or repeated task leaves no records behind. Archives are read with the
binary-file source; revisit records meet their originals in a join on the
record id.

Null payloads are empty ones; a null id is a page like others, and a response
only if no other page has its payload; equal rows of the smallest id are all
responses. No pages give a folder without archives. A payload is at most what
Spark holds in a value, 2 GB with its headers. Further columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tidemark.llm.common import BLOOM_BITS, bloom_of, map_rows, small
from tidemark.session import cut, shared_path

#: Payloads of fewer bytes are never made revisits.
MIN_PAYLOAD = 0
#: Compressed bytes after which a file is closed; keeps an archive small enough for one task.
FILE_BYTES = 64 << 20
#: Hashes of responses that the filter takes for revisits which tasks may hold (8 MB, as the filter itself).
KEY_BLOCK = 1 << 20
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 SHA-1 of the UTF-8 bytes: 5 bytes are 8 digits, four times."""
    hexed = F.sha1(text)
    digits = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def payloads(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, size, digest, h) per page; h is a hash of (page_id, digest). A null payload is empty."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload"), "digest": base32_sha1(F.col("payload"))})
    return rows.withColumn("h", F.xxhash64(F.col("page_id").isNull(), "page_id", "digest"))


def find_revisits(headers: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(page_id, url, digest, h, refers_to, refers_url) of the payloads' rows that revisit another; payloads do not move.

    Rows that share the smallest id of a digest are all responses; a null id
    is a response only if its digest has no other.
    """
    headers = headers.where(F.col("size") >= min_payload).select("page_id", "url", "digest", "h")
    # Partial aggregation leaves one row per digest and task, also for a digest of a third of all rows.
    originals = (
        headers.groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.min_by("url", "page_id").alias("refers_url"), F.count("*").alias("_n"))
        .where("_n > 1 AND refers_to IS NOT NULL")
        .select("digest", "refers_to", "refers_url")
    )
    return headers.join(originals, "digest").where(~F.col("refers_to").eqNullSafe(F.col("page_id")))


def responses(rows: DataFrame, revisits: DataFrame, bloom_bits: int = BLOOM_BITS, block: int = KEY_BLOCK, headers: DataFrame | None = None) -> DataFrame:
    """The payloads' rows that are no revisits, (page_id, url, payload, digest), each in the task that reads it.

    headers are the rows without payloads, if they are held somewhere. rows
    are read once if at most block responses look like revisits, else twice.
    """
    headers = rows if headers is None else headers
    seen = bloom_of(revisits.select("h"), bloom_bits)

    def rows_where(wanted):
        """Batches' rows whose hash, in the first column, is wanted."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(wanted(batch.column(0).to_numpy(zero_copy_only=False))))

        return run

    same = lambda a, b: F.col(f"{a}.page_id").eqNullSafe(F.col(f"{b}.page_id")) & (F.col(f"{a}.digest") == F.col(f"{b}.digest"))
    keys = map_rows(headers.select("h", "page_id", "digest"), rows_where(seen.has), "h long, page_id long, digest string").distinct()
    mistaken = cut(keys.alias("k").join(revisits.select("page_id", "digest").alias("v"), same("k", "v"), "left_anti"))
    columns, schema = ["h", "page_id", "url", "payload", "digest"], "h long, page_id long, url string, payload string, digest string"
    # A hash that a revisit shares with a mistaken response, though unlikely, leaves the decision to the keys.
    few = mistaken.count() <= block and mistaken.join(revisits.select("h"), "h", "left_semi").isEmpty()
    if few:
        known = np.sort(mistaken.select("h").toArrow()["h"].to_numpy())
        return map_rows(rows.select(columns), rows_where(lambda h: ~seen.has(h) | np.isin(h, known)), schema).drop("h")
    doubt = bloom_of(mistaken.select("h"), bloom_bits)
    sure = map_rows(rows.select(columns), rows_where(lambda h: ~seen.has(h)), schema)
    doubtful = map_rows(rows.select(columns), rows_where(lambda h: seen.has(h) & doubt.has(h)), schema)
    found = doubtful.alias("r").join(mistaken.select("page_id", "digest").alias("k"), same("r", "k"), "left_semi")
    return sure.unionByName(found).drop("h")


def record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))


def record(rows: DataFrame) -> DataFrame:
    """One WARC record (without the closing blank lines) as text per resolved row."""

    def field(name: str, value: Column) -> Column:
        """A header line, or nothing for null; line breaks in values become spaces."""
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\x00-\x1f\x7f]", " "), F.lit(CRLF))).otherwise(F.lit(""))

    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to"), F.col("digest")))),
        field("WARC-Refers-To-Target-URI", F.when(revisit, F.col("refers_url"))),
        field("WARC-Refers-To-Date", F.when(revisit, F.lit(DATE))),
        field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        field("WARC-Page-ID", F.col("page_id").cast("string")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit(CRLF), block).alias("value"))


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), urlparse(path).path if path.startswith("file:") else path
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """Names of the files that a task has finished."""

    names: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """Writes each row's text, and two blank lines, as a gzip member."""

    def __init__(self, path: str, file_bytes: int):
        self.path, self.file_bytes = path.rstrip("/"), file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = store(self.path)
        system.create_dir(f"{root}/_open", recursive=True)
        names: list[str] = []
        out = None
        for batch in small(iterator):
            for value in batch.column(0):
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{root}/_open/{names[-1]}", compression=None), 0
                member = zlib.compressobj(wbits=31)
                for piece in (member.compress(value.as_buffer()), member.compress(2 * CRLF.encode()), member.flush()):
                    out.write(piece)
                    size += len(piece)
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = store(self.path)
        system.create_dir(root, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{root}/_open/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Removes what is not committed, lost tasks' files included."""
        system, root = store(self.path)
        if system.get_file_info(f"{root}/_open").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_open")


class Archives(DataSource):
    """Sink of record texts; options: path, and fileBytes, the compressed bytes after which a file is closed."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_warc"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("fileBytes", FILE_BYTES)))


def write_archives(pages: DataFrame, path: str, min_payload: int = MIN_PAYLOAD, bloom_bits: int = BLOOM_BITS, block: int = KEY_BLOCK, file_bytes: int = FILE_BYTES, **columns: str) -> None:
    """Writes gzip-compressed archives of all pages below path. No pages give no records."""
    rows = payloads(pages, **columns)
    headers = cut(rows.drop("payload"))
    revisits = cut(find_revisits(headers, min_payload))
    first = responses(rows, revisits, bloom_bits, block, headers).withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long"), "refers_url": F.lit(None).cast("string")})
    later = revisits.drop("h").withColumns({"record_type": F.lit("revisit"), "payload": F.lit(None).cast("string")})
    pages.sparkSession.dataSource.register(Archives)
    record(first.unionByName(later)).write.format(Archives.name()).mode("append").option("fileBytes", file_bytes).save(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record of an archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
        yield headers, block


FIELDS = "page_id long, record_id string, record_type string, refers_record string, header_digest string, payload_bytes long, payload_digest string"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """FIELDS per record; payload_bytes and payload_digest are of what the archive holds, null for revisits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (f.split() for f in FIELDS.split(", "))])
        for batch in batches:
            for content in batch.column(0):
                out = []
                for h, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if h["warc-type"] == "response" else None
                    out.append(
                        {
                            "page_id": int(h["warc-page-id"]) if "warc-page-id" in h else None,
                            "record_id": h["warc-record-id"],
                            "record_type": h["warc-type"],
                            "refers_record": h.get("warc-refers-to"),
                            "header_digest": h["warc-payload-digest"].removeprefix("sha1:"),
                            "payload_bytes": None if payload is None else len(payload),
                            "payload_digest": None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                        }
                    )
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return map_rows(files, read, FIELDS)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) with revisits resolved to their originals."""
    records = read_records(spark, path)
    responses = records.where("record_type = 'response'")
    originals = responses.groupBy("record_id").agg(F.max("page_id").alias("o_id"), F.max("payload_bytes").alias("o_bytes"), F.max("payload_digest").alias("o_digest"))
    revisits = records.where("record_type = 'revisit'")
    # Originals that some revisit refers to, once each: a small table even if a third of the rows revisit one record.
    wanted = revisits.select(F.col("refers_record").alias("record_id")).distinct()
    originals = originals.join(wanted, "record_id", "left_semi")
    resolved = revisits.join(originals.withColumnRenamed("record_id", "refers_record"), "refers_record", "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(
        resolved.select("page_id", F.col("o_bytes").alias("payload_bytes"), F.col("o_digest").alias("payload_digest"), "record_type", F.col("o_id").alias("refers_to"))
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives in the shared folder and read back."""
    path = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read_pages(spark, path)


def copied_pages(pages: DataFrame) -> DataFrame:
    """All pages, half of them again under smaller ids, each third again under larger ones, each seventh again without text."""
    again = pages.where("page_id % 2 = 0").withColumn("page_id", -1 - F.col("page_id"))
    more = pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 10_000_000)
    bare = pages.where("page_id % 7 = 0").withColumns({"page_id": F.col("page_id") + 20_000_000, "html": F.lit(None).cast("string")})
    return pages.unionByName(again).unionByName(more).unionByName(bare)


def warc_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of pages most of which are captured several times, written and read back."""
    path = shared_path(spark, "warc")
    write_archives(copied_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")), path)
    return read_pages(spark, path)


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h FROM p),
b AS (
  SELECT page_id, payload_bytes, translate(
    lpad(upper(to_base(('0x' || substr(h, 1, 10))::BIGINT, 32)), 8, '0') || lpad(upper(to_base(('0x' || substr(h, 11, 10))::BIGINT, 32)), 8, '0') ||
    lpad(upper(to_base(('0x' || substr(h, 21, 10))::BIGINT, 32)), 8, '0') || lpad(upper(to_base(('0x' || substr(h, 31, 10))::BIGINT, 32)), 8, '0'),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM d),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM b)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM m
"""
#: SQL of warc_of_copies: op7's over copied_pages.
ORACLE_COPIES = ORACLE.replace(
    "FROM pages)",
    """FROM (SELECT page_id, html FROM pages UNION ALL SELECT -1 - page_id, html FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT page_id + 10000000, html FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id + 20000000, NULL FROM pages WHERE page_id % 7 = 0))""",
)
