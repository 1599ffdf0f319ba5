"""WARC archives as chunked record tables.

A payload becomes rows of record id, chunk number and at most ``CHUNK`` bytes, in order, each with the
digest of the payload so far. One row is one WARC record: the first chunk is the ``response`` record,
the others are ``continuation`` records of the same segmented record. Payloads are cut by Spark, so the Python writer
sees chunks alone, in batches that Spark bounds by rows and bytes, and the reader holds no more than a line; the input row itself is
held whole by the scan, as any row. Rows are written by Spark's text writer, whose line
separator is the end of a record; with gzip a file is read by one task from its start. The reader
follows the declared lengths, so payloads may hold anything, and checks every digest.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.llm.tables import table
from opinion_spark.staging import shared_dir, staged_lookup

CHUNK = 64 * 1024
#: Shorter payloads are always written out.
REVISIT_BYTES = 100
#: Bytes of rows that are handed on together.
BATCH_BYTES = 1 << 20

CRLF = b"\r\n"
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def planned(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``: what each page becomes.

    Of equal payloads of ``REVISIT_BYTES`` or more, rows of the smallest page id are responses and
    the others refer to them. Null payloads are empty. Rows without page id revisit a page that has
    one, or are responses if there is none.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    named = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        body.alias("payload"),
        F.sha2(body, 256).alias("digest"),
    )
    large = named.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = staged_lookup(firsts.where("n > 1 AND first IS NOT NULL").drop("n"))
    revisits = staged_lookup(
        large.join(firsts, "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("first")))
        .select(
            F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")
        )
        .distinct()
    )
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest"))
    return named.join(revisits, same, "left").drop("_page", "_digest")


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page}:{digest}')}>"


def _head(fields: list[tuple[str, object]], length: int) -> bytes:
    lines = ["WARC/1.1"] + [f"{name}: {value}" for name, value in fields if value is not None]
    return "\r\n".join([*lines, f"Content-Length: {length}", "", ""]).encode()


def _one_line(url: str | None) -> str | None:
    return url and "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


class Writer:
    """Makes the WARC record of each chunk; the chunks of a payload come in order, one after the other."""

    def __init__(self) -> None:
        self.so_far, self.http_bytes = hashlib.sha256(), 0

    def record(
        self,
        page: int | None,
        url: str | None,
        digest: str,
        refers_to: int | None,
        size: int,
        number: int,
        n_chunks: int,
        part: bytes,
    ) -> tuple[bytes, str]:
        """The record and the digest so far; ``size`` is that of the whole payload."""
        http = b""
        fields: list[tuple[str, object]] = []
        if number == 0:
            self.so_far = hashlib.sha256()
            http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
            fields = [
                ("WARC-Type", "response" if refers_to is None else "revisit"),
                ("WARC-Record-ID", record_id(page, digest)),
                ("WARC-Date", "1970-01-01T00:00:00Z"),
                ("WARC-Target-URI", _one_line(url)),
                ("WARC-Payload-Digest", f"sha256:{digest}"),
                ("Content-Type", "application/http; msgtype=response"),
                ("Page-ID", page),
            ]
            self.http_bytes = len(http)
        if refers_to is not None:
            fields += [
                ("WARC-Profile", PROFILE),
                ("WARC-Refers-To", record_id(refers_to, digest)),
                ("Refers-To-Page-ID", refers_to),
            ]
            return _head(fields, len(http)) + http, digest
        self.so_far.update(part)
        if n_chunks > 1:
            fields += [("WARC-Segment-Number", number + 1)]
            if number:
                fields += [
                    ("WARC-Type", "continuation"),
                    ("WARC-Record-ID", record_id(page, f"{digest}:{number}")),
                    ("WARC-Date", "1970-01-01T00:00:00Z"),
                    ("WARC-Segment-Origin-ID", record_id(page, digest)),
                ]
            if number == n_chunks - 1:
                fields += [("WARC-Segment-Total-Length", self.http_bytes + size)]
            fields += [("Digest-So-Far", f"sha256:{self.so_far.hexdigest()}")]
        return _head(fields, len(http) + len(part)) + http + part, self.so_far.hexdigest()


CHUNKS = "page_id bigint, chunk int, record binary, digest_so_far string"


def chunk_rows(plan: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(page_id, url, digest, refers_to, size, chunk, n_chunks, part)``: the payloads of ``planned`` pages
    in rows of at most ``chunk`` bytes, in order; a revisit has one row without payload."""
    size = F.octet_length("payload")
    n_chunks = F.when(F.col("refers_to").isNull(), F.greatest(F.ceil(size / chunk), F.lit(1))).otherwise(F.lit(1))
    known = plan.select("*", size.alias("size"), n_chunks.cast("int").alias("n_chunks"))
    rows = known.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    part = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk)))
    return rows.select("page_id", "url", "digest", "refers_to", "size", "chunk", "n_chunks", part.alias("part"))


def chunk_table(plan: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(page_id, chunk, record, digest_so_far)`` of ``planned`` pages, chunks of a page in order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer()
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for i in range(batch.num_rows):
                page, url, digest, refers, total, number, n_chunks, part = (c[i].as_py() for c in batch.columns)
                record, so_far = writer.record(page, url, digest, refers, total, number, n_chunks, part or b"")
                rows.append((page, number, record, so_far))
                size += len(record)
                if size >= BATCH_BYTES:
                    yield _batch(rows, CHUNKS)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, CHUNKS)

    return chunk_rows(plan, chunk).mapInArrow(write, CHUNKS)


_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), _KINDS[kind]) for (_, kind), c in zip(fields, columns, strict=True)],
        [name for name, _ in fields],
    )


def write_warc(chunks: DataFrame, path: str) -> None:
    """One WARC file per task. A record ends with its block and two line ends; the writer adds the last."""
    line = F.concat(F.col("record"), F.lit(CRLF)).cast("string")
    chunks.select(line.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


@dataclass
class _Open:
    """The record being read; nothing of its payload is kept but the digest."""

    head: dict[str, str] = field(default_factory=dict)
    left: int = 0
    in_http: bool = True
    http: dict[str, str] = field(default_factory=dict)
    digest: object = field(default_factory=hashlib.sha256)
    size: int = 0


class Reader:
    """Follows the lines of WARC files and gives a row for each complete response or revisit."""

    def __init__(self) -> None:
        self.state = "between"
        self.now = _Open()
        self.fields: dict[str, str] = {}

    def line(self, raw: bytes) -> Iterator[tuple]:
        """Takes one line without its line feed."""
        data = raw + b"\n"
        if self.state == "block":
            part, data = data[: self.now.left], data[self.now.left :]
            self._body(part)
            self.now.left -= len(part)
            if self.now.left:
                return
            self.state = "between"
            yield from self._segment_done()
        if self.state == "between":
            if data in (b"", CRLF):
                return
            if data != b"WARC/1.1\r\n":
                raise ValueError(f"not the start of a record: {data[:60]!r}")
            self.state, self.fields = "head", {}
        elif data != CRLF:
            name, _, value = data.decode().partition(":")
            self.fields[name] = value.strip()
        else:
            self._begin()
            if not self.now.left:
                self.state = "between"
                yield from self._segment_done()

    def _begin(self) -> None:
        self.state = "block"
        if self.fields["WARC-Type"] == "continuation":
            origin, number = self.now.head.get("WARC-Record-ID"), self.now.head["WARC-Segment-Number"]
            follows = int(self.fields["WARC-Segment-Number"]) == int(number) + 1
            if self.fields["WARC-Segment-Origin-ID"] != origin or not follows:
                raise ValueError("a continuation without the segment before it")
            self.now.head |= {
                k: v for k, v in self.fields.items() if k.startswith("WARC-Segment-") or k == "Digest-So-Far"
            }
        else:
            self.now = _Open(head=dict(self.fields))
        self.now.left = int(self.fields["Content-Length"])

    def _body(self, part: bytes) -> None:
        now = self.now
        if not now.in_http:
            now.digest.update(part)
            now.size += len(part)
        elif part == CRLF:
            now.in_http = False
        else:
            name, _, value = part.decode().partition(":")
            now.http[name] = value.strip()

    def _segment_done(self) -> Iterator[tuple]:
        now, head = self.now, self.now.head
        digest = now.digest.hexdigest()
        if "WARC-Segment-Number" in head:
            if head["Digest-So-Far"] != f"sha256:{digest}":
                raise ValueError(f"digest of {head['WARC-Record-ID']} fails at {now.size} bytes")
            if "WARC-Segment-Total-Length" not in head:
                return
        size = int(now.http["Content-Length"])
        declared = head["WARC-Payload-Digest"].removeprefix("sha256:")
        revisit = head["WARC-Type"] == "revisit"
        if not revisit and (digest != declared or size != now.size):
            raise ValueError(f"payload of {head['WARC-Record-ID']} is not what was declared")
        page, refers = head.get("Page-ID"), head.get("Refers-To-Page-ID")
        yield (
            page and int(page), head.get("WARC-Target-URI"), size, declared, head["WARC-Type"], refers and int(refers)
        )


RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit of the gzip WARC files below ``path``."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            rows = []
            for raw in batch.column(0):
                rows += reader.line(raw.as_py())
            if rows:
                yield _batch(rows, RECORDS)
        if reader.state != "between":
            raise ValueError("the archive ends inside a record")

    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(follow, RECORDS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(chunk_table(planned(table(spark, sf_dir, "pages"))), path)
    return read_warc(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def warc_sql(pages: str) -> str:
    """The query in SQL, from the pages themselves."""
    return f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM {pages}
), f AS (
  SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES}
    THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f"""
