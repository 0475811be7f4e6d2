"""WARC archives: written one gzip member per record, read back sequentially with checks.

An archive is a row (archive, content) whose content is a complete ``.warc.gz`` file, so
Spark's own writers store it in any shared folder and a lost task is simply written again.

Defined cases: NULL html is an empty payload; NULL ids make records without an id number and
are never referred to; of equal payloads of at least 1000 bytes the one with the largest id
is the response and the others revisit it (of repeated rows with that id, each is a response);
NULL urls are written as an empty target; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etlvault.llm.common import read
from etlvault.session import scratch_path

REVISIT_FROM = 1000       # payload bytes from which equal payloads are stored once
ARCHIVE_BYTES = 16 << 20  # an archive is closed once it holds so many compressed bytes
CHUNK = 64 << 10          # bytes given to the decompressor at a time
LINE_END = b"\r\n"
# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """The bytes are no sequence of whole, matching records."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes = b""
    digest_ok: bool = field(default=True)


def gzip_member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    head = VERSION + LINE_END + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    raw = head + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + LINE_END * 2
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def members(content: bytes | Iterator[bytes]) -> Iterator[bytes]:
    """The decompressed gzip members, one after another, fed in small chunks."""
    chunks = (content[i:i + CHUNK] for i in range(0, len(content), CHUNK)) if isinstance(content, (bytes, memoryview)) else content
    engine, parts = None, []
    for chunk in chunks:
        while chunk:
            engine = engine or zlib.decompressobj(31)
            try:
                parts.append(engine.decompress(chunk))
            except zlib.error as e:
                raise WarcError(f"broken gzip member: {e}") from e
            chunk = b""
            if engine.eof:
                chunk = engine.unused_data
                yield b"".join(parts)
                engine, parts = None, []
    if engine is not None:
        raise WarcError("the archive ends inside a gzip member")


def parse(raw: bytes) -> Record:
    """One record: header lines, then as many bytes as its length says, then two line ends."""
    head, gap, rest = raw.partition(LINE_END * 2)
    lines = head.split(LINE_END)
    if not gap or not lines[0].startswith(b"WARC/"):
        raise WarcError("no record header")
    headers = {k.strip(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}
    try:
        length = int(headers["Content-Length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no content length") from e
    if rest[length:] != LINE_END * 2:
        raise WarcError("the block does not end where its length says")
    block = rest[:length]
    claimed = headers.get("WARC-Block-Digest")
    record = Record(headers, block, claimed is None or claimed == sha1_base32(block))
    if not record.digest_ok:
        raise WarcError(f"digest mismatch in {headers.get('WARC-Record-ID')}")
    return record


def read_records(content: bytes | Iterator[bytes]) -> Iterator[Record]:
    for raw in members(content):
        yield parse(raw)


def page_record(page_id, url: str, payload: bytes, refers_to) -> bytes:
    """A response record, or a revisit record that refers to another page's response."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if kind == "response" else b""
    headers = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE),
               ("WARC-Target-URI", " ".join((url or "").split())), ("Content-Type", "text/html; charset=utf-8"),
               ("WARC-Payload-Digest", sha1_base32(payload)), ("WARC-Block-Digest", sha1_base32(block)), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", IDENTICAL_PAYLOAD)]
    return gzip_member(headers, block)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def close():
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])

    for batch in batches:
        for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
            held.append(page_record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield close()
                held, size = [], 0
    if held:
        yield close()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(content): archives of all pages, with revisit records for equal payloads."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.withColumn("sha", F.unhex(F.sha2("payload", 256)))
    long_ones = F.length("payload") >= REVISIT_FROM
    winners = (keyed.where(long_ones).groupBy("sha").agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"))
               .where("n > 1 AND winner IS NOT NULL").drop("n"))
    refers_to = F.when(F.col("page_id").eqNullSafe(F.col("winner")), None).otherwise(F.col("winner"))
    return keyed.join(winners, "sha", "left").select("page_id", "url", "payload", refers_to.alias("refers_to")).mapInArrow(_write, "content binary")


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("url", pa.string())])
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for record in read_records(memoryview(content.as_buffer())):
                h = record.headers
                digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if h["WARC-Type"] == "response" and (len(record.block) != int(h["X-Payload-Length"]) or hashlib.sha1(record.block).hexdigest() != digest):
                    raise WarcError(f"payload mismatch in {h['WARC-Record-ID']}")
                rows.append((_number(h["WARC-Record-ID"]), int(h["X-Payload-Length"]), digest, h["WARC-Type"], _number(h.get("WARC-Refers-To")), h["WARC-Target-URI"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of archives given as (content), such as the ``binaryFile`` source reads them."""
    return archives.select("content").mapInArrow(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(read(spark, sf_dir, "pages")).write.option("parquet.block.size", 64 << 20).option("compression", "none").parquet(path)
    return read_archives(spark.read.parquet(path)).drop("url")


QUERIES = {"op10_warc": op10_warc}
ORACLE = {"op10_warc": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
g as (select b, max(page_id) as winner from p where octet_length(b) >= 1000 group by b having count(*) > 1)
select p.page_id, octet_length(p.b) as payload_bytes, sha1(p.b) as payload_digest,
  case when g.winner is null or g.winner = p.page_id then 'response' else 'revisit' end as record_type,
  case when g.winner <> p.page_id then g.winner end as refers_to
from p left join g on p.b = g.b"""}
