"""WARC archives: write a record per page, find revisits by payload digest, write deduplicated archives with fresh headers.

An archive is a gzip file of records; Spark's text sink writes it, so any file system that Spark can write will do, and a failed
task leaves nothing behind. Reading follows ``Content-Length``, so a payload may hold anything, record separators included.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved
from ..session import scratch_path

VERSION = b"WARC/1.1"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_id string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
    "refers_to long, refers_to_record string"
)


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(fields: list[tuple[str, object]]) -> bytes:
    lines = [VERSION] + [f"{name}: {value}".encode() for name, value in fields if value is not None]
    return b"\r\n".join(lines) + b"\r\n\r\n"


def _clean(url: str | None) -> str | None:
    """A header value holds no line breaks."""
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def _write(records: DataFrame, path: str, per_file: int) -> None:
    """``records`` has one binary column ``record`` without the final line breaks, which the sink adds."""
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", per_file)
        .text(path)
    )


def write_pages(pages: DataFrame, path: str, per_file: int = 20_000) -> None:
    """One ``response`` record per row of ``(page_id, url, html)``; a null html is an empty payload, a null url has no target."""

    def build(batches):
        for batch in batches:
            out = []
            for page_id, url, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                body = body or b""
                fields = [
                    ("WARC-Type", "response"),
                    ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                    ("WARC-Target-URI", _clean(url)),
                    ("X-Page-ID", page_id),
                    ("WARC-Payload-Digest", f"sha1:{digest_of(body)}"),
                    ("Content-Length", len(body)),
                ]
                out.append(_header(fields) + body)
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    rows = pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"), pages["html"].cast("string").cast("binary"))
    _write(rows.mapInArrow(build, "record binary"), path, per_file)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payloads of the records in a stream of bytes."""
    buffer = bytearray()

    def more() -> bool:
        for chunk in chunks:
            buffer.extend(chunk)
            return True
        return False

    while True:
        while (at := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if bytes(buffer).strip():
                    raise ValueError("archive ends inside a header")
                return
        head = bytes(buffer[:at]).decode("utf-8", "surrogateescape").split("\r\n")
        if head[0] != VERSION.decode():
            raise ValueError(f"not a record: {head[0][:40]!r}")
        headers = dict(line.split(": ", 1) for line in head[1:])
        length = int(headers["Content-Length"])
        stop = at + 4 + length
        while len(buffer) < stop + 4:
            if not more():
                raise ValueError("archive ends inside a payload")
        if buffer[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, bytes(buffer[at + 4 : stop])
        del buffer[: stop + 4]


def _inflate(data: memoryview, step: int = 1 << 18) -> Iterator[bytes]:
    """The content of all gzip members, piece by piece."""
    engine, at = zlib.decompressobj(31), 0
    while at < len(data):
        chunk = bytes(data[at : at + step])
        at += len(chunk)
        while chunk:
            if out := engine.decompress(chunk, 1 << 20):
                yield out
            chunk = engine.unconsumed_tail
            if engine.eof:
                chunk = engine.unused_data
                engine = zlib.decompressobj(31)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record, with the payload on request. The length of a revisit's payload is that of the record it refers to,
    and digests of stored payloads are computed again and compared."""

    def unpack(batches):
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for headers, body in parse(_inflate(memoryview(content.as_buffer()))):
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = headers["WARC-Type"]
                    if kind == "response" and digest_of(body) != digest:
                        raise ValueError(f"{headers['WARC-Record-ID']}: the payload does not have its digest")
                    number = headers.get("X-Page-ID")
                    refers = headers.get("X-Refers-To-Page-ID")
                    row = (
                        headers["WARC-Record-ID"].strip("<>"),
                        None if number is None else int(number),
                        headers.get("WARC-Target-URI"),
                        kind,
                        digest,
                        len(body) if kind == "response" else int(headers["X-Payload-Length"]),
                        None if refers is None else int(refers),
                        headers.get("WARC-Refers-To", "").strip("<>") or None,
                    )
                    rows.append((*row, body) if payloads else row)
                    held += len(body) * payloads + 300
                    if held > 4_000_000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = RECORD + ", payload binary" * payloads
    names = [part.split()[0] for part in schema.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[part.split()[1]] for part in schema.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(unpack, schema)


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Which records are originals: of the records with one payload digest and length, that with the largest page id (then the
    largest record id) stays a response and the others revisit it. Payloads under ``least_bytes`` are all responses.

    Only headers move. The aggregate combines before its shuffle, so a payload that a third of all pages share is one row per
    task there; in the join its rows stand against a single row and Spark may split them.
    """
    key = ["payload_digest", "payload_bytes"]
    long_enough = headers.where(F.col("payload_bytes") >= least_bytes)
    first = long_enough.groupBy(*key).agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("p"), "record_id")).alias("o"), F.count("*").alias("n")).where("n > 1")
    first = first.select(*key, F.col("o.record_id").alias("o_record"), F.nullif(F.col("o.p"), F.lit(-(2**63))).alias("o_page"))
    joined = headers.join(first, key, "left")
    revisit = F.col("o_record").isNotNull() & (F.col("record_id") != F.col("o_record"))
    return joined.select(
        "record_id",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("new_type"),
        F.when(revisit, F.col("o_page")).alias("new_refers_to"),
        F.when(revisit, F.col("o_record")).alias("new_refers_record"),
    )


def write_deduplicated(records: DataFrame, verdicts: DataFrame, path: str, per_file: int = 20_000) -> None:
    """Write ``records`` (with payloads) again under fresh headers and record ids; a revisit carries no payload.

    A fresh id is derived from the old one, so that a revisit can name its original without another join.
    """

    def fresh(old: str) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, old)}>"

    def build(batches):
        for batch in batches:
            out = []
            for record, page, url, digest, size, payload, kind, refers, refers_record in zip(*(c.to_pylist() for c in batch.columns)):
                body = b"" if kind == "revisit" else payload
                fields = [
                    ("WARC-Type", kind),
                    ("WARC-Record-ID", fresh(record)),
                    ("WARC-Target-URI", url),
                    ("X-Page-ID", page),
                    ("WARC-Payload-Digest", f"sha1:{digest}"),
                ]
                if kind == "revisit":
                    fields += [
                        ("WARC-Profile", REVISIT_PROFILE),
                        ("WARC-Refers-To", fresh(refers_record)),
                        ("X-Refers-To-Page-ID", refers),
                        ("X-Payload-Length", size),
                    ]
                out.append(_header([*fields, ("Content-Length", len(body))]) + body)
            yield pa.record_batch([pa.array(out, pa.binary())], names=["record"])

    columns = ["record_id", "page_id", "url", "payload_digest", "payload_bytes", "payload", "new_type", "new_refers_to", "new_refers_record"]
    rows = records.join(verdicts, "record_id").select(*columns)
    _write(rows.mapInArrow(build, "record binary"), path, per_file)


def deduplicate_pages(pages: DataFrame, least_bytes: int = 0, per_file: int = 20_000) -> DataFrame:
    """Pages to archives, archives to deduplicated archives, and the records of those.

    Every row of ``pages`` becomes a record; rows with equal page ids and payloads are separate records, of which one is the
    original. Null html is an empty payload, and an empty table gives no records. Columns other than ``page_id``, ``url`` and
    ``html`` are not read.
    """
    spark = pages.sparkSession
    first, second = scratch_path(spark, "warc"), scratch_path(spark, "warc-dedup")
    write_pages(pages, first, per_file)
    headers, _ = saved(read_archives(spark, first), "warc-headers")
    write_deduplicated(read_archives(spark, first, payloads=True), resolve(headers, least_bytes), second, per_file)
    return read_archives(spark, second)
