"""WARC archives: a writer and a sequential reader.

An archive is a run of gzip members, one record each. Archives are kept as
ordered blocks (``archive``, ``block_no``, ``content``) in a table, since only
Spark reaches the store; blocks cut members anywhere. The reader inflates
block by block, frames records by Content-Length and verifies digests.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 20
BLOCKS = "archive string, block_no long, content binary"
RECORDS = (
    "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, digest_ok boolean"
)
_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_())]
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: the smallest page_id of equal payloads, null for that page itself.

    Payloads are compared by SHA-1 and length; those below ``least_bytes`` refer to nothing. Null html is empty.
    """
    page = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    # a digest's first page is written beside its few repeats; the hot digests are few rows after the partial aggregate
    first = page.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").drop("n")
    joined = page.join(first, ["digest", "bytes"], "left")
    return joined.select("page_id", "url", "html", F.expr("CASE WHEN first <> page_id OR page_id IS NULL THEN first END").alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    body = http + payload if refers_to is None else http
    uri = "".join(c for c in url or "" if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}",
            "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(body)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(pages: DataFrame, level: int = 6) -> DataFrame:
    """The archives of ``pages`` (page_id, url, html, refers_to) as ordered blocks, one archive per partition.

    Null and empty html give records with an empty payload. No pages give no archives.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, number, waiting = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0, bytearray()

        def block(content: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([number], pa.int64()), pa.array([content])], ["archive", "block_no", "content"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4))):
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                record = _record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py())
                waiting += member.compress(record) + member.flush()
                while len(waiting) >= BLOCK_BYTES:
                    yield block(bytes(waiting[:BLOCK_BYTES]))
                    del waiting[:BLOCK_BYTES]
                    number += 1
        if waiting:
            yield block(bytes(waiting))

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, BLOCKS)


def _parse(raw: bytes) -> tuple:
    end = raw.index(b"\r\n\r\n")
    version, *lines = raw[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    head = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    length = int(head["content-length"])
    body = raw[end + 4 : end + 4 + length]
    if len(body) != length or raw[end + 4 + length :] != b"\r\n\r\n":
        raise ValueError(f"record {head.get('warc-record-id')} does not end where its Content-Length says")
    split = body.index(b"\r\n\r\n") + 4
    http = {k.lower(): v for k, _, v in (x.partition(": ") for x in body[:split].decode().split("\r\n"))}
    payload, digest = body[split:], head["warc-payload-digest"].partition(":")[2]
    kind = head["warc-type"]
    good = head["warc-block-digest"] == f"sha1:{base32_sha1(body)}" and (kind == "revisit" or base32_sha1(payload) == digest)
    page, refers = head["warc-record-id"][10:-1], head.get("warc-refers-to", "")[10:-1]
    return (int(page) if page else None, head["warc-target-uri"], kind, payload if kind == "response" else None,
            int(http["content-length"]), digest, int(refers) if refers else None, good)


class Inflater:
    """Records of one archive from blocks fed in order."""

    def __init__(self):
        self._member, self._parts = zlib.decompressobj(31), []

    def feed(self, block: bytes) -> Iterator[bytes]:
        while block:
            self._parts.append(self._member.decompress(block))
            if not self._member.eof:
                return
            block = self._member.unused_data
            yield b"".join(self._parts)
            self._member, self._parts = zlib.decompressobj(31), []

    def close(self, name: str) -> None:
        if any(self._parts):
            raise ValueError(f"{name} ends inside a record")


def read_archives(blocks: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives; ``digest_ok`` tells whether its digests hold.

    A cut archive, a wrong version line or a wrong Content-Length raises. No blocks give no records.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source, rows, size = None, Inflater(), [], 0
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1)):
                if archive.as_py() != name:
                    source.close(name)
                    name, source = archive.as_py(), Inflater()
                for raw in source.feed(content.as_py()):
                    row = _parse(raw)
                    rows.append(row if with_payload else (*row[:3], None, *row[4:]))
                    size += len(row[3] or b"") if with_payload else 100
                    if size > BLOCK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
                        rows, size = [], 0
        source.close(name)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    ordered = blocks.repartition("archive").sortWithinPartitions("archive", "block_no").select("archive", "content")
    return ordered.mapInArrow(read, RECORDS)


def archive_blocks(files: DataFrame) -> DataFrame:
    """Archives read by Spark's binaryFile source, as blocks."""
    return files.select(F.col("path").alias("archive"), F.lit(0).cast("long").alias("block_no"), "content")
