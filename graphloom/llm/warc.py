"""Pages to WARC archives and back.

Every page becomes one gzip member that holds one record. Among records with equal payloads of at least `revisit_bytes` bytes the
one with the largest page id is the response, the others are revisits that carry its headers alone. The reader goes through an archive
once: it inflates member by member in blocks of 64 KiB, cuts records by content length and checks block and payload digests.

Every attempt of a writing task puts its archives under names of its own and renames them when they are whole. The manifest lists
those of the attempts that count, so a second or speculative attempt can't replace what another one wrote. The archives lie in the
shared folder; opening them goes through pyarrow's file systems.

Defined results: a null payload is empty; a null url gives a record without target; rows that repeat the largest id of their
payload are all responses; a page with a null id is always a response; an empty table gives no archive and no rows; columns of
the pages other than the three don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.joins import spread_join

from .common import fresh_path, ship_package, stored

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 16


@dataclass(frozen=True)
class WarcRules:
    revisit_bytes: int = 1000
    archive_bytes: int = 64 << 20  #: uncompressed bytes after which a task begins a new archive
    level: int = 6
    broadcast_rows: int = 200_000  #: most repeated payloads (10 MB of digests) that are broadcast
    moment: str = "2000-01-01T00:00:00Z"  #: WARC-Date; pages carry none of their own


class WarcError(ValueError):
    pass


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_name(page: int | None) -> str:
    return f"<urn:x-page:{'null' if page is None else page}>"


def page_of(name: str) -> int | None:
    text = name.removeprefix("<urn:x-page:").removesuffix(">")
    return None if text == "null" else int(text)


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, moment: str) -> bytes:
    """A response record, or a revisit record if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_name(page)}",
        f"WARC-Date: {moment}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url else []),
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {_sha1(payload)}",
        f"WARC-Block-Digest: {_sha1(block)}",
        *([f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream) -> Iterator[bytes]:
    """The uncompressed gzip members of a stream, one at a time, inflated block by block."""
    rest = b""
    while True:
        inflate, parts, begun = zlib.decompressobj(31), [], False
        while not inflate.eof:
            data = rest or stream.read(BLOCK)
            rest = b""
            if not data:
                if begun:
                    raise WarcError("the archive ends inside a record")
                return
            begun = True
            parts.append(inflate.decompress(data))
        rest = inflate.unused_data
        yield b"".join(parts)


def parsed(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest in hex, record_type, refers_to of one record, with all checks."""
    head, mark, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(fields["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise WarcError("content length doesn't frame the record")
    if _sha1(block) != fields["warc-block-digest"]:
        raise WarcError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(next(line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")))
    digest = fields["warc-payload-digest"]
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != said or _sha1(payload) != digest):
        raise WarcError("payload digest or length differs")
    refers = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
    return page_of(fields["warc-record-id"]), said, base64.b32decode(digest.removeprefix("sha1:")).hex(), kind, refers


def write_archives(pages: DataFrame, folder: str, rules: WarcRules = WarcRules()) -> DataFrame:
    """Writes pages (page_id, url, html, refers_to) to archives in the folder; returns their manifest, stored."""
    ship_package(pages.sparkSession)
    out = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        number, stream, written, count, temp = 0, None, 0, 0, ""
        part = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        made = []

        def close() -> None:
            nonlocal stream, number, written, count
            if stream:
                stream.close()
                name = f"pages-{part}-{number:04d}.warc.gz"
                system.move(temp, f"{base}/{name}")
                made.append((f"{folder}/{name}", count))
                stream, number, written, count = None, number + 1, 0, 0

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if stream is None:
                    temp = f"{base}/.{uuid.uuid4().hex}"
                    stream = system.open_output_stream(temp, compression=None)
                data = record(page, url, (html or "").encode(), refers, rules.moment)
                deflate = zlib.compressobj(rules.level, zlib.DEFLATED, 31)
                stream.write(deflate.compress(data) + deflate.flush())
                written, count = written + len(data), count + 1
                if written >= rules.archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], names=out.names)

    return stored(pages.select("page_id", "url", "html", "refers_to").mapInArrow(work, out), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives in column path, checked one by one."""
    spark = manifest.sparkSession
    ship_package(spark)
    out = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=out.names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(path)
                rows = []
                with system.open_input_stream(name, compression=None) as stream:
                    for member in members(stream):
                        rows.append(parsed(member))
                        if len(rows) == 5000:
                            yield made(rows)
                            rows = []
                if rows:
                    yield made(rows)

    files = manifest.select("path")
    return files.repartition(max(1, min(4096, manifest.count())), "path").mapInArrow(work, out)


def with_references(pages: DataFrame, rules: WarcRules = WarcRules()) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the largest page_id of the payload, for the others of a large repeated payload."""
    digest = F.when(F.octet_length(F.encode(F.coalesce("html", F.lit("")), "utf-8")) >= rules.revisit_bytes, F.sha1(F.encode("html", "utf-8")))
    keyed = pages.select("page_id", "url", "html", digest.alias("_digest"))
    repeated = keyed.where("_digest IS NOT NULL AND page_id IS NOT NULL").groupBy("_digest").agg(F.max("page_id").alias("_last"), F.min("page_id").alias("_first")).where("_last > _first").select("_digest", "_last")
    repeated = stored(repeated, "repeated")
    other = F.when(F.col("page_id") < F.col("_last"), F.col("_last"))
    # small payloads get keys of their own, so that they don't meet under a null one
    keyed = keyed.withColumn("_digest", F.coalesce("_digest", F.concat(F.lit("page "), F.coalesce(F.col("page_id").cast("string"), "url", F.lit("")))))
    return spread_join(keyed, repeated, "_digest", "page_id", "left", rules.broadcast_rows).select("page_id", "url", "html", other.alias("refers_to"))


def round_trip(pages: DataFrame, rules: WarcRules = WarcRules()) -> DataFrame:
    """Writes the pages' archives and returns their records as read back."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(with_references(pages, rules), folder, rules))
