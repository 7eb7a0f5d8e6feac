"""WARC records in ZIP packages: written by tasks, read back by range from stored members.

A package has the stored members ``archive/data.warc.gz`` (a gzip member a record) and
``indexes/index.tsv`` (record id, offset, length). Records of equal payloads of at least
``min_bytes`` are revisits of the one with the smallest id.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import zip64
from .common import Scratch, ensure_importable, lookup_join, table
from .files import Ranged, put

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.tsv"
MIN_REVISIT_BYTES, PACKAGE_BYTES = 100, 32 << 20
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, package string, offset long, length long"


def build_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit has the HTTP head, with the payload's length, but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(3, wbits=31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload, and the length that the HTTP head names."""
    data = zlib.decompress(raw, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, payload, length


def write_packages(batches: Iterator[pa.RecordBatch], folder: str, package_bytes: int) -> Iterator[pa.RecordBatch]:
    made: list[tuple[str, int, int]] = []
    records: list[bytes] = []
    index: list[str] = []
    size = 0

    def close() -> None:
        nonlocal records, index, size
        if records:
            made.append((put(folder, "pages.wacz", zip64.pack([(ARCHIVE, b"".join(records)), (INDEX, "".join(index).encode())])), len(records), size))
        records, index, size = [], [], 0

    for batch in batches:
        for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
            record = build_record(page_id, url or "", html, digest, refers_to)
            index.append(f"{'' if page_id is None else page_id}\t{size}\t{len(record)}\n")
            records.append(record)
            size += len(record)
            if size >= package_bytes:
                close()
    close()
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["package", "records", "bytes"])


def read_packages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in RECORDS.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def number(urn: str) -> int | None:
        digits = urn.strip("<>").rpartition(":")[2]
        return int(digits) if digits else None

    for batch in batches:
        for uri in batch.column("package").to_pylist():
            rows: list[tuple] = []
            with Ranged(uri) as file:
                members = zip64.directory(file.read, file.size)
                index, archive = members[INDEX], zip64.data_offset(file.read, members[ARCHIVE])
                listing = file.read(zip64.data_offset(file.read, index), index.size)
                if zlib.crc32(listing) != index.crc:
                    raise ValueError(f"{uri}: the index does not match its checksum")
                for line in listing.decode().splitlines():
                    _, offset, length = line.split("\t")
                    fields, payload, full = parse_record(file.read(archive + int(offset), int(length)))
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != full):
                        raise ValueError(f"{uri}: a payload does not match its digest")
                    rows.append((number(fields["warc-record-id"]), full, digest, kind, number(fields["warc-refers-to"]) if kind == "revisit" else None, uri, int(offset), int(length)))
                    if len(rows) >= 5000:
                        yield packed(rows)
                        rows = []
            if rows:
                yield packed(rows)


def archive_pages(pages: DataFrame, owner: str = "warc", min_bytes: int = MIN_REVISIT_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write every row (page_id, url, html) as a WARC record and return the manifest of packages.

    Null html is an empty payload. A null page_id is kept but never referred to. Rows that repeat a
    whole group's smallest page_id are all responses. An empty table makes no package.
    """
    spark = pages.sparkSession
    ensure_importable(spark)
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    repeated = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = Scratch.write(repeated, owner, "repeated")
    found = lookup_join(rows, repeated, ["digest"]).withColumn("refers_to", F.when(~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")))
    folder = Scratch.path(spark, owner, "packages")
    made = found.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(lambda it: write_packages(it, folder, package_bytes), "package string, records long, bytes long")
    return Scratch.write(made, owner, "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the packages, a task for about each package."""
    ensure_importable(manifest.sparkSession)
    return manifest.select("package").repartition(max(1, min(manifest.count(), 20_000))).mapInArrow(read_packages, RECORDS)


def op9_zip_warc(spark, sf_dir):
    """Every page through a package and back; see archive_pages for nulls, ties and empty tables."""
    read = read_archives(archive_pages(table(spark, sf_dir, "pages"), "op9"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
