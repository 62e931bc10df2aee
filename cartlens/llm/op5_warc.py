"""WARC archives: an index is written first, selected records are then read by coalesced byte ranges.

Pages are written by the tasks that read them, one gzip member per record, to archives in the shared folder. Of
records with equal payloads (SHA-1 and length) the one with the largest page id holds the payload; the others become
revisit records. Only groups of two or more take part in that join, and their table is written first, so that the
planner knows its true size and broadcasts it only below the session's limit; beyond, a skew-split shuffle join serves.

The index (file, offset, length, url, digest, record type) is a Parquet table with a row per record. A task that is
run again writes new archives under new names, and only the rows of the attempt that Spark commits name files, so
half-written archives of lost executors are never read. To read, index rows are range-partitioned and sorted by file
and offset, and neighbouring ranges are joined into reads of at most ``READ_BYTES`` (or one record).

Defined results: null html is an empty payload, a null url leaves out the target. A null page id is never the
largest; if a payload has no other, all its records are responses. Rows with equal page id and payload are all
responses if that id is the largest. An empty table gives an empty index. Memory: one record, and one read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.llm.registry import query, table
from cartlens.session import scratch_path, written

ARCHIVE_BYTES = 1 << 30
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
LEAST_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, refers_to long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit has the HTTP header but no payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of an uncompressed record."""

    def headers(part: bytes) -> dict[str, str]:
        lines = part.decode().split("\r\n")[1:]
        return {k.lower(): v for k, v in (x.split(": ", 1) for x in lines if x)}

    head, _, rest = raw.partition(b"\r\n\r\n")
    own = headers(head)
    block = rest[: int(own["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return own, headers(http), payload


def page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def with_first(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, and refers_to: the page that holds an equal payload, null where the row does so itself."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    keyed = rows.select("*", F.sha1("payload").alias("_sha1"), F.octet_length("payload").alias("_bytes"))
    groups = keyed.filter(F.col("_bytes") >= least).groupBy("_sha1", "_bytes").agg(F.max("page_id").alias("_holder"), F.count(F.lit(1)).alias("_n"))
    repeated = written(groups.filter("_n > 1 and _holder is not null").drop("_n"), "repeated")
    holder = F.when(~F.col("page_id").eqNullSafe(F.col("_holder")), F.col("_holder"))
    return keyed.join(repeated, ["_sha1", "_bytes"], "left").select("page_id", "url", "payload", holder.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages to gzipped archives in a folder that all executors reach; returns the written index."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, refers_to in zip(*[c.to_pylist() for c in batch.columns]):
                    if out is not None and at >= ARCHIVE_BYTES:
                        out.close()
                        out = None
                    if out is None:
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    digest = bare_digest(payload)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = packer.compress(record(page_id, url, payload, digest, len(payload), refers_to)) + packer.flush()
                    out.write(raw)
                    rows.append((page_id, url, name, at, len(raw), digest, "response" if refers_to is None else "revisit", refers_to))
                    at += len(raw)
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    names = ["page_id", "url", "file", "offset", "length", "payload_digest", "record_type", "refers_to"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        finally:
            if out is not None:
                out.close()

    return written(with_first(pages).mapInArrow(run, INDEX), "warc_index").withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))


def ranges(files: list[str], offsets: list[int], lengths: list[int]):
    """Index ranges [a, b) of sorted records that one read covers."""
    a = 0
    for b in range(1, len(files) + 1):
        if (
            b == len(files) or files[b] != files[a] or offsets[b] - offsets[b - 1] - lengths[b - 1] > GAP_BYTES
            or offsets[b] + lengths[b] - offsets[a] > READ_BYTES
        ):
            yield a, b
            a = b


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records that the index rows name, checked against their digests; with ``payloads`` also url and html."""
    rows = index.select("file", "offset", "length", "url").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def run(batches):
        name, source = None, None
        for batch in batches:
            files, offsets, lengths, urls = (c.to_pylist() for c in batch.columns)
            for a, b in ranges(files, offsets, lengths):
                if files[a] != name:
                    store, path = fs.FileSystem.from_uri(files[a])
                    name, source = files[a], store.open_input_file(path)
                chunk = source.read_at(offsets[b - 1] + lengths[b - 1] - offsets[a], offsets[a])
                out = []
                for k in range(a, b):
                    at = offsets[k] - offsets[a]
                    own, http, payload = parsed(zlib.decompress(chunk[at : at + lengths[k]], 31))
                    size, digest = int(http["content-length"]), own["warc-payload-digest"].removeprefix("sha1:")
                    revisit = own["warc-type"] == "revisit"
                    if not revisit and (len(payload) != size or bare_digest(payload) != digest):
                        raise ValueError(f"payload of record {own['warc-record-id']} does not match its digest")
                    out.append((
                        page_of(own["warc-record-id"]), size, digest, own["warc-type"],
                        page_of(own["warc-refers-to"]) if revisit else None,
                        *((urls[k], None if revisit else payload.decode()) if payloads else ()),
                    ))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"]
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return rows.mapInArrow(run, RECORDS + (", url string, html string" if payloads else ""))


_HEX_BITS = (
    "list_aggregate(list_transform(range(1, 41), lambda i: substr("
    "'0000000100100011010001010110011110001001101010111100110111101111', "
    "4 * (strpos('0123456789abcdef', substr(h, i::BIGINT, 1)) - 1) + 1, 4)), 'string_agg', '')"
)
_BASE32 = (
    "list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    + " + ".join(["1"] + [f"{16 >> k} * substr(bits, (5 * i + {k + 1})::BIGINT, 1)::INT" for k in range(5)])
    + ", 1)), 'string_agg', '')"
)


@query("op5_warc", sql=f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS holder FROM p),
spelt AS (SELECT *, {_HEX_BITS} AS bits FROM hashed)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN holder IS NULL OR page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM spelt
""")
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return read_records(write_archives(table(spark, folder, "pages")))
