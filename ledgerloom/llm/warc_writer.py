"""Deterministic sharded WARC archives.

Pages are cut into ranges of page_id with about equal payload bytes, sorted
within each range and written by one task per range, which starts a new file
whenever the compressed size reaches a limit.  Headers and digests are made
from the payload, never taken over.  Tasks write under temporary names; when
all are done, the files of the successful attempts are renamed and a manifest
is written last.  The same pages always give the same files, byte for byte.

Of records with equal payloads of REVISIT_BYTES or more, the one with the
largest page_id carries the payload and the others revisit it.  The verdict is
reached on narrow rows of ids and digests and meets the pages again in the
sorted stream, so payloads are shuffled once.

Edge cases: a null html is an empty payload; a null URL leaves its header out,
and control characters in one are percent-encoded; a null page_id sorts first
and never wins the response while another page has an id; pages that repeat
both id and payload are all responses; an empty table writes a manifest
without files; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.llm import files
from ledgerloom.llm.ranges import Ranges, balanced_ranges
from ledgerloom.llm.text import arrow_batches, utf8_size
from ledgerloom.storage import new_path, stored

REVISIT_BYTES = 1000
#: Payload bytes of a task, more in inputs of over 50 000 such tasks, and compressed bytes after which it starts a new file.
SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
#: Record header and gzip framing, counted as the weight of an empty page.
RECORD_BYTES = 600
PAGES_PER_BATCH = 256
READ_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

WRITTEN = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("temporary", T.StringType()), T.StructField("records", T.LongType()),
    T.StructField("bytes", T.LongType()), T.StructField("sha256", T.StringType()),
])
READ = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
])


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record_id(*parts: object) -> str:
    h = hashlib.md5("\x1f".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).hexdigest())}"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, nth: int = 0) -> bytes:
    """The response or revisit record of a page, the ``nth`` of those with its id and payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "revisit" if revisit else "response"
    headers = [
        ("WARC-Record-ID", _record_id(kind, page_id, digest, nth)), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha1:{_base32(digest)}"), ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", _record_id("response", refers_to, digest, 0) if revisit else None),
        ("WARC-Page-ID", page_id), ("WARC-Refers-To-Page-ID", refers_to if revisit else None), ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(kind, headers, http if revisit else http + payload)


class _File:
    """An archive being written: one gzip member per record, hashed on the way."""

    def __init__(self, store, root: str, name: str) -> None:
        self.name, self.temporary, self.records, self.bytes, self.hash = name, files.temporary(name), 0, 0, hashlib.sha256()
        self.out = store.open_output_stream(f"{root}/{self.temporary}", compression=None)
        self.add(_record("warcinfo", [("WARC-Record-ID", _record_id("warcinfo", name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.records = 0

    def add(self, record: bytes) -> None:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(record) + z.flush()
        self.out.write(member)
        self.hash.update(member)
        self.bytes += len(member)
        self.records += 1

    def closed(self) -> dict:
        self.out.close()
        return {"name": self.name, "temporary": self.temporary, "records": self.records, "bytes": self.bytes, "sha256": self.hash.hexdigest()}


def _writer(folder: str, roll_bytes: int):
    """Write each shard's sorted rows to files; returns what was written."""
    schema = to_arrow_schema(WRITTEN)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = files.opened(folder)
        shard, rolled, file, verdict, last, nth = None, 0, None, None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["is_verdict"]:
                    verdict = row
                    continue
                if row["shard"] != shard or file.bytes >= roll_bytes:
                    if file:
                        yield pa.RecordBatch.from_pylist([file.closed()], schema)
                    rolled = rolled + 1 if row["shard"] == shard else 0
                    shard = row["shard"]
                    file = _File(store, root, f"pages-{shard:06d}-{rolled:05d}.warc.gz")
                payload = (row["html"] or "").encode()
                # Pages that repeat id and payload stand together, whatever their URLs.
                last, nth = (row["page_id"], row["digest"]), nth + 1 if last == (row["page_id"], row["digest"]) else 0
                revisit = verdict is not None and (verdict["page_id"], verdict["digest"]) == (row["page_id"], row["digest"])
                file.add(page_record(row["page_id"], row["url"], payload, row["digest"], verdict["refers_to"] if revisit else None, revisit, nth))
        if file:
            yield pa.RecordBatch.from_pylist([file.closed()], schema)

    return write


def revisits(light: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that only point at an equal payload.

    ``light`` has page_id, digest and size.  Equal payloads meet as ids and
    digests; a digest that many pages share is pre-aggregated to its largest
    id, and the join back splits it where it is hot.
    """
    large = light.where(F.col("size") >= REVISIT_BYTES).select("page_id", "digest")
    kept = stored(large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n"), "warc-kept")
    return large.join(kept, "digest").where("page_id is null or page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> list[dict]:
    """Write ``pages`` (page_id, url, html) as WARC files below ``folder``; returns the manifest."""
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    light = stored(pages.select("page_id", "digest", utf8_size(F.col("html")).alias("size")), "warc-light")
    ranges: Ranges = balanced_ranges(light.select(F.col("page_id").alias("key"), (F.col("size") + RECORD_BYTES).alias("weight")), shard_bytes)
    none = lambda kind: F.lit(None).cast(kind)
    verdicts = revisits(light).select("page_id", none("string").alias("url"), none("string").alias("html"), "digest", "refers_to", F.lit(True).alias("is_verdict"))
    rows = pages.withColumns({"refers_to": none("long"), "is_verdict": F.lit(False)}).unionByName(verdicts)
    tie = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("shard", ranges.shard(F.col("page_id"), tie)).repartitionById(ranges.count, F.col("shard"))
    rows = rows.sortWithinPartitions("page_id", "digest", F.desc("is_verdict"), "url")
    files.prepare(folder)
    with arrow_batches(spark, PAGES_PER_BATCH):
        # A row per file: about the corpus over ROLL_BYTES of them.
        written = [r.asDict() for r in rows.mapInArrow(_writer(folder, roll_bytes), WRITTEN).collect()]
    files.commit(spark, folder, written)
    return files.manifest(folder)


def records_of(stream) -> Iterator[bytes]:
    """The records of an archive, one gzip member at a time."""
    z, parts, chunk = zlib.decompressobj(31), [], b""
    while True:
        if not chunk:
            chunk = stream.read(READ_BYTES)
            if not chunk:
                return
        parts.append(z.decompress(chunk))
        chunk = b""
        if z.eof:
            yield b"".join(parts)
            chunk, z, parts = z.unused_data, zlib.decompressobj(31), []


def parsed(record: bytes) -> dict | None:
    """A page's row from its record, or None for other records; digests are made anew and compared."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = headers["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    number = lambda key: int(headers[key]) if key in headers else None
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    return {
        "page_id": number("WARC-Page-ID"), "url": headers.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": number("WARC-Refers-To-Page-ID"),
    }


def _reader(folder: str):
    schema = to_arrow_schema(READ)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = files.opened(folder)
        for batch in batches:
            for name in batch["name"].to_pylist():
                rows = []
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in records_of(stream):
                        if (row := parsed(record)) is not None:
                            rows.append(row)
                        if len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per page from the archives of a manifest; one task per file, one record in memory."""
    names = [(k, f["name"]) for k, f in enumerate(files.manifest(folder))]
    listed = spark.createDataFrame(names, "at int, name string").repartitionById(max(1, len(names)), F.col("at"))
    return listed.mapInArrow(_reader(folder), READ)


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), folder)
    return read_archives(spark, folder).drop("url")
