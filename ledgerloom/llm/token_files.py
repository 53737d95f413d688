"""Token ids in files of independent zstandard frames with a seek table.

A file holds the documents of one range of doc_id, in order.  Its frames are
complete on their own, each with zstandard's content checksum:

    frame:  b"TIDS", count u32, doc ids i64 x count, lengths u32 x count, ids u32 ...
    index:  skippable frame 0x184D2A50: for each frame smallest and largest doc id i64, documents u32, ids u64
    seek table:  skippable frame 0x184D2A5E: for each frame compressed and plain size u32 and checksum u32
                 (low half of the plain bytes' XXH64), then frame count u32, flags u8 = 0x80, 0x8F92EAB1

All numbers are little-endian; a null doc id is the smallest i64.  The seek
table is that of the public zstandard seekable format and comes last, so a
reader opens a file from its end and decompresses only the frames whose range
of ids it wants.  Plain zstandard tools read the frames too.

Edge cases: a null text is an empty one and has the end id alone; null ids
sort first; repeated ids follow each other by checksum of their text; a text
of any length is one frame at most; an empty table writes a manifest without
files; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.llm import files
from ledgerloom.llm.ranges import balanced_ranges
from ledgerloom.llm.text import arrow_batches, utf8_size
from ledgerloom.llm.tokens import encoder
from ledgerloom.storage import new_path, stored

#: Text bytes of a file, and bytes of ids in a frame.
SHARD_BYTES = 32 << 20
FRAME_BYTES = 1 << 20
#: A document's own cost in a file, as weight.
DOCUMENT_BYTES = 16
LEVEL = 3
MAGIC, INDEX, SEEK, SEEKABLE = b"TIDS", 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NO_ID = -(1 << 63)

WRITTEN = T.StructType([
    T.StructField("shard", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("temporary", T.StringType()),
    T.StructField("documents", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("bytes", T.LongType()),
])
READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


class FrameWriter:
    """A token file being written to a stream."""

    def __init__(self, out) -> None:
        self.out, self.z = out, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.ids: list[int] = []
        self.parts: list[bytes] = []
        self.held = self.documents = self.tokens = self.bytes = 0
        self.seek: list[bytes] = []
        self.index: list[bytes] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= FRAME_BYTES:
            self.flush()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def flush(self) -> None:
        if not self.ids:
            return
        lengths = np.array([len(p) // 4 for p in self.parts], "<u4")
        plain = b"".join([MAGIC, struct.pack("<I", len(self.ids)), np.array(self.ids, "<i8").tobytes(), lengths.tobytes(), *self.parts])
        frame = self.z.compress(plain)
        self._write(frame)
        self.seek.append(struct.pack("<III", len(frame), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.index.append(struct.pack("<qqIQ", min(self.ids), max(self.ids), len(self.ids), int(lengths.sum(dtype=np.int64))))
        self.documents += len(self.ids)
        self.tokens += int(lengths.sum(dtype=np.int64))
        self.ids, self.parts, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        for magic, body in ((INDEX, b"".join(self.index)), (SEEK, b"".join(self.seek) + struct.pack("<IBI", len(self.seek), 0x80, SEEKABLE))):
            self._write(struct.pack("<II", magic, len(body)) + body)


class FrameReader:
    """Random access to a token file through its seek table."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        table = size - 9 - 12 * n
        self.frames = list(struct.iter_unpack("<III", self._at(table, 12 * n)))
        self.index = list(struct.iter_unpack("<qqIQ", self._at(table - 8 - 28 * n, 28 * n)))
        self.starts = np.concatenate(([0], np.cumsum([f[0] for f in self.frames], dtype=np.int64))).tolist()

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, k: int) -> Iterator[tuple[int | None, memoryview]]:
        """(doc id, ids) of each document in frame ``k``, checked against the seek table."""
        packed, size, checksum = self.frames[k]
        plain = zstandard.ZstdDecompressor().decompress(self._at(self.starts[k], packed), max_output_size=size)
        if len(plain) != size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != checksum or plain[:4] != MAGIC:
            raise ValueError(f"frame {k} does not match its seek table entry")
        n = struct.unpack_from("<I", plain, 4)[0]
        ids = np.frombuffer(plain, "<i8", n, 8).tolist()
        lengths = np.frombuffer(plain, "<u4", n, 8 + 8 * n).tolist()
        at, view = 8 + 12 * n, memoryview(plain)
        for doc_id, length in zip(ids, lengths, strict=True):
            yield (None if doc_id == NO_ID else doc_id), view[at : at + 4 * length]
            at += 4 * length

    def documents(self, wanted: set[int]) -> Iterator[tuple[int, memoryview]]:
        """The wanted documents, decompressing only frames whose range of ids holds one."""
        ordered = np.array(sorted(wanted), np.int64)
        for k, (lo, hi, *_) in enumerate(self.index):
            if np.searchsorted(ordered, lo) < np.searchsorted(ordered, hi, "right"):
                yield from ((d, ids) for d, ids in self.frame(k) if d in wanted)


def _writer(folder: str, tokenizer: str, spaced: bool, end_id: int):
    schema, end = to_arrow_schema(WRITTEN), struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = files.opened(folder)
        encode, shard, writer, out, name, temporary = encoder(tokenizer, spaced).encode, None, None, None, "", ""

        def closed() -> pa.RecordBatch:
            writer.close()
            out.close()
            row = {"shard": shard, "name": name, "temporary": temporary, "documents": writer.documents, "tokens": writer.tokens, "bytes": writer.bytes}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            for at, doc_id, ids in zip(batch["shard"].to_pylist(), batch["doc_id"].to_pylist(), encode(texts), strict=True):
                if at != shard:
                    if writer:
                        yield closed()
                    shard, name = at, f"tokens-{at:06d}.zst"
                    temporary = files.temporary(name)
                    out = store.open_output_stream(f"{root}/{temporary}", compression=None)
                    writer = FrameWriter(out)
                writer.add(doc_id, ids + end)
        if writer:
            yield closed()

    return write


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, spaced: bool, end_id: int, shard_bytes: int = SHARD_BYTES) -> list[dict]:
    """Tokenize ``documents`` (doc_id, text) into token files below ``folder``; returns the manifest."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    light = stored(docs.select(F.col("doc_id").alias("key"), (utf8_size(F.col("text")) + DOCUMENT_BYTES).alias("weight")), "token-weights")
    ranges = balanced_ranges(light, shard_bytes)
    rows = docs.withColumn("tie", F.crc32(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("shard", ranges.shard(F.col("doc_id"), F.col("tie"))).repartitionById(ranges.count, F.col("shard"))
    rows = rows.sortWithinPartitions("doc_id", "tie").select("shard", "doc_id", "text")
    files.prepare(folder)
    with arrow_batches(documents.sparkSession):
        # A row per file: about the corpus over SHARD_BYTES of them.
        written = [r.asDict() for r in rows.mapInArrow(_writer(folder, tokenizer, spaced, end_id), WRITTEN).collect()]
    files.commit(documents.sparkSession, folder, written)
    return files.manifest(folder)


def _reader(folder: str):
    schema = to_arrow_schema(READ)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = files.opened(folder)
        for batch in batches:
            for file in batch.to_pylist():
                start = file["start"]
                with store.open_input_file(f"{root}/{file['name']}") as source:
                    reader = FrameReader(source, file["bytes"])
                    for k in range(len(reader.frames)):
                        rows = []
                        for doc_id, ids in reader.frame(k):
                            rows.append({"doc_id": doc_id, "start": start, "n_tokens": len(ids) // 4, "ids_crc32": zlib.crc32(ids)})
                            start += len(ids) // 4
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return read


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document its place among all ids, their number and their checksum; one frame in memory at a time."""
    listed, start = [], 0
    for k, file in enumerate(files.manifest(folder)):
        listed.append((k, file["name"], file["bytes"], start))
        start += file["tokens"]
    rows = spark.createDataFrame(listed, "at int, name string, bytes long, start long")
    return rows.repartitionById(max(1, len(listed)), F.col("at")).mapInArrow(_reader(folder), READ)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "tokens")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    write_tokens(documents, folder, public_tokenizers.path("word_bpe_49k.json"), spaced=False, end_id=1)
    return read_tokens(spark, folder)
