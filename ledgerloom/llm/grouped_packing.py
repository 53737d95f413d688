"""Best-fit packing by linear grouping.

Documents become token sequences of at most CAPACITY ids; longer ones are cut
into pieces, of which only the first may be short.  How full sequences get
depends on nothing but how many pieces there are of each length, so the plan
is made on that histogram, of CAPACITY numbers at most:

1. Large lengths are grouped by equal numbers of pieces and rounded up to the
   largest in their group, which leaves few sizes.
2. For those sizes, configurations (how many of each size share a sequence)
   are optimised by column generation on the covering linear program.
3. The pieces themselves take the places of the rounded sizes, longest first.
4. What is left, and all small pieces, go best-fit, longest first, into the
   room that remains.

The plan says, in ranges of ranks among the pieces of a length, which sequence
and offset they take, and has a few thousand rows at any size of the corpus.
Ranks are counted within hashed buckets of each length and shifted by the
buckets before, so a length that a third of all pieces share is no hot group.

Edge cases: a null text is an empty one and has the end id alone; repeated
rows and null ids are pieces like any others; a text of any length is cut; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.llm.text import arrow_batches
from ledgerloom.llm.tokens import encoder
from ledgerloom.storage import stored

CAPACITY = 1024
#: Pieces longer than this share of a sequence are large.
SMALL_SHARE = 8
#: Equal-cardinality groups of large lengths.
GROUPS = 224
#: How far the program may stay from its optimum, and rounds of it for each group.
GAP, ROUNDS = 1e-3, 6
#: Pieces for each bucket in which ranks are counted, and the fewest and most buckets.
BUCKET_PIECES, BUCKETS = 20_000, (256, 4096)


def pieces_of(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; the first takes what full pieces leave over."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


class _Stock:
    """Pieces of a group, longest first, as runs of equal length; ``taken`` counts each length from rank 0."""

    def __init__(self, runs: list[tuple[int, int]]) -> None:
        self.runs = [list(r) for r in sorted(runs, reverse=True) if r[1]]

    def take(self, n: int) -> list[tuple[int, int]]:
        out = []
        while n and self.runs:
            length, count = self.runs[0]
            k = min(n, count)
            out.append((length, k))
            n -= k
            self.runs[0][1] -= k
            if not self.runs[0][1]:
                self.runs.pop(0)
        return out


def grouped(large: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Cut large lengths into groups of equal numbers of pieces: (size rounded up to, its runs)."""
    stock = _Stock(list(large.items()))
    total = sum(large.values())
    merged: dict[int, list[tuple[int, int]]] = {}
    for k in range(groups):
        runs = stock.take((k + 1) * total // groups - k * total // groups)
        if runs:
            merged.setdefault(runs[0][0], []).extend(runs)
    return list(merged.items())


def configurations(sizes: list[int], demand: list[int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(pieces of each size, times used): column generation on the covering program, rounded down."""
    n = len(sizes)
    demanded, lengths = np.array(demand, float), np.array(sizes)
    basis = np.diag((capacity // lengths).astype(float))
    # Room left by one more piece of each size, or a place that stays out of reach.
    left = np.arange(capacity + 1)[None, :] - lengths[:, None]
    left[left < 0] = capacity + 1
    for _ in range(ROUNDS * n):
        worth = np.linalg.solve(basis.T, np.ones(n))
        layers, best = [], np.zeros(capacity + 1)
        for _ in range(capacity // min(sizes)):
            grown = np.append(best, -np.inf)[left] + worth[:, None]
            choice = grown.argmax(axis=0)
            value = grown[choice, np.arange(capacity + 1)]
            better = value > best + 1e-12
            layers.append(np.where(better, choice, -1))
            best = np.where(better, value, best)
        if best[capacity] <= 1 + GAP:
            break
        column, room = np.zeros(n), capacity
        for choice in reversed(layers):
            if choice[room] >= 0:
                column[choice[room]] += 1
                room -= sizes[choice[room]]
        level, rate = np.linalg.solve(basis, demanded), np.linalg.solve(basis, column)
        ratios = np.where(rate > 1e-9, level / np.where(rate > 1e-9, rate, 1), np.inf)
        if not np.isfinite(ratios.min()):
            break
        basis[:, int(ratios.argmin())] = column
    level = np.linalg.solve(basis, np.array(demand, float))
    return [(basis[:, k].round().astype(int).tolist(), int(np.floor(level[k] + 1e-9))) for k in range(n) if level[k] >= 1 - 1e-9]


class _Plan:
    """Sequences as runs of alike ones, and where the pieces of each length go."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.ranks: dict[int, int] = {}
        #: By room left: (first sequence, number of sequences).
        self.open: dict[int, list[tuple[int, int]]] = {}

    def place(self, length: int, count: int, first: int, each: int, offset: int) -> None:
        """The next ``count`` pieces of a length: ``each`` to a sequence, from ``first`` on."""
        rank = self.ranks.get(length, 0)
        self.rows.append((length, rank, rank + count, first, each, offset))
        self.ranks[length] = rank + count

    def use(self, pattern: list[int], times: int, stocks: list[_Stock]) -> None:
        """Fill ``times`` new sequences alike, with real pieces in the places of rounded sizes."""
        slots = [stock.take(times) for k, stock in enumerate(stocks) for _ in range(pattern[k])]
        edges = sorted({0, times} | {int(e) for s in slots for e in np.cumsum([c for _, c in s])})
        at = [0] * len(slots)
        left = [s[0][1] if s else 0 for s in slots]
        for lo, hi in zip(edges, edges[1:]):
            n, offset = hi - lo, 0
            for k, slot in enumerate(slots):
                if at[k] < len(slot):
                    self.place(slot[at[k]][0], n, self.sequences, 1, offset)
                    offset += slot[at[k]][0]
                    left[k] -= n
                    if not left[k]:
                        at[k] += 1
                        left[k] = slot[at[k]][1] if at[k] < len(slot) else 0
            self.open.setdefault(self.capacity - offset, []).append((self.sequences, n))
            self.sequences += n

    def best_fit(self, length: int, count: int) -> None:
        """Put pieces where the least room is left that holds them, opening sequences when none does."""
        while count:
            room = min((r for r, runs in self.open.items() if r >= length and runs), default=None)
            if room is None:
                each = self.capacity // length
                new = -(-count // each)
                self.open.setdefault(self.capacity, []).append((self.sequences, new))
                self.sequences += new
                continue
            first, n = self.open[room].pop()
            each = room // length
            full = min(n, count // each)
            if full:
                self.place(length, full * each, first, each, self.capacity - room)
                self.open.setdefault(room - each * length, []).append((first, full))
                count -= full * each
                first, n = first + full, n - full
            if n and count and count < each:
                self.place(length, count, first, count, self.capacity - room)
                self.open.setdefault(room - count * length, []).append((first, 1))
                count, first, n = 0, first + 1, n - 1
            if n:
                self.open[room].append((first, n))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, rank from, rank to, first sequence, pieces to a sequence, offset), and the number of sequences.

    A piece of the length with rank r goes to sequence first + (r - from) div
    each, at offset + (r - from) mod each * length.
    """
    p = _Plan(capacity)
    if histogram.get(capacity):
        p.place(capacity, histogram[capacity], 0, 1, 0)
        p.sequences = histogram[capacity]
    small = capacity // SMALL_SHARE
    rest = {s: c for s, c in histogram.items() if s <= small}
    large = {s: c for s, c in histogram.items() if small < s < capacity}
    if large:
        sized = grouped(large, groups)
        stocks = [_Stock(runs) for _, runs in sized]
        for pattern, times in configurations([s for s, _ in sized], [sum(c for _, c in runs) for _, runs in sized], capacity):
            p.use(pattern, times, stocks)
        for stock in stocks:
            for length, count in stock.runs:
                rest[length] = rest.get(length, 0) + count
    for length in sorted(rest, reverse=True):
        p.best_fit(length, rest[length])
    return p.rows, p.sequences


PIECE = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


def tokenized(documents: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, stored; with their ids as little-endian u32 bytes if wanted."""
    schema = T.StructType([*PIECE.fields, T.StructField("ids", T.BinaryType())]) if with_ids else PIECE
    arrow, end = to_arrow_schema(schema), struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, True).encode
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode([t or "" for t in batch["text"].to_pylist()]), strict=True):
                ids += end
                for k, (start, length) in enumerate(pieces_of(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    row = {"doc_id": doc_id, "piece": k, "start": start, "length": length, "ids_crc32": zlib.crc32(part)}
                    rows.append(row | {"ids": part} if with_ids else row)
            yield pa.RecordBatch.from_pylist(rows, arrow)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_batches(documents.sparkSession):
        return stored(docs.mapInArrow(cut, schema), "pieces")


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored pieces (doc_id, piece, start, length, ids_crc32, ...)."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # CAPACITY rows at most
    rows, _ = plan(histogram, capacity) if histogram else ([], 0)
    table = spark.createDataFrame(rows, "length long, rank_from long, rank_to long, first_sequence long, each long, at long")
    buckets = min(max(BUCKETS[0], sum(histogram.values()) // BUCKET_PIECES), BUCKETS[1])
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sums = rows.groupBy("length", "bucket").count()
    before = sums.withColumn("before", F.sum("count").over(W.Window.partitionBy("length").orderBy("bucket")) - F.col("count")).drop("count")
    within = F.row_number().over(W.Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = rows.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    # The plan's size depends on the capacity alone.
    in_range = (ranked["length"] == table["length"]) & (ranked["rank"] >= table["rank_from"]) & (ranked["rank"] < table["rank_to"])
    joined = ranked.join(F.broadcast(table), in_range).drop(table["length"])
    nth = F.col("rank") - F.col("rank_from")
    out = joined.withColumns({"sequence_id": F.col("first_sequence") + F.floor(nth / F.col("each")), "offset": F.col("at") + nth % F.col("each") * F.col("length")})
    return out.select(*pieces.columns, "sequence_id", "offset")


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from placed pieces with ids; a group holds at most one sequence's ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def pack(spark: SparkSession, documents: DataFrame, with_ids: bool = False) -> DataFrame:
    """Tokenize and pack documents (doc_id, text)."""
    import public_tokenizers

    return packed(tokenized(documents, public_tokenizers.path("byte_bpe_50k.json"), with_ids=with_ids))


def op8_grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
