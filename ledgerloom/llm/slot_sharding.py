"""Sharding through fixed virtual slots (DataFrame functions only).

Every record hashes into one of 4096 slots.  Bytes are summed per slot, and a
small versioned map says which shard owns which slot.  A rebalance edits that
map: overloaded shards give up slots until they fit, and only those slots
move.  Rows are never compared with each other, so the work is one scan, one
shuffle of narrow rows and bookkeeping over the 4096 slots.

Edge cases: a null text has no bytes and the checksum of nothing; a null id
hashes as an empty one; repeated rows share a slot and get places of their
own; an empty table yields an empty layout and a map of empty slots; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.llm.text import utf8_size
from ledgerloom.storage import stored

#: Three hex digits of a hash name the slot.
SLOTS = 4096


def slot_of(record_id: Column, checksum: Column) -> Column:
    """The virtual slot of a record: fixed for ever, whatever the shard count.

    The checksum of the text takes part, so that an id which many different
    records carry does not fill a single slot.
    """
    name = F.concat_ws(":", F.coalesce(record_id.cast("string"), F.lit("")), checksum.cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 3), 16, 10).cast("int")


def measured(records: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every record; the only read of the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = records.select(F.col(id_col).alias("doc_id"), (utf8_size(F.col(text_col)) + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    return narrow.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32")))


def slot_stats(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each slot, empty slots included."""
    spark = rows.sparkSession
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    every = spark.range(0, SLOTS, 1, 1).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(sums, "virtual_slot", "left").select("virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def _dealt(queue: DataFrame) -> DataFrame:
    """Give each queued slot, largest first, to the shard that is emptiest then.

    ``queue`` is one row of two arrays, the slots to place and the bytes that
    each shard holds already.  It has at most SLOTS slots, whatever the corpus
    holds.
    """
    start = F.struct(F.col("loads").alias("loads"), F.array().cast("array<int>").alias("owner"))

    def step(state: Column, item: Column) -> Column:
        emptiest = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda load, i: F.when(i == emptiest, load - item["minus"]).otherwise(load)).alias("loads"),
            F.concat(state["owner"], F.array(emptiest)).alias("owner"),
        )

    owners = queue.select("queue", F.aggregate("queue", start, step)["owner"].alias("owner"))
    pairs = owners.select(F.explode(F.arrays_zip("queue", "owner")).alias("pair"))
    return pairs.select(F.col("pair.queue.virtual_slot").alias("virtual_slot"), F.col("pair.owner").alias("shard"))


def _queue(stats: DataFrame) -> DataFrame:
    return stats.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot"))).alias("queue"))


def first_map(stats: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the slot map: (version, virtual_slot, shard, bytes, n_rows)."""
    owners = _dealt(_queue(stats).withColumn("loads", F.array_repeat(F.lit(0).cast("long"), shards)))
    return stats.join(owners, "virtual_slot").select(F.lit(1).alias("version"), "virtual_slot", "shard", "bytes", "n_rows")


def edited_map(current: DataFrame, stats: DataFrame, shards: int) -> DataFrame:
    """The next version of a slot map, for ``shards`` shards and the present sizes.

    A slot stays where it is while its shard, filled largest slot first, holds
    no more than an even share; the rest move to wherever is emptiest.  With a
    shard more, slots therefore move only off shards that are over their share.
    Every table here has at most SLOTS rows.
    """
    share = F.ceil(F.sum("bytes").over(W.Window.partitionBy()) / F.lit(shards))
    filled = F.sum("bytes").over(W.Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    placed = stats.join(current.select("virtual_slot", "version", "shard"), "virtual_slot").withColumn("share", share)
    placed = stored(placed.withColumn("stays", ((filled <= F.col("share")) | (F.col("bytes") == 0)) & (F.col("shard") < shards)), "slots-placed")
    # The bytes that stay on shards 0, 1, ... in that order.
    loads = F.array(*(F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == i), F.col("bytes"))), F.lit(0)).cast("long") for i in range(shards)))
    moving = F.filter(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot", "stays")), lambda x: ~x["stays"])
    queue = placed.groupBy().agg(F.sort_array(F.transform(moving, lambda x: F.struct(x["minus"].alias("minus"), x["virtual_slot"].alias("virtual_slot")))).alias("queue"), loads.alias("loads"))
    moved = _dealt(queue).withColumnRenamed("shard", "moved_to")
    now = F.when(F.col("stays"), F.col("shard")).otherwise(F.col("moved_to"))
    return placed.join(moved, "virtual_slot", "left").select((F.col("version") + 1).alias("version"), "virtual_slot", now.alias("shard"), "bytes", "n_rows")


@dataclass(frozen=True)
class Layout:
    """Where every record goes, and the stored map that says so."""

    rows: DataFrame
    slot_map: DataFrame


def shard(records: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> Layout:
    """Place every record in one of ``shards`` shards of nearly equal bytes.

    ``rows`` has doc_id, size, text_crc32, virtual_slot, shard and slot, the
    record's place in its shard without gaps.  Places are counted within each
    virtual slot and shifted by the rows of the slots before it, so no task
    sees a whole shard.
    """
    rows = stored(measured(records, id_col, text_col), "slots-measured")
    slot_map = stored(first_map(slot_stats(rows), shards), "slot-map")
    before = F.sum("n_rows").over(W.Window.partitionBy("shard").orderBy("virtual_slot")) - F.col("n_rows")
    places = slot_map.select("virtual_slot", "shard", before.alias("rows_before"))
    within = F.row_number().over(W.Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("within", within)
    # The map has SLOTS rows at any size of the corpus.
    out = numbered.join(F.broadcast(places), "virtual_slot")
    return Layout(out.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("rows_before") + F.col("within") - 1).alias("slot")), slot_map)


def op3_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = shard(documents.select("doc_id", "text"), 16).rows
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
