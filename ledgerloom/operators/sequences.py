"""Ordered rows: values carried forward, open ranges, runs of numbers, spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.storage import broadcast_if_small, dealt, stored


def carried_forward(rows: DataFrame, group: list[str], order: list[str], *columns: str) -> DataFrame:
    """Blank values take the last one above them."""
    w = W.Window.partitionBy(*group).orderBy(*order).rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    return rows.withColumns({c: F.last(F.nullif(F.col(c), F.lit("")), ignorenulls=True).over(w) for c in columns})


def next_larger(starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order, the next larger start below in the same group, and the largest above; 0 where there is none.

    Rows wait on a stack, largest start first, until a larger one comes.
    """
    later, above = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    waiting: list[int] = []
    high = 0
    for k, s in enumerate(starts.tolist()):
        if k and group[k] != group[k - 1]:
            waiting, high = [], 0
        above[k] = high
        if s >= 0:
            while waiting and starts[waiting[-1]] < s:
                later[waiting.pop()] = s
            waiting.append(k)
            high = max(high, s)
    return later, above


def closed_ranges(rows: DataFrame, group: list[str], order: list[str], start: str, end: str, last: str) -> DataFrame:
    """Open ends become one less than the next larger start further down, or the last number of the group.

    Rows without a start (-1 for next_larger) stay as they are.  Rows are cut
    into ranges of group and order, so a group of any size is spread over
    tasks.  Within a range a stack finds the next larger start.  Where there is
    none, the first later range of the group whose largest start is larger
    holds it: its first start beyond all before it in that range.  Ranges, not
    rows, are listed for that, and only for groups that a border cuts.
    """
    # Stored, as the cut of the ranges reads the rows once more.
    df = stored(rows, "open-ranges").withColumn("_g", F.struct(*group)).withColumn("_s", F.coalesce(F.col(start), F.lit(-1)).cast("long"))
    df = df.repartitionByRange("_g", *order).sortWithinPartitions("_g", *order).withColumn("_block", F.spark_partition_id())
    schema = T.StructType([*df.schema.fields, T.StructField("_later", T.LongType()), T.StructField("_above", T.LongType())])
    arrow = to_arrow_schema(schema)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema(list(arrow)[:-2]))
        if not table.num_rows:
            return
        # A group's rows stand together: a number that changes where the group does.
        flat = table["_g"].combine_chunks().flatten()
        changed = np.zeros(table.num_rows, bool)
        for column in flat:
            code = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
            changed[1:] |= code[1:] != code[:-1]
        later, above = next_larger(table["_s"].to_numpy(), np.cumsum(changed))
        yield from table.append_column(arrow.field("_later"), pa.array(later)).append_column(arrow.field("_above"), pa.array(above)).to_batches()

    found = stored(df.mapInArrow(find, schema).withColumn("_row", F.monotonically_increasing_id()), "ranges")
    # Only groups that lie in several ranges look further: at most one for each border between ranges.
    highest = stored(found.groupBy("_g", F.col("_block").alias("_next")).agg(F.max("_s").alias("_most")), "range-tops")
    split = stored(highest.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_g"), "split-groups")
    if split.isEmpty():
        df = found.withColumn("_found", F.lit(None).cast("long"))
    else:
        theirs = F.broadcast(split)
        highest = highest.join(theirs, "_g")
        # A row's first later range with a larger start: the tops of a group's ranges, in order, are searched for it.
        tops = highest.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_next", "_most"))).alias("_tops"))
        waiting = found.where("_s >= 0 and _later = 0").select("_g", "_block", "_row", "_s").join(F.broadcast(tops), "_g")
        later = F.get(F.filter("_tops", lambda t: (t["_next"] > F.col("_block")) & (t["_most"] > F.col("_s"))), F.lit(0))
        where = waiting.select("_g", "_row", "_s", later["_next"].alias("_next")).where("_next is not null")
        rising = found.where("_s > _above").join(theirs, "_g").select("_g", F.col("_block").alias("_next"), F.col("_s").alias("_start"), "_above")
        beyond = where.join(rising, ["_g", "_next"]).where("_above <= _s and _start > _s").select("_row", F.col("_start").alias("_found"))
        # Few rows wait beyond a border: the others stay where they are.
        df = found.join(broadcast_if_small(stored(beyond, "beyond")), "_row", "left")
    following = F.coalesce("_found", F.nullif("_later", F.lit(0)))
    is_open = F.col(end).isNull() & F.col(start).isNotNull()
    kind = rows.schema[end].dataType
    return df.withColumns({end: F.when(is_open, F.coalesce(following - 1, F.col(last)).cast(kind)).otherwise(F.col(end)), "inferred": is_open}).select(*rows.columns, "inferred")


def islands(rows: DataFrame, group: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers as ranges.

    Groups are dealt out once, to more tasks the more rows there are, and what
    follows stays there; equal numbers have one rank, so that repeats need no
    distinct.
    """
    df = dealt(rows.select(*group, number), *group)
    df = df.withColumn("_island", F.col(number) - F.dense_rank().over(W.Window.partitionBy(*group).orderBy(number)))
    ends = df.groupBy(*group, "_island").agg(F.min(number).alias("first"), F.max(number).alias("last"))
    return ends.withColumn("n", F.coalesce((F.col("last") - F.col("first") + 1).cast("long"), F.lit(1).cast("long"))).drop("_island")


def in_spans(points: DataFrame, spans: DataFrame, key: str, number: str, width: int = 64) -> DataFrame:
    """Points within spans (key, start, end, ...): a range join by equal buckets of the number.

    Each span is listed once for every bucket it touches, so the join is an
    equality and a check.
    """
    buckets = F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))
    listed = spans.withColumn("_bucket", F.explode(buckets))
    found = points.withColumn("_bucket", F.floor(F.col(number) / width)).join(listed, [key, "_bucket"])
    return found.where(F.col(number).between(F.col("start"), F.col("end"))).drop("_bucket")


def dominant(found: DataFrame, key: str, value: str, least: float = 0.8) -> DataFrame:
    """The value that covers most of a key's rows, if it covers enough of them."""
    n = found.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(key).agg(F.max(F.struct("n", value)).alias("b"), F.sum("n").alias("total"))
    return best.where(F.col("b.n") >= least * F.col("total")).select(key, F.col(f"b.{value}").alias(value), (F.col("b.n") / F.col("total")).alias("share"))


def timeline(facts: DataFrame, marriages: DataFrame) -> DataFrame:
    """Dated facts and marriages that are not mere hypotheses, by year."""
    columns = ["kind", "subject", "year"]
    return facts.select(*columns).unionByName(marriages.where("status <> 'hypothetical'").select(*columns)).where("year is not null").orderBy("year", "kind", "subject")
