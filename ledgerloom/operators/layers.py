"""Dictionaries in first-seen order, coverage of spans, and overlays of nested settings."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ledgerloom.storage import broadcast_if_small, stored


def numbered(rows: DataFrame, order: list[str], out: str = "id") -> DataFrame:
    """Rows with a number from 0 without gaps in their order, which leaves no ties.

    Rows are cut into ranges of the order and counted per range; a window over
    ranges, not over rows, tells where each begins.
    """
    dealt = stored(rows, "unnumbered").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = stored(dealt, "ranged").withColumn("_part", F.shiftright("_at", 33))
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(W.Window.orderBy("_part")) - F.col("_n")
    starts = stored(parts.select("_part", (before - F.col("_first")).alias("_shift")), "range-starts")
    return dealt.join(broadcast_if_small(starts), "_part").withColumn(out, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def dictionary(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(value, id): each distinct value with its number by where it is first seen; a null value is one too."""
    first = rows.groupBy(value).agg(F.min(F.struct(*order)).alias("_first"))
    return numbered(first, ["_first", value]).select(value, "id")


def encoded(rows: DataFrame, value: str, order: list[str], out: str) -> DataFrame:
    """Rows with their value's number in the dictionary instead of the value."""
    known = stored(dictionary(rows, value, order).select(F.struct(value).alias("_v"), F.col("id").alias(out)), "dictionary")
    return rows.withColumn("_v", F.struct(value)).join(broadcast_if_small(known), "_v").drop("_v", value)


def depths(spans: DataFrame, group: list[str], low: str, high: str) -> DataFrame:
    """(group, low, high, depth): stretches covered by the same number of spans, both ends inclusive; a span that ends before it starts is none.

    Starts and ends are counted per point before anything is brought together,
    so a group costs as many rows as it has points, however many spans.
    """
    sound = spans.where(F.col(low) <= F.col(high))
    ends = F.explode(F.array(F.struct(F.col(low).cast("long").alias("at"), F.lit(1).alias("step")), F.struct((F.col(high).cast("long") + 1).alias("at"), F.lit(-1).alias("step")))).alias("e")
    points = sound.select(*group, ends).groupBy(*group, F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step")).where("step <> 0")
    w = W.Window.partitionBy(*group).orderBy("at")
    swept = points.withColumn("depth", F.sum("step").over(w)).withColumn("_next", F.lead("at").over(w))
    return swept.where("depth > 0").select(*group, F.col("at").alias("low"), (F.col("_next") - 1).alias("high"), "depth")


def covered(stretches: DataFrame, group: list[str]) -> DataFrame:
    """(group, low, high, deepest, gap_after): depths joined where they touch, with how much is missing before the next."""
    w = W.Window.partitionBy(*group).orderBy("low")
    new = F.when(F.col("low") - 1 > F.lag("high").over(w), 1).otherwise(0)
    runs = stretches.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    joined = runs.groupBy(*group, "_run").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("depth").alias("deepest"))
    gap = F.lead("low").over(w) - F.col("high") - 1
    return joined.withColumn("gap_after", gap).drop("_run")


def deep_merged(base: Any, over: Any) -> Any:
    """Objects key by key, anything else as the upper layer has it."""
    if isinstance(base, dict) and isinstance(over, dict):
        return base | {k: deep_merged(base[k], v) if k in base else v for k, v in over.items()}
    return over


@F.pandas_udf(T.StringType())
def _folded(layers: pd.Series) -> pd.Series:
    def fold(texts) -> str | None:
        out: Any = None
        for text in texts:
            out = deep_merged(out, json.loads(text))
        return None if out is None else json.dumps(out, ensure_ascii=False, sort_keys=True)

    return layers.map(fold)


def overlaid(layers: DataFrame, key: str, layer: str, settings: str) -> DataFrame:
    """(key, settings): the JSON settings of each key's layers over each other, the highest layer last.

    A layer without settings adds nothing; a list or a value replaces what is
    below it; keys are written in order.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(layer, settings))), lambda x: x[settings])
    return layers.where(F.col(settings).isNotNull()).groupBy(key).agg(ordered.alias("_l")).select(key, _folded("_l").alias(settings))


def setting(settings: Column, path: str) -> Column:
    """One value of merged settings."""
    return F.get_json_object(settings, f"$.{path}")
