"""Ranges of a key with about equal bytes, the same for the same rows every time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewest histogram cells on the first level, beyond 16 for each range that is wanted.
LEAST_CELLS = 1024
#: Ranges beyond which they grow with the input instead: each is a task and at least one file.
MOST_RANGES = 50_000


@dataclass(frozen=True)
class Ranges:
    """``count`` shards in key order; a key heavier than a shard is split by a tie-breaking hash."""

    starts: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    count: int

    def shard(self, key: Column, tie: Column) -> Column:
        """The shard of a key and an unsigned 32-bit tie; rows without a key go to the first."""
        starts, first, parts = self.starts, self.first, self.parts

        @F.pandas_udf("int")
        def of(keys: pd.Series, ties: pd.Series) -> pd.Series:
            at = np.maximum(np.searchsorted(starts, keys.to_numpy(np.int64), "right") - 1, 0)
            return pd.Series(first[at] + ((ties.to_numpy(np.int64) * parts[at]) >> 32)).astype("int32")

        return of(F.coalesce(key.cast("long"), F.lit(int(starts[0]))), tie.cast("long"))


@dataclass(frozen=True)
class _Cells:
    """Equal-width cells of some ranges of the key that do not overlap, numbered through."""

    lows: np.ndarray
    highs: np.ndarray
    wanted: np.ndarray

    def of(self, key: Column) -> Column:
        """The cell of a key, null outside all ranges."""
        lows, highs, wanted, first = self.lows, self.highs, self.wanted, np.cumsum(self.wanted) - self.wanted

        @F.pandas_udf("long")
        def numbered(keys: pd.Series) -> pd.Series:
            k = keys.to_numpy(np.int64)
            at = np.maximum(np.searchsorted(lows, k, "right") - 1, 0)
            width = highs[at].astype(np.float64) - lows[at].astype(np.float64) + 1
            cell = np.minimum((k.astype(np.float64) - lows[at].astype(np.float64)) / width * wanted[at], wanted[at] - 1)
            inside = (k >= lows[at]) & (k <= highs[at])
            return pd.Series(first[at] + np.maximum(cell, 0).astype(np.int64)).where(inside)

        return numbered(key)

    def weighed(self, rows: DataFrame) -> list:
        """(lo, hi, weight) of every cell that has keys, by one pass over the rows."""
        found = rows.withColumn("cell", self.of(F.col("key"))).where("cell is not null").groupBy("cell")
        return found.agg(F.sum("weight").alias("weight"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()


def balanced_ranges(rows: DataFrame, target: int, most: int = MOST_RANGES) -> Ranges:
    """Cut the keys of ``rows`` (key long, weight long) into ranges of about ``target`` weight, or more if ``most`` would not do.

    Counts weights in equal-width cells over all rows and looks closer only
    into cells that outweigh a range, all of them in one narrow pass for each
    level, so clustered keys cost another pass, not a lopsided cut.  What the
    driver sees is cells, a small multiple of the number of ranges.  Nothing is
    sampled, so the cut is reproducible.
    """
    rows = rows.where(F.col("key").isNotNull())
    lo, hi, total = rows.agg(F.min("key"), F.max("key"), F.sum("weight")).first()
    if total is None:
        return Ranges(np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, np.int64), 1)
    target = max(target, -(-total // most))
    done: list[tuple[int, int]] = []
    heavy = [(lo, hi, total)]
    while heavy:
        heavy.sort()
        lows, highs = (np.array([h[k] for h in heavy], np.int64) for k in (0, 1))
        wanted = np.array([max(LEAST_CELLS if len(heavy) == 1 else 16, 16 * (w // target + 1)) for *_, w in heavy], np.int64)
        before = {h[:2] for h in heavy}
        heavy = []
        for r in _Cells(lows, highs, wanted).weighed(rows):
            if r["weight"] > target and r["hi"] > r["lo"] and (r["lo"], r["hi"]) not in before:
                heavy.append((r["lo"], r["hi"], r["weight"]))
            else:
                done.append((r["lo"], r["weight"]))
    starts, first, parts, filled, shards = [], [], [], target, 0
    for key, weight in sorted(done):
        if weight >= 2 * target:
            n = -(-weight // target)
            starts.append(key), first.append(shards), parts.append(n)
            shards, filled = shards + n, target
        elif filled + weight > target:
            starts.append(key), first.append(shards), parts.append(1)
            shards, filled = shards + 1, weight
        else:
            filled += weight
    return Ranges(np.array(starts, np.int64), np.array(first, np.int64), np.array(parts, np.int64), shards)
