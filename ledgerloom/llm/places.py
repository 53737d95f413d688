"""Places and running sums within groups of any size (DataFrame functions only).

A window over a group is one task, however large the group.  Here rows are
dealt to ranges of (group, order) instead, so that a group spreads over as many
tasks as its rows need; each range is counted, and a small table of ranges
tells what stands before it.

Rows that are equal in group and order still go to different ranges, as their
place in the input decides between them; which of them comes first is open.
Groups must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.storage import broadcast_if_small, stored


def ordered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Stored rows in ranges of (group, order), with ``_at``: the range in the upper bits, the place in it in the lower 33.

    ``rows`` should be a stored table, as the cut of the ranges reads it once more.
    """
    by = [group, *order, "_row"]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(dealt.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "ordered")


def _with_runs(rows: DataFrame, group: str, shift: Column, *sums: Column) -> DataFrame:
    """Ordered rows with ``_shift``, worked out from the runs of one group in one range."""
    part = F.shiftright("_at", 33)
    runs = rows.groupBy(group, part.alias("_part")).agg(F.min("_at").alias("_first"), *sums)
    shifts = stored(runs.select(group, "_part", shift.alias("_shift")), "runs")
    return rows.withColumn("_part", part).join(broadcast_if_small(shifts), [group, "_part"])


def _before(group: str, value: str) -> Column:
    """What the ranges before hold: a window over ranges, not over rows."""
    return F.sum(value).over(W.Window.partitionBy(group).orderBy("_part")) - F.col(value)


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with ``place``: from 0 without gaps within each group."""
    found = _with_runs(ordered(rows, group, order), group, _before(group, "_n") - F.col("_first"), F.count(F.lit(1)).alias("_n"))
    return found.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def running(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows with ``before``: the sum of ``value`` over the rows of their group that come before."""
    found = _with_runs(ordered(rows, group, order), group, _before(group, "_sum"), F.sum(value).alias("_sum"))
    own = F.sum(value).over(W.Window.partitionBy(group, "_part").orderBy("_at").rowsBetween(W.Window.unboundedPreceding, 0)) - F.col(value)
    return found.withColumn("before", own + F.col("_shift")).drop("_at", "_part", "_shift")


