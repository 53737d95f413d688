"""Answers that say what they were computed over.

An empty answer means something only with its coverage: which sources were
searched, as of when, out of how many rows.  A source that cannot be searched
refuses instead of adding nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SourceUnavailable(Exception):
    """A source that cannot be searched, which is not the same as one without hits."""


@dataclass(frozen=True)
class Answer:
    rows: DataFrame
    coverage: DataFrame
    warnings: list[str] = field(default_factory=list)

    def zero_means_nothing_found(self) -> bool:
        """Whether an empty answer rests on rows that were really searched."""
        return bool(self.coverage.where("searched and denominator > 0").limit(1).count())


def coverage_of(rows: DataFrame, source: str, *dims: str) -> DataFrame:
    """Coverage rows of a searched source: its size as a whole and by each dimension."""
    whole = rows.groupBy().agg(F.count(F.lit(1)).alias("denominator")).select(F.lit(source).alias("source"), F.lit("all").alias("dim"), F.lit("").alias("value"), "denominator")
    for d in dims:
        part = rows.groupBy(F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("denominator"))
        whole = whole.unionByName(part.select(F.lit(source).alias("source"), F.lit(d).alias("dim"), "value", "denominator"))
    return whole.withColumn("searched", F.lit(True))


def federated(searches: dict[str, object]) -> Answer:
    """Union of several sources' answers; those that refuse are listed as unsearched."""
    rows, coverage, warnings = None, None, []
    spark = None
    refused = []
    for name, search in searches.items():
        try:
            one = search()
        except SourceUnavailable as e:
            warnings.append(f"{name}: {e}")
            refused.append((name, str(e)))
            continue
        spark = one.rows.sparkSession
        tagged = one.rows.withColumn("origin", F.lit(name))
        rows = tagged if rows is None else rows.unionByName(tagged, allowMissingColumns=True)
        coverage = one.coverage if coverage is None else coverage.unionByName(one.coverage)
    if rows is None:
        raise SourceUnavailable("; ".join(warnings))
    if refused:
        missing = spark.createDataFrame([(n, "all", "", None, False) for n, _ in refused], "source string, dim string, value string, denominator long, searched boolean")
        coverage = coverage.unionByName(missing)
    return Answer(rows, coverage, warnings)
