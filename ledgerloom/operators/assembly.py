"""Putting a case registry together from layers of evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.operators.registry import coverage_share, fuzzy_stage

#: Share of frames read from which a case counts as complete.
COMPLETE = 0.99


def first_layer_wins(layers: list[DataFrame], key: str) -> DataFrame:
    """Rows of several layers, one per key: the earliest layer's, its empty fields filled from later ones.

    One aggregate over the union: each column takes its first non-empty value
    in order of layers.
    """
    columns = [c for c in layers[0].columns if c != key]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x.withColumn("_layer", F.lit(k)) for k, x in enumerate(layers)])
    value = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(c))
    best = [F.min_by(value(c), F.when(value(c).isNotNull(), F.col("_layer"))).alias(c) for c in columns]
    return rows.groupBy(key).agg(*best, F.min("_layer").alias("layer"))


def resolved(runs: DataFrame, channels: list[DataFrame], key: str = "run") -> DataFrame:
    """(run, case_key, channel): the first channel that names a case; runs that none names stay, unresolved.

    Each channel is (run, case_key) with at most one row per run.
    """
    tagged = reduce(DataFrame.unionByName, [c.select(key, "case_key", F.lit(k).alias("channel")) for k, c in enumerate(channels)])
    best = tagged.where("case_key is not null").groupBy(key).agg(F.min(F.struct("channel", "case_key")).alias("b"))
    return runs.join(best, key, "left").select(*runs.columns, F.col("b.case_key").alias("case_key"), F.col("b.channel").alias("channel"))


def number_candidates(name: Column) -> Column:
    """Consecutive triples, then pairs, of the numbers in a name: what may be fund, inventory and case."""
    n = F.regexp_extract_all(name, F.lit(r"\d+"), 0)

    def runs_of(size: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(n)), lambda i: i + size <= F.size(n))
        return F.transform(starts, lambda i: F.array_join(F.array(*(F.get(n, i + k) for k in range(size))), "-"))

    return F.concat(runs_of(3), runs_of(2))


def longest_prefix(paths: DataFrame, targets: DataFrame, path: str = "path", target: str = "target") -> DataFrame:
    """Each path with the longest target that is the path or a folder above it.

    A path has few folders above it, so each is looked up by equality instead
    of comparing all paths with all targets.
    """
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    exploded = paths.withColumn("_above", F.explode(above))
    found = exploded.join(targets.select(F.col(target).alias("_above")).distinct(), "_above")
    best = found.groupBy(path).agg(F.max_by("_above", F.length("_above")).alias(target))
    return paths.join(best, path, "left")


def uncovered(paths: DataFrame, known: DataFrame, path: str = "path") -> DataFrame:
    """Paths that are neither known nor inside a known folder."""
    return longest_prefix(paths, known.select(F.col(path).alias("_known")), path, "_known").where("_known is null").drop("_known")


def with_reading(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Cases with how much of them has been read: most pages of any run, its stage, and the runs' names.

    ``runs`` has case_key, run, engine, pages and updated.
    """
    read = runs.where("case_key is not null").groupBy("case_key").agg(F.max("pages").alias("pages_max"), F.max("updated").alias("read_at"), F.array_sort(F.collect_set("engine")).alias("engines"), F.count(F.lit(1)).alias("n_runs"))
    df = cases.join(read, "case_key", "left").fillna(0, ["pages_max", "n_runs"])
    share = coverage_share(F.col("pages_max"), F.col("frames"))
    stage = F.when(F.col("n_runs") == 0, "none").when(share < COMPLETE, "partial").when(F.size("engines") > 1, "both").otherwise(F.get("engines", F.lit(0)))
    return df.withColumns({"coverage": F.bround(share, 4), "read_stage": stage})


def with_search_state(cases: DataFrame, searches: DataFrame) -> DataFrame:
    """Cases with the state of their searches (case_key, scanned, reviewed, swept)."""
    best = searches.groupBy("case_key").agg(F.bool_or("scanned").alias("_scanned"), F.max("reviewed").alias("reviewed"), F.bool_or("swept").alias("_swept"))
    no = F.lit(False)
    df = cases.join(best, "case_key", "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(0)))
    return df.withColumn("search_stage", fuzzy_stage(F.coalesce("_scanned", no), F.col("reviewed"), F.coalesce("_swept", no))).drop("_scanned", "_swept")


def page_share(pages: DataFrame, order: list[str], shard: int, shards: int, partition: list[str]) -> DataFrame:
    """Every n-th page, counted from ``shard``, within each partition."""
    nth = F.row_number().over(W.Window.partitionBy(*partition).orderBy(*order)) - 1
    return pages.withColumn("_nth", nth).where(F.col("_nth") % shards == shard).drop("_nth")


def name_ranges(names: DataFrame, group: str, name: str) -> DataFrame:
    """Names that differ in one counting number as ranges: (prefix, suffix, first, last, n)."""
    pattern = r"^(.*?)(\d+)(\D*)$"
    parts = names.select(group, *(F.regexp_extract(name, pattern, k).alias(c) for k, c in ((1, "prefix"), (2, "number"), (3, "suffix")))).where("number <> ''").distinct()
    w = W.Window.partitionBy(group, "prefix", "suffix").orderBy("_n")
    df = parts.withColumn("_n", F.col("number").cast("long")).withColumn("_i", F.col("_n") - F.row_number().over(w))
    return df.groupBy(group, "prefix", "suffix", "_i").agg(F.min("_n").alias("first"), F.max("_n").alias("last"), F.count(F.lit(1)).alias("n")).drop("_i")


def merged_shards(metas: DataFrame, key: str = "run") -> DataFrame:
    """Runs from the metadata of their shards (run, shard, started, done, failed, pages): later shards win a page."""
    pages = metas.select(key, "shard", F.explode("pages").alias("scan", "page")).groupBy(key, "scan").agg(F.max_by("page", "shard").alias("page"))
    read = pages.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("scan", "page")))).alias("pages"))
    whole = metas.groupBy(key).agg(F.min("started").alias("started"), F.bool_and("done").alias("done"), F.array_distinct(F.flatten(F.collect_list("failed"))).alias("_failed"))
    out = whole.join(read, key, "left")
    return out.select(key, "started", "done", F.array_except("_failed", F.coalesce(F.map_keys("pages"), F.array().cast("array<string>"))).alias("failed"), "pages")
