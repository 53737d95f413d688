"""Page notes and records: merging, upserts, partial acceptance, flat exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

COMMENT_CHARS = 600
#: Ranks that a note's status only climbs.
STATUS_RANK = {"unreadable": 0, "skipped": 0, "partial": 1, "full": 2}


def folded_union(old: Column, new: Column) -> Column:
    """Old values, then new ones that differ from all before by more than case."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(old, none), F.coalesce(new, none))
    return F.aggregate(both, none, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def _rank(status: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in STATUS_RANK.items() for x in pair))
    return F.coalesce(F.try_element_at(table, status), F.lit(0))


def merged_notes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New notes over old ones of the same page; lists unite, status never falls, blanks keep what was."""
    o = old.select("case_key", "scan", *(F.col(c).alias(f"_{c}") for c in old.columns if c not in ("case_key", "scan")))
    df = o.join(new, ["case_key", "scan"], "full_outer")
    is_new = F.col("status").isNotNull()
    keep = lambda c: F.when(is_new & (F.coalesce(F.col(c), F.lit("")) != ""), F.col(c)).otherwise(F.coalesce(f"_{c}", c))
    a, b = F.coalesce("_comment", F.lit("")), F.coalesce("comment", F.lit(""))
    # A new comment goes first and an old one that it neither repeats nor is part of stays behind it, as far as there is room.
    both = F.left(F.concat(b, F.lit(" ⟂ "), a), F.lit(COMMENT_CHARS))
    comment = F.when(~is_new | (b == ""), a).when((a == "") | b.contains(a) | a.contains(b), b).otherwise(both)
    status = F.when(~is_new | (F.col("_status").isNotNull() & (_rank(F.col("status")) < _rank(F.col("_status")))), F.col("_status")).otherwise(F.col("status"))
    years = F.array_distinct(F.concat(F.coalesce("_years", F.array().cast("array<int>")), F.coalesce("years", F.array().cast("array<int>"))))
    return df.select(
        "case_key", "scan", F.when(is_new, F.col("page_type")).otherwise(F.col("_page_type")).alias("page_type"), folded_union(F.col("_surnames"), F.col("surnames")).alias("surnames"),
        folded_union(F.col("_places"), F.col("places")).alias("places"), years.alias("years"), keep("sheet").alias("sheet"), status.alias("status"), keep("agent").alias("agent"), comment.alias("comment"),
    )


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones with their key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key, as an aggregate that combines before the shuffle."""
    others = [c for c in rows.columns if c != key]
    top = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("_r"))
    return top.select(key, *(F.col(f"_r.{c}").alias(c) for c in others))


def with_verdicts_kept(old: DataFrame, new: DataFrame, key: str, verdict: str) -> DataFrame:
    """New hits over old ones, human verdicts surviving."""
    kept = old.select(key, F.col(verdict).alias("_v"))
    return new.join(kept, key, "left").withColumn(verdict, F.coalesce("_v", verdict)).drop("_v").unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def accepted_and_rejected(items: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Items that pass all checks, and the others with what they fail."""
    errors = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    judged = items.withColumn("errors", errors)
    return judged.where("size(errors) = 0").drop("errors"), judged.where("size(errors) > 0")


def missing(expected: DataFrame, produced: DataFrame, *key: str) -> DataFrame:
    return expected.join(produced.select(*key), list(key), "left_anti")


def status_counts(expected: DataFrame, notes: DataFrame, *key: str) -> DataFrame:
    """Pages by status of their note, those without one included."""
    return expected.join(notes, list(key), "left").groupBy(F.coalesce("status", F.lit("unnoted")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def flat_records(cases: DataFrame) -> DataFrame:
    """Cases with nested records as one row per person, each with its record's scans."""
    records = cases.select("case_key", F.explode("records").alias("r"))
    return records.select(
        "case_key", F.col("r.rid").alias("rid"), F.col("r.rtype").alias("rtype"), F.array_join("r.scans", "; ").alias("scans"), F.posexplode_outer("r.persons").alias("nth", "p"),
    ).select("case_key", "rid", "rtype", "scans", "nth", F.col("p.role").alias("role"), F.coalesce(F.nullif("p.surname", F.lit("")), F.element_at(F.split(F.trim("p.name"), r"\s+"), -1)).alias("surname"))


def newest_first_pages(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The ``n`` latest rows of each group; Spark prunes each task to n before the shuffle."""
    nth = F.row_number().over(W.Window.partitionBy(group).orderBy(F.desc(order), *[c for c in rows.columns if c not in (group, order)]))
    return rows.withColumn("nth", nth).where(F.col("nth") <= n)


def noted_pages(notes: DataFrame, *key: str) -> DataFrame:
    """Pages noted of each case, and how many of them in full."""
    return notes.groupBy(*key).agg(F.count(F.lit(1)).alias("n_noted"), F.count_if(F.col("status") == "full").alias("n_full"))


def quarantined(dead: DataFrame, failures: DataFrame, key: list[str]) -> DataFrame:
    """Pages set aside with the reason and time of their last failure, and how often they failed.

    ``dead`` and ``failures`` have the key, reason and at; ``dead`` also n.
    """
    rows = dead.select(*key, "reason", "at", "n").unionByName(failures.select(*key, "reason", "at").withColumn("n", F.lit(1).cast("long")))
    return rows.groupBy(*key).agg(F.max_by("reason", "at").alias("reason"), F.max("at").alias("at"), F.sum("n").alias("n"))
