"""Search in what people have noted on pages and taken down as records."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.normal import archival_form
from ledgerloom.operators.decode import TOKEN, scored_hits
from ledgerloom.plans.answer import Answer

LEAST_LETTERS = 3


def stems_of(spark: SparkSession, q: str) -> list[str]:
    """The words of a query in the form that names are compared in; short ones say too little."""
    words = [w for w in re.findall(TOKEN, q) if len(w) >= LEAST_LETTERS]
    if not words:
        return []
    row = spark.range(1).select(F.array(*(archival_form(F.lit(w)) for w in words)).alias("s")).first()
    return [s for s in row["s"] if len(s) >= LEAST_LETTERS]


def _ranked(named: DataFrame, q: str, least: int, limit: int | None, *order: str) -> DataFrame:
    """Rows whose ``matched`` resembles the query, best first."""
    normal = named.withColumn("norm", archival_form(F.col("matched")))
    # Scores are rounded before they are compared with the threshold.
    hits = scored_hits(normal, stems_of(named.sparkSession, q), least - 0.5).withColumn("score", F.bround("_s", 0).cast("int")).where(F.col("score") >= least).drop("_s", "norm")
    ranked = hits.orderBy(F.desc("score"), *order)
    return ranked.limit(limit) if limit else ranked


def search_notes(notes: DataFrame, q: str, least: int = 80, places: bool = False, limit: int | None = 200) -> DataFrame:
    """Pages whose noted surnames, or places, resemble the query.

    ``notes`` has case_key, scan, page_type, status, comment, surnames and places.
    """
    named = notes.select("case_key", "scan", "page_type", "status", "comment", F.explode("places" if places else "surnames").alias("matched"))
    return _ranked(named, q, least, limit, "case_key", "scan", "matched")


def search_records(records: DataFrame, q: str, least: int = 80, role: str = "", rtype: str = "", limit: int | None = 200) -> DataFrame:
    """Persons of records whose surname, or last word of their name, resembles the query.

    ``records`` has case_key, rid, rtype, date, scans and persons, these with
    role, name and surname.
    """
    people = records.where(F.lit(not rtype) | (F.col("rtype") == rtype)).select("case_key", "rid", "rtype", "date", "scans", F.explode("persons").alias("p"))
    last = F.try_element_at(F.filter(F.split(F.coalesce("p.name", F.lit("")), r"\s+"), lambda w: w != ""), F.lit(-1))
    named = people.where(F.lit(not role) | (F.col("p.role") == role)).select("case_key", "rid", "rtype", "date", "scans", F.col("p.role").alias("role"), F.col("p.name").alias("name"), F.coalesce(F.nullif("p.surname", F.lit("")), last).alias("matched"))
    return _ranked(named.where("matched <> ''"), q, least, limit, "case_key", "rid", "name")


def searched(hits: DataFrame, material: DataFrame, source: str, group: str = "case_key") -> Answer:
    """Hits with what was gone through for them: how many cases or runs, and how many rows of them.

    No hits are no proof of absence, and the warning says over how much.
    """
    n = material.agg(F.count_distinct(group).alias("groups"), F.count(F.lit(1)).alias("denominator")).first()
    spark = material.sparkSession
    rows = [(source, "all", "", n["denominator"], True), (source, "groups", group, n["groups"], True)]
    coverage = spark.createDataFrame(rows, "source string, dim string, value string, denominator long, searched boolean")
    warnings = [f"{source}: nothing in {n['groups']} {group}s, {n['denominator']} rows; what has not been read was not searched"] if hits.isEmpty() else []
    return Answer(hits, coverage, warnings)
