"""Search in catalogues of cases and in sheet indexes of films, and counts of what folders hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.normal import flat, search_form
from ledgerloom.plans.answer import SourceUnavailable

# Letters that count as the same in sheet labels, and what marks a file as a part of a volume.
SAME_LETTERS = ("ёєi", "ееи")
PART_NAME = r"(?iu)(?:^|[ _.\-])(?:ч|part|pt)\s*\.?\s*\d+"
#: States in which a candidate waits for a person.
PENDING = ("new", "reviewing")


def sheet_form(c: Column) -> Column:
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), *SAME_LETTERS)


def catalogue_search(rows: DataFrame | None, q: str, limit: int | None = 30) -> DataFrame:
    """Rows of a catalogue (case_no, description, ...) whose description and number hold the query, apostrophes and marks aside.

    Without a catalogue there is nothing to search, which is not the same as
    finding nothing.
    """
    if rows is None:
        raise SourceUnavailable("the catalogue of cases has not been gathered")
    needle = search_form(F.lit(q))
    hits = rows.where((needle != "") & F.contains(search_form(F.concat_ws(" ", "description", "case_no")), needle)).withColumn("description", flat(F.col("description")))
    return hits.orderBy("case_no", "description").limit(limit) if limit else hits


def sheet_search(sheets: DataFrame | None, q: str, limit: int | None = 30) -> DataFrame:
    """Entries of a sheet index (name, start, end, ...) whose name or contents hold the query, with a label made from them."""
    if sheets is None:
        raise SourceUnavailable("no index of sheets is installed")
    needle = sheet_form(F.lit(q.strip()))
    end = F.when(F.col("end").isNull(), "…").when(F.col("end") == F.col("start"), F.lit(None)).otherwise(F.col("end").cast("string"))
    label = F.concat(F.lit("Л. "), F.concat_ws("-", F.col("start").cast("string"), end), F.lit(" - "), F.col("name"))
    hits = sheets.where((needle != "") & F.contains(sheet_form(F.concat_ws(" ", "name", "contents")), needle)).withColumn("label", label)
    return hits.orderBy("film", "start", "name").limit(limit) if limit else hits


def frames_for(sheets: DataFrame, part: str) -> DataFrame:
    """(film, start, end) of the first entry of each film whose name holds some text."""
    hits = sheets.where(F.contains(F.lower("name"), F.lit(part.lower())))
    return hits.groupBy("film").agg(F.min_by(F.struct("start", "end"), "position").alias("e")).select("film", "e.start", "e.end")


def pending(candidates: DataFrame, source: str = "", least: float = 0.0) -> DataFrame:
    """Candidates that wait for a person, best first."""
    rows = candidates.where(F.col("status").isin(*PENDING) & (F.col("score") >= least))
    return (rows.where(F.col("source_id") == source) if source else rows).orderBy(F.desc("score"), "candidate_id")


def best_frames(cases: DataFrame, counted: DataFrame) -> DataFrame:
    """Cases (case_key, paths) with the most frames that any of their folders (path, frames) holds."""
    found = cases.select("case_key", F.explode("paths").alias("path")).join(counted, "path").groupBy("case_key").agg(F.max("frames").alias("frames"))
    return cases.join(found, "case_key", "left").fillna(0, ["frames"])


def volume_pages(files: DataFrame) -> DataFrame:
    """(folder, pages) of folders with PDF files (folder, name, pages): parts are added up, copies count once.

    Parts and whole volumes show the same case, so the larger of the two
    counts; a folder with a file that could not be counted has none.
    """
    part = F.col("name").rlike(PART_NAME)
    sums = files.groupBy("folder").agg(
        F.sum(F.when(part, F.col("pages"))).alias("parts"), F.max(F.when(~part, F.col("pages"))).alias("largest"), F.sum_distinct(F.when(~part, F.col("pages"))).alias("distinct"),
        F.bool_or(F.coalesce(F.col("pages"), F.lit(0)) <= 0).alias("unread"),
    )
    whole = F.when(F.col("parts").isNull(), F.col("distinct")).otherwise(F.greatest("parts", F.coalesce("largest", F.lit(0))))
    return sums.select("folder", F.when(F.col("unread"), 0).otherwise(whole).cast("long").alias("pages"))
