"""Case registry and fund inventories: filters, computed status, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import leading_int, year_bounds
from ledgerloom.functions.normal import loose_form


def year_overlap(low: Column, high: Column, years: str) -> Column:
    """Rows whose years, each bound standing in for the other, meet a range; rows without years do not."""
    bounds = year_bounds(years)
    if bounds is None:
        return F.lit(True)
    return F.coalesce((F.coalesce(low, high) <= bounds[1]) & (F.coalesce(high, low) >= bounds[0]), F.lit(False))


def registry_rows(rows: DataFrame, equal: dict[str, object] | None = None, like: str = "", over: tuple[str, ...] = (), years: str = "") -> DataFrame:
    """Registry selection in shelf order: equalities, a pattern over some columns, years."""
    for name, value in (equal or {}).items():
        rows = rows.where(F.col(name) == value)
    if like:
        hit = F.lit(False)
        for name in over:
            hit = hit | F.coalesce(F.lower(name).like(f"%{like.lower()}%"), F.lit(False))
        rows = rows.where(hit)
    if years:
        rows = rows.where(year_overlap(F.col("year_from"), F.col("year_to"), years))
    return rows.orderBy("repo_label", leading_int(F.col("fund")), leading_int(F.col("case")), "case")


def fund_status(rows: DataFrame, live: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Inventory rows with where their scans are, flags, and conflicts.

    ``live`` has (inventory, case, path); ``conflicts`` one row per disagreement.
    """
    counted = conflicts.groupBy("inventory", "case").agg(F.count(F.lit(1)).alias("n_conflicts"))
    df = rows.join(live.select("inventory", "case", "path"), ["inventory", "case"], "left").join(counted, ["inventory", "case"], "left")
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    state = F.when(F.col("path").isNotNull(), "disk").when(has("commons_url"), "todo").when(has("mirror_url"), "mirror_only").otherwise("order")
    flags = {
        "truncated": has("truncated_mirror"), "interp": F.col("num_src") == "interp", "lo": F.col("page_quality") == "lo", "title_conflict": has("title_alt"),
        "no_title": ~has("title"), "letter": has("spr_letter"),
    }
    listed = F.array_compact(F.array(*(F.when(cond, F.lit(name)) for name, cond in flags.items())))
    mismatch = F.coalesce(F.col("on_disk") != F.col("path").isNotNull(), F.lit(False))
    return df.withColumns({"state": state, "flags": listed, "mismatch": mismatch, "n_conflicts": F.coalesce("n_conflicts", F.lit(0))})


def fund_filter(rows: DataFrame, q: str = "", district: str = "", state: str = "", flags: tuple[str, ...] = (), years: str = "") -> DataFrame:
    """Rows of fund_status by text, district (loosely spelled), state, all of some flags, and years."""
    if q:
        text = F.lower(F.concat_ws(" ", "title", "title_alt", "commons_title", "surnames"))
        rows = rows.where(text.contains(q.lower()))
    if district:
        rows = rows.where(loose_form(F.col("district")).contains(F.lit(district.lower().translate({ord("і"): "и", ord("ї"): "и", ord("ь"): None}))))
    if state == "scan":
        rows = rows.where("commons_url <> '' or mirror_url <> ''")
    elif state:
        rows = rows.where(F.col("state") == state)
    if flags:
        rows = rows.where(F.size(F.array_except(F.array(*map(F.lit, flags)), "flags")) == 0)
    if bounds := year_bounds(years):
        low = F.col("year_from").try_cast("int")
        rows = rows.where((low <= bounds[1]) & (F.coalesce(F.col("year_to").try_cast("int"), low) >= bounds[0]))
    return rows


def summary(rows: DataFrame, conditions: dict[str, Column], *by: str) -> DataFrame:
    """Any number of conditional counts in one pass."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in conditions.items()))


def facets(rows: DataFrame, *dims: str) -> DataFrame:
    """Value counts of several columns in one pass over the rows."""
    each = F.array(*(F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value")) for d in dims))
    return rows.select(F.explode(each).alias("f")).groupBy("f.dim", "f.value").count().withColumnRenamed("count", "n")


def frequent(rows: DataFrame, column: str, k: int) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def coverage_share(pages: Column, frames: Column) -> Column:
    return F.when((pages > 0) & (frames > 0), F.least(F.lit(1.0), pages / frames)).otherwise(0.0)


def fuzzy_stage(scanned: Column, reviewed: Column, swept: Column) -> Column:
    return F.when(swept, "swept").when(reviewed > 0, "reviewed").when(scanned, "scanned").otherwise("none")


def orphans(runs: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """Runs that no case claims, a state of their own and not dropped."""
    return runs.join(cases.select(key), key, "left_anti")


def having(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Rows that some other row belongs to, each once."""
    return rows.join(others.select(key), key, "left_semi")


#: Most pages that a range of a citation may span beyond its first.
MOST_RANGE = 300


def cited_scans(page: Column, *texts: Column) -> Column:
    """Numbers of the scans that a citation names: its page or range, and lists after the word scan in any text.

    A range that is empty, backwards or too wide counts as its first page.
    Years are no scans.
    """
    ends = F.transform(F.regexp_extract_all(F.regexp_extract(page, r"^\s*(\d{1,5}(?:\s*[-–]\s*\d{1,5})?)\s*$", 1), F.lit(r"\d+"), 0), lambda x: x.cast("int"))
    low, high = F.get(ends, F.lit(0)), F.try_element_at(ends, F.lit(-1))
    span = F.when(F.size(ends) == 0, F.array().cast("array<int>")).when((high > low) & (high - low <= MOST_RANGE), F.sequence(low, F.greatest(low, high))).otherwise(F.array(low))
    lists = F.regexp_extract_all(F.concat_ws(" ", page, *texts), F.lit(r"(?iu)скан[иі]?\s*([0-9,\s/і-]{3,40})"), 1)
    numbers = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(r"[0-9]{3,5}"), 0)))
    said = F.filter(numbers, lambda x: ~((F.length(x) == 4) & x.cast("int").between(1700, 2100)))
    return F.array_union(span, F.transform(said, lambda x: x.cast("int")))


def canon_counts(citations: DataFrame) -> DataFrame:
    """Citations, persons and distinct scans of each source, of (source, person, page, quote, note)."""
    named = citations.where("source <> ''")
    people = named.groupBy("source").agg(F.count(F.lit(1)).alias("n_facts"), F.count_distinct(F.nullif("person", F.lit(""))).alias("n_persons"))
    scans = named.select("source", F.explode(cited_scans(F.col("page"), F.col("quote"), F.col("note"))).alias("scan")).groupBy("source").agg(F.count_distinct("scan").alias("n_scans"))
    return people.join(scans, "source", "left").fillna(0, ["n_scans"])
