"""Parsing of archive keys, ranges and years into structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Archives by their codes in either script, and funds with rules of their own.
REPOSITORY_ALIASES = {
    "ДАХМО": "DAHMO", "ЦДІАК": "CDIAK", "ЦДІАУК": "CDIAK", "ДАВО": "DAVO", "ДАВІО": "DAVIO", "ДАОО": "DAOO", "ДАЖО": "DAZHO",
    "АНРМ": "ANRM", "ДАЧВО": "DACHVO", "ДАХМЕЛЬНО": "DAHMO",
}
DEFAULT_INVENTORY = {"DAHMO/315": "1", "CDIAK/224": "1", "CDIAK/127": "1076"}
INVENTORY_IN_KEY = ("ANRM/211",)
CASE_LETTERS = ("абвгде", "abvgde")
DASH = r"\s*[-–]\s*"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _part(c: Column, pattern: str, group: int) -> Column:
    """A group of a match, null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it: written out each time, nested patterns would multiply."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repository(c: Column) -> Column:
    """An archive's code in Latin capitals."""
    return once(F.upper(F.trim(F.coalesce(c, F.lit("")))), lambda code: F.coalesce(F.try_element_at(_map(REPOSITORY_ALIASES), code), code))


def case_number(c: Column) -> Column:
    """A number without leading zeros, its letter in Latin; empty becomes null."""
    lettered = f"^[0-9]+[{CASE_LETTERS[0]}]$"
    number = lambda bare: F.when(bare == "", "0").when(bare.rlike(lettered), F.translate(bare, *CASE_LETTERS)).otherwise(bare)
    return once(c, lambda x: F.when(x != "", once(F.regexp_replace(F.lower(F.trim(x)), "^0+", ""), number)))


def case_key(repo: Column, fund: Column, case: Column, inventory: Column) -> Column:
    """REPO/FUND/CASE, with the inventory where a fund numbers each inventory from one."""
    keyed = F.concat_ws("/", repo, fund).isin(*INVENTORY_IN_KEY) & inventory.isNotNull() & ~case.startswith("@")
    return F.when(repo.isNotNull() & fund.isNotNull() & case.isNotNull(), F.concat_ws("/", repo, F.when(keyed, F.concat_ws("-", fund, inventory)).otherwise(fund), case))


def candidate_keys(repo: Column, fund: Column, inventory: Column, case: Column) -> Column:
    """The keys a case may be filed under, with its inventory and without."""
    bare = case_key(repo, fund, case, F.lit(None).cast("string"))
    return F.array_distinct(F.array_compact(F.array(case_key(repo, fund, case, inventory), bare)))


def shelf_mark(c: Column) -> Column:
    """«DAHMO 315-1-8433», «315-1-8433», «Ф. 211 Оп. 3 Д. 140» or a key as (repo, fund, inventory, case)."""
    key = r"^([A-ZА-ЯІЇЄҐ]+)/(\d+)(?:-(\d+))?/(\w+)$"
    dashed = rf"(?iu)^\s*(?:([A-ZА-ЯІЇЄҐ]+)\s+)?(\d+){DASH}(\d+){DASH}(\d+[а-яa-z]?)\s*$"
    spelled = r"(?iu)ф\.?\s*(\d+)\D+оп\.?\s*(\d+)\D+(?:д|спр)\.?\s*(\d+[а-яa-z]?)"
    source = r"^S_([A-Z]+)_F(\d+)(?:_OP(\d+))?_D([0-9A-Za-z]+)$"
    def read(text: Column) -> Column:
        code = F.coalesce(_part(text, key, 1), _part(text, source, 1), _part(text, dashed, 1))
        fund = F.coalesce(_part(text, key, 2), _part(text, source, 2), _part(text, dashed, 2), _part(text, spelled, 1))
        inventory = F.coalesce(_part(text, key, 3), _part(text, source, 3), _part(text, dashed, 3), _part(text, spelled, 2))
        case = F.coalesce(_part(text, key, 4), _part(text, source, 4), _part(text, dashed, 4), _part(text, spelled, 3))
        return F.struct(once(code, lambda x: F.when(x.isNotNull(), repository(x))).alias("repo"), fund.alias("fund"), inventory.alias("inventory"), case_number(case).alias("case"))

    def mark(x: Column) -> Column:
        default = F.try_element_at(_map(DEFAULT_INVENTORY), F.concat_ws("/", x["repo"], x["fund"]))
        inventory = case_number(F.coalesce(x["inventory"], default))
        return F.when(x["fund"].isNotNull() & x["case"].isNotNull(), F.struct(x["repo"].alias("repo"), case_number(x["fund"]).alias("fund"), inventory.alias("inventory"), x["case"].alias("case")))

    return once(c, lambda text: once(read(text), mark))


def split_fund(c: Column) -> Column:
    """«211-3» as (fund 211, inventory 3)."""
    parts = F.split(c, "-", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("fund"), F.nullif(F.get(parts, F.lit(1)), F.lit("")).alias("inventory"))


def leading_int(c: Column) -> Column:
    """The number that a string starts with, else 0: the order of case numbers."""
    return F.coalesce(F.regexp_extract(c, r"^\d+", 0).try_cast("int"), F.lit(0))


def year_of(c: Column) -> Column:
    """The first four characters as a year, else null."""
    return F.substring(F.trim(c), 1, 4).try_cast("int")


def years_span(c: Column) -> Column:
    """Smallest and largest year from 1500 to 2099 in a text."""
    years = F.transform(F.regexp_extract_all(c, F.lit(r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)"), 1), lambda y: y.cast("int"))
    return F.struct(F.array_min(years).alias("year_from"), F.array_max(years).alias("year_to"))


def year_bounds(text: str) -> tuple[int, int] | None:
    """«1850» or «1850-1860» as bounds; anything else is no filter."""
    low, _, high = (text or "").partition("-")
    if not low.strip().isdigit():
        return None
    return int(low), int(high) if high.strip().isdigit() else int(low)


def leaf_range(c: Column) -> Column:
    """«Л. 5-12», «Л. 5-…» or «Л. 5» as (start, end); an open end is null."""
    start = _part(c, r"(?iu)л\.\s*(\d+)", 1).cast("int")
    dashed = c.rlike(r"(?iu)л\.\s*\d+\s*[-–](?!\s)") | c.rlike(r"(?iu)л\.\s*\d+[-–]")
    end = _part(c, r"(?iu)л\.\s*\d+\s*[-–]\s*(\d+)", 1).cast("int")
    return F.when(start.isNotNull(), F.struct(start.alias("start"), F.when(dashed, end).otherwise(start).alias("end")))


def pages_of(c: Column) -> Column:
    """«1-50,60» as the distinct numbers in order."""
    pairs = F.regexp_extract_all(c, F.lit(r"\d+(?:\s*-\s*\d+)?"), 0)
    ends = F.transform(pairs, lambda p: F.transform(F.split(p, r"\s*-\s*"), lambda x: x.cast("int")))
    spans = F.transform(ends, lambda e: F.sequence(F.get(e, F.lit(0)), F.greatest(F.get(e, F.lit(0)), F.element_at(e, -1))))
    return F.array_sort(F.array_distinct(F.flatten(spans)))


def frame_number(c: Column) -> Column:
    return _part(c, r"(\d+)(?!.*\d)", 1).cast("int")


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def era(year: Column) -> Column:
    """25-year periods from 1820 on."""
    return F.greatest(F.lit(0), F.floor((year - 1820) / 25)).cast("int")


def imprecise_date(c: Column) -> Column:
    """«YYYY», «YYYY-MM» or a full date with its precision; never cast to a date."""
    parts = F.size(F.split(c, "-"))
    return F.struct(c.alias("value"), F.when(parts == 1, "year").when(parts == 2, "month").otherwise("day").alias("precision"))


def numbered_id(prefix: str, n: Column) -> Column:
    return F.format_string(f"{prefix}%04d", n)
