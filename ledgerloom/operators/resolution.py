"""Which case a decoding run, a path or a person's spelling of a shelf mark belongs to.

Names and paths become candidates (repo, fund, inventory, case) by column
expressions; candidates meet the library by equality joins, and a name counts
only if it leaves no choice.  What stays unresolved is a state, not a loss.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.keys import case_key, case_number, repository, shelf_mark
from ledgerloom.operators.assembly import longest_prefix
from ledgerloom.storage import small_tasks, stored

# Archives named in runs, genres that years are glued to, and what derived runs are called.
HINTS = {"dazho": "DAZHO", "dahmo": "DAHMO", "davo": "DAVO", "davio": "DAVO", "cdiak": "CDIAK", "anrm": "ANRM", "daoo": "DAOO", "kostel": "KOSTEL", "csamm": "CSAMM"}
GENRES = ("spov", "met", "rev", "rec", "posim", "kazky", "sud", "klir")
DERIVED = ("-review", "-rescue", "-queued", "-diak_v4", "-churro", "-parseq", "-test", "-skryba", "-probe", "-v5probe", "-v6probe")
MODEL_TAILS = (r"pysar[_a-z]*", r"skryba[_a-z0-9]*", r"diak[_a-z]*", r"v\d+[a-z]*")
SERVICE_FOLDERS = ("pages", "images", "scans", "jpg", "jpeg", "img", "frames")
SKIPPED_FOLDERS = ("davo_opysy", "dahmo_319_f65_opisy", "bev_pdh", "kev_pdh", "khev_pdh", "eev_pdh", "_console_pages")
CATALOGUE_FOLDER, CATALOGUE_REPO = "dahmo_archium", "DAHMO"
# How strongly sources describe a case.
STRENGTH = {
    "canonical": 100, "davo_catalog": 90, "catalog_md": 90, "klirovi_index": 85, "source_json": 80, "meta_json": 75, "archium_catalog": 70,
    "fs_titleread": 65, "wikisource": 60, "opys_tsv": 50, "fs_master": 40, "code": 0,
}
YEARS = (1500, 2100)
#: How often the base of a derived name is derived itself.
DEPTH = 3

_LETTER = "[a-zа-яA-ZА-Я]"


class Convention(NamedTuple):
    """How folders in some place of a path are named, and by its named groups what such a name says."""

    place: str
    pattern: str
    #: The archive that names its folders so; it is said too, and where another one is said the convention is not heard.
    archive: str | None = None

    @property
    def fields(self) -> tuple[str, ...]:
        return tuple(re.compile(self.pattern).groupindex)


# The conventions of folder names, the strongest first.
PATH_CONVENTIONS = (
    Convention("first", r"^(?P<repo>[a-z]+)_(?P<fund>\d+)(?:[_-][a-z0-9]+)*$"),
    Convention("first", r"^(?P<repo>[^\W\d_]+)(?:_|$)"),
    Convention("between", r"^(?P<repo>[a-z]+)_(?P<fund>\d+)(?:[_-][a-z0-9]+)*$"),
    Convention("last", r"(?i)^0*1?0*(?P<fund>\d{3,4})[-_](?P<inventory>\d+)[-_]0*(?P<case>\d+[а-яa-z]?)", archive="DAVO"),
    Convention("between", r"(?i)^f(?P<fund>\d+)(?:[_-]op(?P<inventory>\d+))?$"),
    Convention("last", r"(?i)(?:^|[-_])op(?P<inventory>\d+)"),
    Convention("last", r"(?i)spr[-_]?0*(?P<case>\w+?)$"),
    Convention("last", r"^(?P<case>\d+)$"),
    Convention("last", r"(?i)(?P<fund>\d+)\s*[-–]\s*(?P<inventory>\d+)\s*[-–]\s*(?P<case>\d+[а-яa-z]?)"),
)
SLUG_CONVENTIONS = (
    Convention("first", r"(?i)^(?P<repo>[a-z]+)_(?:\d+)(?:_[a-z]+)?$"),
    Convention("leaf", r"(?i)^m(?P<fund>\d+)[-_](?P<inventory>\d+)[-_](?P<case>\d+)$"),
    Convention("first", r"(?i)^[a-z]+_(?P<fund>\d+)(?:_[a-z]+)?$"),
    Convention("leaf", r"(?i)(?:^|[-_])(?:spr|m)[-_]?0*(?P<case>\d+[a-zа-я]?)"),
)
MARK = ("repo", "fund", "inventory", "case")
#: Of the conventions that say one of these, only the first is heard, and nothing else of the others.
SAID_ONCE = ("repo", "case")


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def strength(source: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in STRENGTH.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.coalesce(source, F.lit("code"))), F.lit(0))


def name_tokens(name: Column) -> Column:
    return F.filter(F.split(F.trim(name), r"[-_\s]+"), lambda t: t != "")


def repository_hint(tokens: Column) -> Column:
    """The archive that the first telling token names."""
    table = F.create_map(*(F.lit(x) for pair in HINTS.items() for x in pair))
    return F.get(F.array_compact(F.transform(tokens, lambda t: F.try_element_at(table, F.lower(t)))), F.lit(0))


# The years that are no number when glued to a genre, and how an archive writes its funds in front.
GLUED_YEAR = rf"(?<!\d)0*(?:1[5-9]\d\d|20\d\d|2100)(?:{_LETTER}|(?!\d))"
LONG_FUND = rf"(?<!\d)(?=\d{{5}})0+1?0*(\d{{3,4}})(?!\d|{_LETTER})"


def name_numbers(tokens: Column) -> Column:
    """Numbers of a name that may be funds, inventories or cases, without leading zeros.

    What is no number of that kind is written over first, a year glued to a
    genre by nothing and 0109 04 by fund 904; then the numbers are read off.
    """
    genre, digits, fund = rf"(?i)^(?:{'|'.join(GENRES)})", r"^\d+$", r"(?i)^f(\d+)$"
    yearless = lambda t: F.when(t.rlike(genre) & ~t.rlike(digits), F.regexp_replace(t, GLUED_YEAR, " ")).otherwise(t)
    written = F.transform(tokens, lambda t: F.when(t.rlike(fund), t).otherwise(F.regexp_replace(yearless(t), LONG_FUND, "$1")))
    read = F.regexp_extract_all(F.array_join(written, " "), F.lit(rf"\d+{_LETTER}?"), 0)
    return F.transform(read, lambda n: F.regexp_replace(F.lower(n), "^0+(?=.)", ""))


def name_candidates(numbers: Column) -> Column:
    """Neighbouring triples as fund, inventory and case, then neighbouring pairs as fund and case; in order of trust."""
    nothing = F.lit(None).cast("string")
    at = lambda i, k: F.get(numbers, i + k)
    places = F.transform(numbers, lambda _, i: i)
    triples = F.transform(F.filter(places, lambda i: i + 2 < F.size(numbers)), lambda i: F.struct(at(i, 0).alias("fund"), at(i, 1).alias("inventory"), at(i, 2).alias("case")))
    pairs = F.transform(F.filter(places, lambda i: i + 1 < F.size(numbers)), lambda i: F.struct(at(i, 0).alias("fund"), nothing.alias("inventory"), at(i, 1).alias("case")))
    return F.concat(triples, pairs)


def derived_base(name: Column) -> Column:
    """The run that a derived run's name builds on, null if it is not derived."""
    endings = "|".join([*map(re.escape, DERIVED), rf"(?i:-(?:{'|'.join(MODEL_TAILS)}))"])
    return _found(name, rf"^(.+)(?:{endings})$")


def path_parts(path: Column) -> Column:
    """Folders of a path below its folder of raw material, if it has one."""
    parts = F.filter(F.split(F.trim(path), r"[\\/]+"), lambda p: p != "")
    raw = F.array_position(parts, "raw").cast("int")
    return F.when(raw > 0, F.slice(parts, raw + 1, F.greatest(F.lit(0), F.size(parts) - raw))).otherwise(parts)


def _folder(place: str, pattern: str) -> Column:
    """The folder at a place of ``_parts`` that is named by a pattern, null if there is none."""
    last = F.regexp_replace(F.try_element_at("_parts", F.lit(-1)), r"(?i)\.(?:pdf|jpe?g|png)$", "")
    inside = F.lower(F.try_element_at("_parts", F.lit(-1))).isin(*SERVICE_FOLDERS) & (F.size("_parts") > 2)
    if place == "between":
        return F.get(F.filter("_parts", lambda p, i: (i > 0) & (i + 1 < F.size("_parts")) & p.rlike(pattern)), F.lit(0))
    one = {"first": F.get("_parts", F.lit(0)), "last": last, "leaf": F.when(inside, F.try_element_at("_parts", F.lit(-2))).otherwise(F.try_element_at("_parts", F.lit(-1)))}[place]
    return F.when(one.rlike(pattern), one)


def with_said(rows: DataFrame, path: str, conventions: tuple[Convention, ...], out: str) -> DataFrame:
    """Rows with what a path's folders say by some conventions, as (repo, fund, inventory, case), null if that is no case.

    Each field has the value that the first convention says which is heard.
    """
    java = [c.pattern.replace("(?P<", "(?<").replace(r"[^\W\d_]", r"\p{L}") for c in conventions]
    df = rows.withColumn("_parts", path_parts(F.col(path)))
    df = df.withColumns({f"_f{k}": _folder(c.place, java[k]) for k, c in enumerate(conventions)})
    words = {k: {f: _found(F.col(f"_f{k}"), java[k], re.compile(c.pattern).groupindex[f]) for f in c.fields} for k, c in enumerate(conventions)}
    archive = F.lit(None).cast("string")
    heard: dict[int, Column] = {}
    for k, c in enumerate(conventions):
        rivals = [heard[j] for j in heard if any(f in SAID_ONCE and f in conventions[j].fields for f in c.fields)]
        ok = F.col(f"_f{k}").isNotNull() & ~reduce(Column.__or__, rivals, F.lit(False))
        if c.archive:
            ok = ok & (archive.isNull() | (archive == c.archive))
        df, heard[k] = df.withColumn(f"_h{k}", ok), F.col(f"_h{k}")
        if "repo" in c.fields:
            archive = F.coalesce(archive, F.when(heard[k], repository(words[k]["repo"])))
    said = {f: F.coalesce(*(F.when(heard[k], w[f]) for k, w in words.items() if f in w)) for f in MARK}
    own = F.coalesce(*(F.when(heard[k], F.lit(c.archive)) for k, c in enumerate(conventions) if c.archive), F.lit(None).cast("string"))
    fields = {"repo": F.coalesce(F.when(said["repo"].isNotNull(), repository(said["repo"])), own)} | {f: case_number(said[f]) for f in MARK[1:]}
    df = df.withColumns({f"_{f}": c for f, c in fields.items()})
    whole = F.col("_repo").isNotNull() & F.col("_fund").isNotNull() & F.col("_case").isNotNull()
    df = df.withColumn(out, F.when(whole, F.struct(*(F.col(f"_{f}").alias(f) for f in MARK))))
    return df.drop("_parts", *(f"_{f}" for f in MARK), *(f"_{x}{k}" for x in "fh" for k in range(len(conventions))))


def with_case_of_path(rows: DataFrame, path: str, out: str = "mark") -> DataFrame:
    """Rows with the case that the conventions of folder names say; folders of catalogues and of what is no material say none."""
    top = F.get(path_parts(F.col(path)), F.lit(0))
    df = rows.withColumn("_said_of", F.when(~top.isin(*SKIPPED_FOLDERS, CATALOGUE_FOLDER), F.col(path)))
    return with_said(df, "_said_of", PATH_CONVENTIONS, out).drop("_said_of")


def with_case_of_slug(rows: DataFrame, path: str, out: str = "mark") -> DataFrame:
    """Rows with their case where the first folder is ARCHIVE_FUND_something or frames lie in a folder of their own."""
    deep = F.when(F.size(path_parts(F.col(path))) >= 2, F.col(path))
    return with_said(rows.withColumn("_said_of", deep), "_said_of", SLUG_CONVENTIONS, out).drop("_said_of")


def catalogue_number(folder: Column) -> Column:
    """The catalogue's own number of a case, which a folder spr_NUMBER of a download carries; it is no case number."""
    return _found(folder, r"(?i)^(?:f\d+[_-])?spr[_-](\d+)$")


def looked_up(candidates: DataFrame, library: DataFrame, key: str) -> DataFrame:
    """(key, turn, level, case_key) of candidates (key, turn, repo, fund, inventory, case) that leave no choice in the library.

    A candidate with an inventory is looked up with it first (level 0).  Of
    several cases those of the archive hinted at count, if there are any, and
    of those the one that is described most strongly; a tie is no answer.  A
    candidate without a fund is looked up by its case number alone.
    """
    lib = library.select("case_key", F.col("repo").alias("_repo"), case_number(F.col("fund")).alias("_fund"), case_number(F.col("inventory")).alias("_inventory"), case_number(F.col("case")).alias("_case"), strength(F.col("desc_source")).alias("_strength"))
    by_fund = candidates.where("fund is not null").join(lib, (F.col("fund") == F.col("_fund")) & (F.col("case") == F.col("_case")))
    alone = candidates.where("fund is null").join(lib, F.col("case") == F.col("_case"))
    found = by_fund.unionByName(alone)
    levels = F.when(F.coalesce(F.col("inventory") == F.col("_inventory"), F.lit(False)), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    found = found.withColumn("level", F.explode(levels)).withColumn("_ours", F.coalesce(F.col("repo") == F.col("_repo"), F.lit(False)))
    alike = found.groupBy(key, "turn", "level", "_ours", "_strength").agg(F.count_distinct("case_key").alias("_n"), F.min("case_key").alias("case_key"))
    best = alike.groupBy(key, "turn", "level").agg(F.max(F.struct("_ours", "_strength", "_n", "case_key")).alias("b")).where("b._n = 1")
    return best.select(key, "turn", "level", "b.case_key")


def without_junction(rows: DataFrame, junctions: DataFrame, path: str) -> DataFrame:
    """Rows with ``path`` as it is behind the longest junction (target, real) above it."""
    there = longest_prefix(rows.select(path).distinct(), junctions, path, "target").where("target is not null")
    real = there.join(junctions, "target").select(path, F.concat("real", F.substring(F.col(path), F.length("target") + 1, F.length(path))).alias("_real"))
    return rows.join(real, path, "left").withColumn(path, F.coalesce("_real", path)).drop("_real")


CHANNELS = ("override", "meta_key", "case_dir", "run_name", "archium", "solo_number", "derived")
#: Steps within a channel, and channels within one depth of derivation.
_STEPS, _RANKS = 1 << 20, len(CHANNELS)


def _turn(depth: Column, channel: str, step: Column) -> Column:
    """When a candidate's turn comes: by depth of derivation, then channel, then step within it."""
    return (depth.cast("long") * _RANKS + CHANNELS.index(channel)) * _STEPS + step.cast("long")


def _aliases(runs: DataFrame) -> DataFrame:
    """(run, depth, name): a run's own name and, as far as it is derived, those of its bases."""
    name = F.col("run")
    names = [name]
    for _ in range(DEPTH):
        name = derived_base(name)
        names.append(name)
    return runs.select("run", F.posexplode(F.array_compact(F.array(*names))).alias("depth", "name"))


def resolve_runs(runs: DataFrame, library: DataFrame, paths: DataFrame, overrides: DataFrame, catalogue: DataFrame | None = None, junctions: DataFrame | None = None) -> DataFrame:
    """(run, case_key, resolved_by): the first of seven channels that names a case, null where none does.

    A person's decision comes first, then the key that the run itself wrote
    down, the path it read (as it stands, then behind a junction), marks in its
    name, a catalogue number in its name, a case number alone in its name, and
    last what its base run resolves to.  ``runs`` has run, meta_key and
    case_dir, ``library`` case_key, repo, fund, inventory, case and
    desc_source, ``paths`` path and case_key, ``overrides`` run and case_key,
    ``catalogue`` file_id, fund, inventory and case, ``junctions`` target and
    real.

    Every channel lists its candidates with their turn; all are looked up at
    once, and the answer whose turn comes first counts.  Tasks have so many rows
    each at any number of runs, of which a path has about four folders.
    """
    spark = runs.sparkSession
    with small_tasks(spark):
        runs = stored(runs, "runs")
    with small_tasks(spark, 4 * runs.count()):
        return stored(_resolved(runs, library, paths, overrides, catalogue, junctions), "runs-resolved")


def _resolved(runs: DataFrame, library: DataFrame, paths: DataFrame, overrides: DataFrame, catalogue: DataFrame | None, junctions: DataFrame | None) -> DataFrame:
    """What ``resolve_runs`` returns, of stored runs."""
    none, first = F.lit(None).cast("string"), F.lit(0)
    tokens = F.col("tokens")
    aliases = _aliases(runs).withColumn("tokens", name_tokens(F.col("name")))
    aliases = stored(aliases.withColumns({"numbers": name_numbers(tokens), "repo": repository_hint(tokens), "solo": F.filter(tokens, lambda t: t.rlike(rf"^\d{{3,}}{_LETTER}?$"))}).drop("tokens"), "run-names")
    clean = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "/+$", "")
    folders = runs.where(F.coalesce("case_dir", F.lit("")) != "").select("run", clean(F.col("case_dir")).alias("path"), first.alias("behind"))
    if junctions is not None:
        real = without_junction(folders, junctions, "path").withColumn("behind", F.lit(1))
        folders = folders.unionByName(real).groupBy("run", "path").agg(F.min("behind").alias("behind"))
    said = stored(with_case_of_slug(with_case_of_path(folders, "path", "by_path"), "path", "by_slug"), "run-folders")

    by_name = aliases.select("run", "depth", "repo", F.posexplode(name_candidates(F.col("numbers"))).alias("nth", "c"))
    alone = aliases.where("size(solo) = 1 and size(numbers) = 1")
    step = F.col("behind") * 4
    listed = [
        by_name.select("run", _turn(F.col("depth"), "run_name", F.col("nth")).alias("turn"), "repo", "c.fund", "c.inventory", "c.case"),
        alone.select("run", _turn(F.col("depth"), "solo_number", first).alias("turn"), "repo", none.alias("fund"), none.alias("inventory"), case_number(F.get("solo", F.lit(0))).alias("case")),
        *(said.where(f"{m} is not null").select("run", _turn(first, "case_dir", step + k).alias("turn"), f"{m}.repo", f"{m}.fund", f"{m}.inventory", f"{m}.case") for k, m in ((1, "by_path"), (2, "by_slug"))),
    ]
    if catalogue is not None:
        of_name = aliases.select("run", _turn(F.col("depth"), "archium", first).alias("turn"), catalogue_number(F.regexp_replace("name", r"^f\d+[_-]", "")).alias("file_id"))
        parts = path_parts(F.col("path"))
        of_path = said.where(F.get(parts, F.lit(0)) == CATALOGUE_FOLDER).select("run", _turn(first, "case_dir", step + 3).alias("turn"), catalogue_number(F.try_element_at(parts, F.lit(-1))).alias("file_id"))
        number = lambda c: case_number(_found(F.col(c).cast("string"), r"(\d+)"))
        marks = catalogue.select(F.col("file_id").cast("string").alias("file_id"), F.lit(CATALOGUE_REPO).alias("repo"), case_number(F.col("fund").cast("string")).alias("fund"), number("inventory").alias("inventory"), number("case").alias("case"))
        listed.append(of_name.unionByName(of_path).where("file_id is not null").join(marks, "file_id").select("run", "turn", *MARK))
    candidates = stored(reduce(DataFrame.unionByName, listed), "run-candidates")

    noted = runs.where("meta_key <> ''").select("run", F.col("meta_key").alias("case_key"))
    known = noted.join(library.select("case_key"), "case_key", "left_semi").unionByName(noted.where("startswith(case_key, '@')"))
    filed = said.select("run", "path", step.alias("step")).join(paths.select(clean(F.col("path")).alias("path"), "case_key"), "path")
    decided = aliases.join(overrides.select(F.col("run").alias("name"), "case_key"), "name")
    sure = [
        known.select("run", _turn(first, "meta_key", first).alias("turn"), "case_key"), filed.select("run", _turn(first, "case_dir", F.col("step")).alias("turn"), "case_key"),
        decided.select("run", _turn(F.col("depth"), "override", first).alias("turn"), "case_key"),
    ]
    found = reduce(DataFrame.unionByName, sure).withColumn("level", first).unionByName(looked_up(candidates, library, "run"))
    # Dealt out first: a minimum of names sorts what it gets, which would be all that a task has read.
    best = found.repartition("run").groupBy("run").agg(F.min(F.struct("turn", "level", "case_key")).alias("b"))
    place = F.floor(F.col("b.turn") / _STEPS)
    channel = F.get(F.array(*map(F.lit, CHANNELS)), (place % _RANKS).cast("int"))
    by = F.when(place >= _RANKS, "derived").when(channel == "solo_number", "run_name").otherwise(channel)
    return runs.join(best, "run", "left").select(*runs.columns, F.col("b.case_key").alias("case_key"), F.coalesce(by, F.lit("none")).alias("resolved_by"))


def resolve_cases(asked: DataFrame, library: DataFrame, inventory_in_key: tuple[str, ...] = ("ANRM/211",)) -> DataFrame:
    """Whatever a person calls a case (value) as (value, case_key, on_disk, problem).

    A key, a mark with its archive, a source id or a path is understood; a mark
    without an archive is refused, as is a fund that numbers every inventory
    from one where the inventory is neither said nor the only one.
    """
    bare = F.col("value").rlike(r"^\s*\d+\s*[-–]\s*\d+\s*[-–]\s*\d+")
    df = asked.select("value", bare.alias("_bare"), F.when(~bare, shelf_mark(F.trim("value"))).alias("_said"))
    # Stored, else each use of a field would repeat all that leads to it.
    walked = stored(with_case_of_path(df, "value", "_walked"), "case-marks")
    m = walked.withColumn("_m", F.coalesce("_said", F.when(~F.col("_bare") & F.col("value").contains("/"), F.col("_walked"))))
    fund = F.concat_ws("/", "_m.repo", "_m.fund")
    lacking = m.withColumn("_vague", fund.isin(*inventory_in_key) & F.col("_m.inventory").isNull())
    theirs = library.select(F.concat_ws("/", "repo", case_number(F.col("fund")), case_number(F.col("case"))).alias("_fc"), case_number(F.col("inventory")).alias("_inv")).where("_inv is not null")
    only = theirs.groupBy("_fc").agg(F.count_distinct("_inv").alias("_n"), F.min("_inv").alias("_inv"))
    df = lacking.withColumn("_fc", F.concat_ws("/", fund, F.col("_m.case"))).join(only, "_fc", "left")
    inventory = F.when(F.col("_vague") & (F.col("_n") == 1), F.col("_inv")).otherwise(F.col("_m.inventory"))
    unclear = F.col("_vague") & (F.coalesce("_n", F.lit(0)) != 1)
    problem = F.when(F.col("_bare"), "no archive").when(F.col("_m").isNull(), "not understood").when(unclear, "inventory needed").when(F.col("_m.repo").isNull(), "no archive")
    df = df.withColumn("problem", problem).withColumn("case_key", F.when(problem.isNull(), case_key(F.col("_m.repo"), F.col("_m.fund"), F.col("_m.case"), inventory)))
    held = library.select("case_key", F.lit(True).alias("on_disk")).distinct()
    return df.join(held, "case_key", "left").select("value", "case_key", F.coalesce("on_disk", F.lit(False)).alias("on_disk"), "problem")
