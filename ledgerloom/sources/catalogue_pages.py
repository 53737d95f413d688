"""An archive's catalogue pages as rows: funds, inventories, cases, pages of the viewer, and the addresses of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import window as W

from ledgerloom.sources.markup import selected, selected_each

# How ids, sheets, counts and years are written in the pages.
FILE_ID, INVENTORY_ID, FUND_ID = r"/files/(\d+)/", r"/inventories/(\d+)/", r"/fonds/(\d+)/"
SHEETS, N_CASES, YEARS = r"(\d+)\s*арк", r"([\d ]+)\s*справ", r"(\d{4}\s*[-–]\s*\d{4}|\d{4})"
IMAGE, VIEWER_FILE, PAGE = r"^/static/files/\d{3}/(\d+)\.jpg$", r"#file-(\d+)", r"[?&]Page=(\d+)"


def _found(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1), F.lit(""))


def cases(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page, position, file_id, number, date, description, sheets) of an inventory's cases; rows without a file are none."""
    parts = {"href": "div.left >> a@href", "number": "div.left >> a", "date": "div.left >> span.date", "description": "div.right"}
    rows = selected(pages, "div.row", parts, id_col).withColumn("file_id", _found(F.col("href"), FILE_ID)).where("file_id is not null")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(id_col, "position", "file_id", text("number"), text("date"), text("description"), _found(F.col("description"), SHEETS).cast("int").alias("sheets"))


def inventories(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page, title, inventory, position, label, n_cases) of a fund's inventories.

    Where a page's rows give none, any links to inventories do: a worse label
    is better than a fund that looks empty.
    """
    rows = {"href": "div.left a@href", "label": "div.left a", "about": "div.right"}
    found = selected_each(pages, [("div.thin-row", rows), ("a[href]", {"href": "@href", "label": ""}), ("h1.head-title", {"title": ""})], id_col)
    found = found.withColumn("inventory", _found(F.col("href"), INVENTORY_ID)).where("inventory is not null or which = 2 and position = 0")
    of_page = W.Window.partitionBy(id_col)
    listed = F.max((F.col("which") == 0).cast("int")).over(of_page)
    found = found.withColumns({"_listed": F.when(F.col(id_col).isNull(), 0).otherwise(listed), "title": F.when(F.col(id_col).isNotNull(), F.max("title").over(of_page))})
    found = found.where("which = 0 or which = 1 and _listed = 0")
    years = F.replace(_found(F.col("about"), YEARS), F.lit(" "), F.lit(""))
    n = F.replace(_found(F.col("about"), N_CASES), F.lit(" "), F.lit("")).cast("int")
    label = F.concat("label", F.coalesce(F.concat(F.lit(" · "), years), F.lit("")))
    first = found.select(id_col, "inventory", "title", F.struct("position", label.alias("label"), n.alias("n_cases")).alias("b")).groupBy(id_col, "inventory").agg(F.min_by("b", "b.position").alias("b"), F.max("title").alias("title"))
    return first.select(id_col, F.coalesce("title", F.lit("")).alias("title"), "inventory", "b.position", "b.label", "b.n_cases")


def funds(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(page, position, fund_id, label) of a table of funds; rows of fewer than four cells are none."""
    parts = {"number": "td:0", "href": "td:1 >> a@href", "title": "td:1 >> a", "dates": "td:2", "fourth": "td:3"}
    rows = selected(pages, "table.fond-groups tbody tr", parts, id_col).withColumn("fund_id", _found(F.col("href"), FUND_ID)).where("fund_id is not null and fourth is not null")
    dates = F.when(F.col("dates") != "", F.concat(F.lit(" · "), F.col("dates"))).otherwise("")
    return rows.select(id_col, "position", "fund_id", F.concat(F.lit("ф."), "number", F.lit(" "), "title", dates).alias("label"))


def viewer_pages(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(page, image_id, page_no): images by what their ``alt`` says, for ids are no order; without any, the files named in links, in order."""
    images = selected(pages, "[data-observe-src]", {"src": "@data-observe-src", "alt": "@alt"}, id_col, html)
    numbered = images.select(id_col, _found(F.col("src"), IMAGE).cast("int").alias("image_id"), _found(F.col("alt"), r"^(\d+)$").cast("int").alias("page_no")).where("image_id is not null and page_no is not null")
    named = pages.select(id_col, F.posexplode(F.array_distinct(F.regexp_extract_all(html, F.lit(VIEWER_FILE), 1))).alias("at", "file"))
    both = numbered.withColumn("_image", F.lit(1)).unionByName(named.select(id_col, F.col("file").cast("int").alias("image_id"), (F.col("at") + 1).alias("page_no"), F.lit(0).alias("_image")))
    images_there = F.when(F.col(id_col).isNull(), 0).otherwise(F.max("_image").over(W.Window.partitionBy(id_col)))
    return both.withColumn("_there", images_there).where("_image = _there or _image = 1").drop("_image", "_there")


def last_page(html: Column) -> Column:
    """The largest page number that links name, one if there is none."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(html, F.lit(PAGE), 1), lambda x: x.cast("int"))), F.lit(1))


def image_url(base: Column, image_id: Column) -> Column:
    """The address of an image: its number in six digits, in a folder of the first three."""
    name = F.when(image_id < 1_000_000, F.lpad(image_id.cast("string"), 6, "0")).otherwise(image_id.cast("string"))
    return F.concat(base, F.lit("/static/files/"), F.left(name, F.lit(3)), F.lit("/"), name, F.lit(".jpg"))


def fund_id(repo: Column, fund: Column, slugs: dict[str, str] | None = None) -> Column:
    """A fund's folder: the archive's name for folders, or its code in small letters, and the number."""
    named = F.create_map(*(F.lit(x) for pair in (slugs or {"": ""}).items() for x in pair))
    return F.concat(F.coalesce(F.try_element_at(named, F.upper(repo)), F.lower(repo)), F.lit("_"), fund)


def ref_of_url(url: Column) -> Column:
    """The path that a link to a film carries behind its #, decoded, without empty parts; null if there is none."""
    coded = F.when(url.contains("#"), F.regexp_extract(url, r"(?s)#(.*)$", 1)).otherwise(url)
    plain = F.try_url_decode(F.replace(coded, F.lit("+"), F.lit("%2B")))
    return F.nullif(F.array_join(F.filter(F.split(F.coalesce(plain, coded), "/"), lambda p: p != ""), "/"), F.lit(""))


def ref_parts(ref: Column) -> Column:
    """A path as (slug, path): its first part is the region."""
    parts = F.filter(F.split(ref, "/"), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.struct(F.get(parts, F.lit(0)).alias("slug"), F.array_join(F.slice(parts, 2, 1 << 30), "/").alias("path")))


def frame_url(storage: str, media_prefix: str, root: Column, path: Column, name: Column) -> Column:
    """The address of a frame; null where a region's root is not where the rule holds, for it must not be guessed."""
    folder = F.array_join(F.filter(F.split(path, "/"), lambda p: p != ""), "/")
    raw = F.concat(F.substring(root, len(media_prefix) + 1, 1 << 30), F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), name)
    coded = F.url_encode(raw)
    for there, here in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(there), F.lit(here))
    return F.when(root.startswith(media_prefix), F.concat(F.lit(storage), coded))


def meta_entries(raw: Column) -> Column:
    """What a folder's metadata holds, an object, a list of objects and strings, or a string, as an array of objects.

    ``raw`` is JSON; a string is an entry that says sheets, empty values are none.
    """
    whole = F.trim(raw)
    each = F.when(whole.startswith("["), F.from_json(whole, "array<string>")).otherwise(F.array(whole))

    def entry(e: Column) -> Column:
        quoted = F.when(F.trim(e).startswith('"'), F.get(F.from_json(F.concat(F.lit("["), F.trim(e), F.lit("]")), "array<string>"), F.lit(0))).otherwise(e)
        return F.when(F.trim(e).startswith("{"), F.from_json(e, "map<string,string>")).when(F.trim(quoted) != "", F.create_map(F.lit("listy"), quoted))

    empty = whole.isNull() | whole.isin("", "null", '""', "{}", "[]")
    return F.when(empty, F.array().cast("array<map<string,string>>")).otherwise(F.array_compact(F.transform(each, entry)))
