"""Queries over pages: given ones, and catalogue pages that orders and parts are written into, with what real ones have wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.plans.queries import query
from ledgerloom.sources import catalogue_pages
from ledgerloom.sources.markup import selected_each


@query(r"""WITH p AS (SELECT page_id, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS article, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad FROM pages),
l AS (SELECT page_id, regexp_extract_all(nav, '<a href="([^"]*)">', 1) AS href FROM p)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h1, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS title, len(href) AS n_links, coalesce(href[1], '') AS first_link, coalesce(href[-1], '') AS last_link,
  len(regexp_extract_all(article, '<p>')) AS n_paragraphs, trim(ad) AS ad FROM p JOIN l USING (page_id)""")
def page_outline(t) -> DataFrame:
    """Headings, navigation, paragraphs and notices of the given pages, whose scripts and comments hold tags, whose <b> is never closed and whose headings may end within a character reference, which HTML reads without its semicolon."""
    pages = t("pages").select("page_id", "html")
    rows = selected_each(pages, [("body", {"title": "article h1", "ad": "div.ad"}), ("nav li a", {"href": "@href"}), ("article p", {})])
    nth = lambda k: F.col("which") == k
    link = F.when(nth(1), F.col("position"))
    found = rows.groupBy("page_id").agg(
        F.max(F.when(nth(0), F.struct("title", "ad"))).alias("b"), F.count_if(nth(1)).alias("n_links"), F.coalesce(F.min_by("href", link), F.lit("")).alias("first_link"),
        F.coalesce(F.max_by("href", link), F.lit("")).alias("last_link"), F.count_if(nth(2)).alias("n_paragraphs"),
    ).where("b is not null").select("*", "b.title", "b.ad")
    return found.select("page_id", "title", "n_links", "first_link", "last_link", "n_paragraphs", "ad")


def _page(rows: DataFrame, page: str, nth: str, html: Column, head: str, foot: str) -> DataFrame:
    """A page of rows in their order between a head and a foot."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(nth, html.alias("html")))), lambda r: r["html"]), "\n")
    return rows.groupBy(F.col(page).alias("page_id")).agg(F.concat(F.lit(head), body, F.lit(foot)).alias("html"))


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("""SELECT o_custkey AS page_id, (o_orderkey + 100)::VARCHAR AS file_id, 'Справа ' || o_orderkey::VARCHAR AS number, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE year(o_orderdate)::VARCHAR END AS date,
  CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 90 + 1)::INT END AS sheets, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS nth FROM orders WHERE o_orderkey % 7 > 0""")
def catalogue_cases(t) -> DataFrame:
    """Orders as the cases of their customer's inventory page: single quotes, comments with rows in them, unclosed spans, rows without a file."""
    k = F.col("o_orderkey")
    file = F.when(k % 7 == 0, "/about/").otherwise(_text("/api/v1/files/", k + 100, "/view"))
    date = F.when(k % 3 == 0, "").otherwise(_text("<span class='date late'>", F.year("o_orderdate")))
    sheets = F.when(k % 2 == 0, _text("Метрична <b>книга</b>, ", k % 90 + 1, " арк.")).otherwise("Без опису &lt;?&gt;")
    row = _text("<div class='row odd'><!-- <div class='row'><div class=left><a href='/files/1/'>x</a></div></div> --><div class=\"left\"><a href='", file, "'> Справа ", k, " </a>", date, "</div><div class=right>", sheets, "</div></div>")
    pages = _page(t("orders"), "o_custkey", "o_orderkey", row, "<html><body><script>'<div class=row>'</script>", "</body>")
    nth = F.row_number().over(_by_page("position")) - 1
    return catalogue_pages.cases(pages).withColumn("nth", nth).select("page_id", "file_id", "number", "date", "sheets", "nth")


def _by_page(order: str):
    return W.Window.partitionBy("page_id").orderBy(order)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_orderkey % 4 = 0 AS bare FROM lineitem), o AS (
  SELECT l_orderkey AS page_id, CASE WHEN bool_or(min(l_linenumber) = 1) OVER (PARTITION BY l_orderkey) THEN 'Фонд ' || l_orderkey::VARCHAR ELSE '' END AS title, l_suppkey::VARCHAR AS inventory, min(l_linenumber) AS n, bare FROM l GROUP BY l_orderkey, l_suppkey, bare)
SELECT page_id, title, inventory, CASE WHEN bare THEN 'опис ' || n::VARCHAR ELSE 'опис ' || n::VARCHAR || ' · ' || (1700 + n)::VARCHAR || '–' || (1800 + n)::VARCHAR END AS label, CASE WHEN NOT bare THEN (1000 + n)::INT END AS n_cases FROM o""")
def catalogue_inventories(t) -> DataFrame:
    """Order lines as inventories of a fund's page, some named twice; one page in four has links alone."""
    n, bare = F.col("l_linenumber"), F.col("l_orderkey") % 4 == 0
    link = _text("<a class=x href='/inventories/", F.col("l_suppkey"), "/'>опис ", n, "</a>")
    row = F.when(bare, _text("<p>", link)).otherwise(_text("<div class='thin-row'><div class='left'><span>", link, "</span></div><div class='right'>", n + 1700, " – ", n + 1800, " рр., 1 00", n, " справ</div></div>"))
    body = _text(F.when(n == 1, _text("<h1 class='head-title'>Фонд ", F.col("l_orderkey"), "</h1>")).otherwise(""), row)
    pages = _page(t("lineitem"), "l_orderkey", "l_linenumber", body, "<body>", "")
    return catalogue_pages.inventories(pages).select("page_id", "title", "inventory", "label", "n_cases")


@query("""SELECT p_size AS page_id, (p_partkey + 5)::VARCHAR AS fund_id, 'ф.' || p_partkey::VARCHAR || ' ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' · 1790-1800' END AS label FROM part WHERE p_partkey % 5 > 0""")
def catalogue_funds(t) -> DataFrame:
    """Parts as funds of a table with unclosed cells, a table within a cell, and rows of three cells."""
    k = F.col("p_partkey")
    dates = F.when(k % 3 == 0, "").otherwise("1790-1800")
    last = F.when(k % 5 == 0, "").otherwise("<td><table><tr><td>у<td>середині</table>")
    row = _text("<tr class=\"r\"><td>", k, "<td><A HREF=\"/fonds/", k + 5, "/x\">", F.col("p_name"), "</A><td>", dates, last)
    pages = _page(t("part"), "p_size", "p_partkey", row, "<table class='big fond-groups'><thead><tr><th>№</thead><tbody>", "</table>")
    return catalogue_pages.funds(pages).select("page_id", "fund_id", "label")


@query("""SELECT l_orderkey AS page_id, (l_partkey * 10 + l_linenumber)::INT AS image_id, (9 - l_linenumber)::INT AS page_no, 1 + l_orderkey % 40 AS last FROM lineitem WHERE l_orderkey % 3 > 0
UNION ALL SELECT DISTINCT l_orderkey, (l_linenumber * 7)::INT, (dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber))::INT, 1 + l_orderkey % 40 FROM lineitem WHERE l_orderkey % 3 = 0""")
def catalogue_viewer(t) -> DataFrame:
    """Order lines as images whose order is in their ``alt`` alone; one page in three names files in links instead, twice each."""
    n, image = F.col("l_linenumber"), F.col("l_partkey") * 10 + F.col("l_linenumber")
    spare = _text("<a href='#file-", n * 7, "'>x</a><a href=\"#file-", n * 7, "\">")
    body = F.when(F.col("l_orderkey") % 3 == 0, spare).otherwise(_text("<img alt='", 9 - n, "' data-observe-src='/static/files/000/", image, ".jpg'><!-- <img data-observe-src=\"/static/files/000/1.jpg\" alt=\"1\"> -->"))
    links = _text(body, "<a href='?Page=", 1 + F.col("l_orderkey") % 40, "'>")
    pages = _page(t("lineitem"), "l_orderkey", "l_linenumber", links, "<div>", "")
    found = catalogue_pages.viewer_pages(pages)
    return found.join(pages.select("page_id", catalogue_pages.last_page(F.col("html")).cast("long").alias("last")), "page_id").select("page_id", "image_id", "page_no", "last")
