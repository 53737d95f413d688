"""HTML by structure: what is unclosed, nested, quoted or hidden; catalogue pages; addresses."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import catalogue_pages, markup


def texts(html, selector):
    return [e.text() for e in markup.Selector(selector).all(markup.tree(html))]


def test_unclosed_cells_and_nested_tables():
    html = "<table id=o><tr><td>a<td>b<table><tr><td>c</td></tr></table><tr><td>d</table><td>stray"
    assert texts(html, "td") == ["a", "bc", "c", "d", "stray"] and texts(html, "#o tr") == ["abc", "c", "d"] and texts(html, "table table td") == ["c"]
    assert texts("<ul><li>a<ul><li>b<li>c</ul><li>d", "ul ul li") == ["b", "c"] and texts("<p>a<div>b</div><p>c", "p") == ["a", "c"]


def test_what_is_no_element():
    html = """<!-- <b>x</b> --><script>"<b>y</b>"</script><b class='one  two' data-k="a>b">z &amp; &#39;w</b></i><br/><b>"""
    assert texts(html, "b") == ["z & 'w", ""] and texts(html, "b.two") == ["z & 'w"] and texts(html, "[data-k='a>b']") == ["z & 'w"] and texts(html, "script") == [""]
    assert texts(None, "b") == [] and texts("", "b") == [] and texts("<b", "b") == []


def test_selectors_and_parts():
    root = markup.tree("<div class=a><p>1</p><section><p x=7>2</p></section></div><p>3</p>")
    assert [e.text() for e in markup.Selector("div.a p").all(root)] == ["1", "2"]
    div = next(markup.Selector("div").all(root))
    take = lambda p: markup.Part(p).of(div)
    assert (take("p"), take("p:1"), take("p:1@x"), take("section >> p"), take("p:9"), take("@class"), take("p@x"), take("")) == ("1", "2", "7", "2", None, "a", None, "12")
    for bad in ("", "p > b", "p:first"):
        with pytest.raises(ValueError):
            markup.Selector(bad)


def test_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    long = "<p>" + "слово " * 200_000
    pages = spark.createDataFrame([(1, deep), (2, long), (3, None), (None, "<p>a</p>")], "page_id int, html string")
    got = markup.selected(pages, "p", {"text": ""}).select("page_id", F.length("text").alias("n")).collect()
    assert sorted(map(tuple, got), key=str) == [(2, 1_199_999), (None, 1)]
    assert markup.selected(pages, "div", {"text": ""}).count() == 5000


def test_addresses(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert one(catalogue_pages.image_url(F.lit("https://x"), F.lit(1234))) == "https://x/static/files/001/001234.jpg" and one(catalogue_pages.image_url(F.lit(""), F.lit(12345678))).endswith("/123/12345678.jpg")
    assert one(catalogue_pages.ref_of_url(F.lit("https://s.example/#moldova%2FA+b%2F%2F2086525"))) == "moldova/A+b/2086525" and one(catalogue_pages.ref_of_url(F.lit("https://s.example/#"))) is None
    assert tuple(one(catalogue_pages.ref_parts(F.lit("/moldova/a/b")))) == ("moldova", "a/b") and one(catalogue_pages.ref_parts(F.lit(" /"))) is not None and one(catalogue_pages.ref_parts(F.lit("/"))) is None
    url = catalogue_pages.frame_url("https://s/storage", "/media/", F.lit("/media/disk/"), F.lit("/a b/в~/"), F.lit("1*.jpg"))
    assert one(url) == "https://s/storagedisk/a%20b/%D0%B2~/1%2A.jpg" and one(catalogue_pages.frame_url("s", "/media/", F.lit("/other/"), F.lit(""), F.lit("x"))) is None
    assert one(catalogue_pages.fund_id(F.lit("DAHMO"), F.lit("315"))) == "dahmo_315" and one(catalogue_pages.fund_id(F.lit("dahmo"), F.lit("3"), {"DAHMO": "hm"})) == "hm_3"
    entries = {'{"listy": "Л. 1", "delo": "2"}': [{"listy": "Л. 1", "delo": "2"}], '["a", {"listy": "b"}, "", null]': [{"listy": "a"}, {"listy": "b"}], '"Л. 5"': [{"listy": "Л. 5"}], "": [], "null": [], "[]": []}
    for raw, want in entries.items():
        assert one(catalogue_pages.meta_entries(F.lit(raw))) == want, raw
    assert one(catalogue_pages.meta_entries(F.lit(None).cast("string"))) == [] and one(catalogue_pages.last_page(F.lit("x"))) == 1


def test_each_page_is_read_once_and_only_what_is_found_stays():
    row = "<div class=row><a href='/x'>a &amp; b</a><p>c<div class=row><b>d</b></div></div>"
    pages = [row * 3, "<script>'<div class=row>'</script>" + row + "<!-- " + row + " -->", "<div class=row>a<b", "a < b <div class=row>x</div> &lt", row + "<div class='row' k = 1>y"]
    selectors = [markup.Selector(s) for s in ("div.row", "a[href]", "div.row div.row b")]
    for html in [*pages, None, ""]:
        got = []
        markup.each_found(html, selectors, lambda n, k, e: got.append((n, k, e.text())))
        assert sorted(got) == [(n, k, e.text()) for n, s in enumerate(selectors) for k, e in enumerate(s.all(markup.tree(html)))], html
    waiting = []
    markup.each_found("<ul>" + "<li><b>x</b>" * 1000, [markup.Selector("li")], lambda n, k, e: waiting.append((k, len(e.above.below))))
    assert waiting[-1] == (999, 0)


def test_inventories_read_each_page_once(spark, monkeypatch):
    html = [(1, "<h1 class=head-title>F</h1><div class=thin-row><div class=left><a href='/inventories/7/'>o 7</a></div><div class=right>1 002 справ</div></div><a href='/inventories/8/'>o 8</a>"), (2, "<a href='/inventories/8/'>o 8</a>"), (3, None)]
    calls = []
    each = catalogue_pages.selected_each
    monkeypatch.setattr(catalogue_pages, "selected_each", lambda *a, **k: calls.append(1) or each(*a, **k))
    got = catalogue_pages.inventories(spark.createDataFrame(html, "page_id int, html string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "F", "7", 0, "o 7", 1002), (2, "", "8", 0, "o 8", None)] and len(calls) == 1


def test_outline_agrees_with_its_sql_on_a_heading_cut_in_a_reference(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    page = '<body><nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">n</div><article><h1>a&amp;&amp;{}</h1><p>x</p></article></body>'
    spark.createDataFrame([(k, page.format(end)) for k, end in enumerate(("&amp", "&am", "&lt", "&amp;lt"))], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.sql(entry.oracle_sql()["page_outline"]).fetchall())
    assert sorted(map(tuple, entry.queries()["page_outline"](spark, str(tmp_path)).collect())) == want and [r[1] for r in want] == ["a&&&", "a&&&am", "a&&<", "a&&&lt"]
