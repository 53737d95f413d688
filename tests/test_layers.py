"""Numbers in first-seen order, coverage and overlays against plain Python; candidates of pages without a shuffle."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import decode, layers, sequences


def test_dictionary_in_first_seen_order(spark):
    rng = random.Random(2)
    values = [None if rng.random() < 0.1 else ("hot" if rng.random() < 0.4 else f"v{rng.randrange(50)}") for _ in range(700)]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "n long, v string").repartition(7)
    got = {r["n"]: r["code"] for r in layers.encoded(rows, "v", ["n"], "code").collect()}
    assert [got[k] for k in range(700)] == [list(dict.fromkeys(values)).index(v) for v in values]
    assert layers.dictionary(rows.limit(0), "v", ["n"]).count() == 0


def test_coverage_by_counting_points(spark):
    rng = random.Random(3)
    spans = [(rng.choice("ab"), a, a + rng.randrange(-2, 9)) for a in (rng.randrange(60) for _ in range(60))] + [("c", 1, 3), ("c", 4, 4), ("c", 6, 6), ("d", None, 3), ("d", 5, 4)]
    table = spark.createDataFrame(spans, "g string, lo int, hi int")
    found = layers.depths(table, ["g"], "lo", "hi").collect()
    count = {(r["g"], k): r["depth"] for r in found for k in range(r["low"], r["high"] + 1)}
    want = {}
    for g, lo, hi in spans:
        for k in range(lo, hi + 1) if lo is not None else ():
            want[g, k] = want.get((g, k), 0) + 1
    assert count == want
    joined = layers.covered(layers.depths(table, ["g"], "lo", "hi"), ["g"]).where("g = 'c'").orderBy("low").collect()
    assert [(r["low"], r["high"], r["deepest"], r["gap_after"]) for r in joined] == [(1, 4, 1, 1), (6, 6, 1, None)]


def test_overlays(spark):
    rows = [("k", 2, '{"a": {"b": 2}, "l": [3]}'), ("k", 1, '{"a": {"b": 1, "c": {"d": 1}}, "l": [1, 2], "n": 1}'), ("k", 3, None), ("k", 4, '{"a": {"c": {"e": "є"}}, "n": null}'), ("x", 1, '{"a": 1}'), ("x", 2, '{"a": {"b": 1}}'), ("y", 1, None)]
    got = {r["k"]: r["s"] for r in layers.overlaid(spark.createDataFrame(rows, "k string, layer int, s string"), "k", "layer", "s").collect()}
    assert got == {"k": '{"a": {"b": 2, "c": {"d": 1, "e": "є"}}, "l": [3], "n": null}', "x": '{"a": {"b": 1}}'}


def test_page_candidates_need_no_shuffle(spark):
    text = "Сікор\n\nський Іван\n- — \nПетро Долищин-\nський та син"
    pages = spark.createDataFrame([("r", "p", text), ("r", "q", None), ("r", "e", "")], "run string, page string, text string")
    by_page = decode.page_candidates(pages)
    plan = by_page._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    by_line = decode.candidates(decode.lines_of(pages))
    assert sorted(map(tuple, by_page.collect())) == sorted(map(tuple, by_line.collect())) and by_page.where(F.col("norm") == "сікорський").count() > 0


def test_ranges_of_one_group_over_many_tasks(spark):
    """A group that borders cut in several places, with falling starts that look far ahead."""
    rng = random.Random(4)
    starts = [None if rng.random() < 0.1 else rng.randrange(1, 5000) for _ in range(900)] + list(range(5000, 4000, -3)) + [9000]
    rows = spark.createDataFrame([("g", k, s, None, 10_000) for k, s in enumerate(starts)] + [("h", 0, 5, None, 7)], "g string, n long, s long, e long, last long")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["g"], r["n"]): r["e"] for r in sequences.closed_ranges(rows, ["g"], ["n"], "s", "e", "last").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for k, s in enumerate(starts):
        want = None if s is None else next((x for x in starts[k + 1 :] if x is not None and x > s), 10_001) - 1
        assert got["g", k] == want, k
    assert got["h", 0] == 7
