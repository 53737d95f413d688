import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import decode, gazetteer, graph, notes, registry, sequences
from ledgerloom.plans.answer import Answer, SourceUnavailable, coverage_of, federated
from ledgerloom.sources import archive_tables
from ledgerloom.streaming import jobs


def test_every_query_has_an_oracle_and_runs(spark):
    from ledgerloom.plans import queries

    assert set(queries.QUERIES) == set(queries.ORACLES)
    for name in ("registry_stats", "fund_status_case", "decode_context", "locf_open_range"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_places(spark):
    rows = [("c1", "church", "мястківка", "miastkivka", 3), ("c2", "church", "мястковка", "miastkovka", 1), ("c3", "rabbinate", "мястківка", "miastkivka", 2), ("c4", "church", "устя", "usta", 9)]
    places = spark.createDataFrame(rows, "card string, section string, norm_uk string, norm_ru string, n_cases int")
    found = [(r["card"], r["score"]) for r in gazetteer.find_places(places, "мястківка").collect()]
    assert found[:2] == [("c1", 100), ("c3", 100)] and found[2][0] == "c2" and found[2][1] < 82
    assert [r["card"] for r in gazetteer.find_places(places, "", 2).collect()] == ["c4", "c1"]
    assert {tuple(r) for r in gazetteer.siblings(places).collect()} == {("c1", "c3"), ("c3", "c1")}
    near = {r["confuser"] for r in gazetteer.confusers(places, places.where("card = 'c1'")).collect()}
    assert near == {"c2", "c3"}


def test_margin_and_ambiguity(spark):
    scored = spark.createDataFrame([("a", "x", 99.0), ("a", "y", 97.0), ("b", "x", 99.0), ("b", "y", 90.0), ("c", "x", 80.0)], "k string, candidate string, score double")
    assert [(r["k"], r["candidate"]) for r in gazetteer.best_with_margin(scored, "k").collect()] == [("b", "x")]
    strong = spark.createDataFrame([("a", "x", 2), ("a", "y", 2), ("b", "x", 2), ("b", "y", 1)], "k string, candidate string, strength int")
    assert [tuple(r) for r in gazetteer.unique_or_strongest(strong, "k").collect()] == [("b", "x")]


def test_context_reaches_a_line_that_says_something(spark):
    page = "и\n3\nна\nЗдесь стоит осмысленная строка\nКовальчук"
    lines = decode.lines_of(spark.createDataFrame([("r", "1", page)], "run string, page string, text string"))
    hits = lines.where("line = 'Ковальчук'").select("run", "page", "line_no")
    r = decode.context(lines, hits).first()
    assert "Здесь стоит осмысленная строка" in r["before"] and len(r["before"]) <= 4 and r["after"] == []


def test_search_finds_broken_words(spark):
    lines = decode.lines_of(spark.createDataFrame([("r", "1", "имя Коваль\nчук здесь\n\nиное слово")], "run string, page string, text string"))
    found = decode.search(decode.candidates(lines), ["ковальчук"])
    best = found.orderBy(F.desc("score")).first()
    assert best["score"] == 100 and best["line_no"] == 2 and best["line_index"] == 1 and best["surface"] == "Коваль-чук"
    with pytest.raises(ValueError):
        decode.search(decode.candidates(lines), ["ко"])


def test_prefilter_loses_nothing(spark):
    long = "x" * 70
    words = spark.createDataFrame([(w,) for w in f"ковальчук ковальчк кавальчук ковлчук коваленко чук овальчук ковальчуковський {long}ковальчук{long} licensed".split()], "norm string")
    for stem in ("ковальчук", "licenses"):
        scored = words.withColumn("s", decode.score_to([stem], F.col("norm"))).where("s >= 80")
        assert scored.count() == scored.where(decode.could_reach(stem, 80, F.col("norm"))).count() == decode.scored_hits(words, [stem], 80).count()
        assert scored.count() > (0 if stem == "licenses" else 4)


def test_similarity_of_long_names(spark):
    """Names over 62 letters that differ only beyond."""
    a, b = "a" * 80 + "bcdefghij", "a" * 80 + "klmnopqrs"
    df = spark.createDataFrame([(a, b), (a, a), ("", ""), ("", a), (None, a)], "a string, b string")
    from ledgerloom.functions.similarity import ratio, ratio_to

    got = [r["s"] for r in df.select(ratio("a", "b").alias("s")).collect()]
    assert got[1:] == [100.0, 100.0, 0.0, None] and abs(got[0] - 200 * 80 / 178) < 1e-9
    assert abs(df.select(ratio_to(a, F.col("b")).alias("s")).first()["s"] - got[0]) < 1e-9
    places = spark.createDataFrame([(1, a, a), (2, b, b), (3, a[:-1], a)], "card long, norm_uk string, norm_ru string")
    found = {(r["confuser"], r["score"]) for r in gazetteer.confusers(places, places.where("card = 1")).collect()}
    assert found == {(2, 90), (3, 100)}


def test_phantom_pages(spark):
    rows = [("r", str(k), 30, 900, 80.0, False) for k in range(5)] + [("r", "f", 30, 60, 20.0, None), ("r", "ok", 30, 60, 80.0, False), ("r", "z", 0, 0, 1.0, True)]
    pages = spark.createDataFrame(rows, "run string, page string, lines int, chars int, contrast double, enhanced boolean")
    assert [(r["page"], r["reason"]) for r in decode.phantom_pages(pages).collect()] == [("f", "faint")]


def test_ranges_and_islands(spark):
    rows = [("f", 1, 10, None, "a"), ("f", 2, 5, None, ""), ("f", 3, 20, 25, "b"), ("f", 4, 30, None, "")]
    df = spark.createDataFrame(rows, "film string, pos int, s int, e int, delo string").withColumn("last", F.lit(99))
    out = sequences.closed_ranges(sequences.carried_forward(df, ["film"], ["pos"], "delo"), ["film"], ["pos"], "s", "e", "last")
    assert [(r["s"], r["e"], r["inferred"], r["delo"]) for r in out.orderBy("pos").collect()] == [(10, 19, True, "a"), (5, 19, True, "a"), (20, 25, False, "b"), (30, 99, True, "b")]
    # A row without a start stays open, and a group may lie in several ranges of rows.
    late = spark.createDataFrame([("f", k, None if k % 7 == 3 else (k * 37) % 101) for k in range(400)], "film string, pos int, s int").withColumns({"e": F.lit(None).cast("int"), "last": F.lit(999)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r["pos"]: (r["e"], r["inferred"]) for r in sequences.closed_ranges(late, ["film"], ["pos"], "s", "e", "last").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = {r["pos"]: r["s"] for r in late.collect()}
    for k, s in rows.items():
        later = next((rows[j] for j in range(k + 1, 400) if rows[j] and s is not None and rows[j] > s), None)
        assert got[k] == ((None, False) if s is None else (999 if later is None else later - 1, True)), k
    n = spark.createDataFrame([("x", k) for k in (1, 2, 3, 7, 9, 10, 10)], "g string, n int")
    assert sorted((r["first"], r["last"], r["n"]) for r in sequences.islands(n, ["g"], "n").collect()) == [(1, 3, 3), (7, 7, 1), (9, 10, 2)]


def test_notes_merge(spark):
    schema = "case_key string, scan string, page_type string, surnames array<string>, places array<string>, years array<int>, sheet string, status string, agent string, comment string"
    old = spark.createDataFrame([("k", "1", "birth", ["Коваль"], [], [1800], "5", "full", "a", "old")], schema)
    new = spark.createDataFrame([("k", "1", "death", ["коваль", "Бондар"], ["Устя"], [1801], "", "partial", "b", "new"), ("k", "2", "birth", [], [], [], "", "skipped", "b", "")], schema)
    first, second = notes.merged_notes(old, new).orderBy("scan").collect()
    assert first["surnames"] == ["Коваль", "Бондар"] and first["status"] == "full" and first["sheet"] == "5" and first["comment"] == "new ⟂ old" and first["page_type"] == "death"
    assert second["status"] == "skipped"


def test_canon_counts(spark):
    rows = [("s", "p", "1-4", "", ""), ("s", "p", "4", "", "скан 00123 of 1850"), ("s", "q", "10-310", "", ""), ("s", "", "400-701", "", ""), ("s", "q", "900-800", "", ""), ("t", "p", "x", "scan 1850", ""), ("u", "p", "", "скани 1001, 1002/1003 і 1850", ""), ("", "p", "5", "", "")]
    found = {r["source"]: (r["n_facts"], r["n_persons"], r["n_scans"]) for r in registry.canon_counts(spark.createDataFrame(rows, "source string, person string, page string, quote string, note string")).collect()}
    assert found == {"s": (5, 2, 4 + 1 + 301 - 1 + 1 + 1), "t": (1, 1, 0), "u": (1, 1, 3)}


def test_long_chains(spark):
    """Families deeper than any fixed number of rounds."""
    nodes = spark.range(70).select(F.col("id").alias("node"))
    edges = spark.range(69).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    assert {r["node"]: r["generation"] for r in graph.generations(nodes, edges).collect()} == {k: k for k in range(70)}
    assert graph.reachable(edges).count() == 70 * 69 // 2


def test_graph_with_a_cycle(spark):
    nodes = spark.createDataFrame([(k,) for k in range(1, 9)], "node long")
    edges = spark.createDataFrame([(1, 2, "parent"), (2, 3, "parent"), (1, 3, "parent"), (5, 6, "parent"), (6, 5, "parent"), (6, 7, "parent")], "source long, target long, kind string")
    assert {r["node"]: r["component"] for r in graph.components(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 5, 8: 8}
    assert {r["node"]: r["generation"] for r in graph.generations(nodes, edges).collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: None, 6: None, 7: None, 8: 0}
    counts = {r["node"]: (r["n_descendants"], r["n_ancestors"]) for r in graph.relation_counts(nodes, edges).collect()}
    assert counts[1] == (2, 0) and counts[3] == (0, 2) and counts[5] == (3, 2) and counts[8] == (0, 0)


def test_progress_protocol_splits_every_line_once(spark):
    lines = spark.createDataFrame([('@progress {"v":1,"phase":"x","i":1,"n":2}',), ("human",), ("@progress {broken",), ('@progress {"v":9,"phase":"x"}',)], "value string")
    assert [r["phase"] for r in jobs.progress_events(lines).collect()] == ["x"]
    assert jobs.plain_lines(lines).count() == 3


def test_upserting_stream_keeps_the_last_row(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, n int, v string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k int, n int, v string").parquet(f"{tmp_path}/in")
    jobs.upsert_batches(stream, f"{tmp_path}/out", "k", "n", f"{tmp_path}/c").awaitTermination(120)
    assert {(r["k"], r["v"]) for r in jobs.current(spark, f"{tmp_path}/out").collect()} == {(1, "b"), (2, "c")}
    more = spark.createDataFrame([(2, 9, "z"), (7, 1, "n")], "k int, n int, v string")
    for _ in range(2):  # a repeated batch changes nothing
        jobs.upserted(more, 5, f"{tmp_path}/out", "k", "n")
    # What a crash left, a version without its list, is not read.
    spark.createDataFrame([(1, 99, "lost", 0)], "k int, n int, v string, bucket int").write.partitionBy("bucket").parquet(f"{tmp_path}/out/{6:020d}")
    assert {(r["k"], r["v"]) for r in jobs.current(spark, f"{tmp_path}/out").collect()} == {(1, "b"), (2, "z"), (7, "n")}


def test_sources(spark, tmp_path):
    (tmp_path / "merged.tsv").write_text("opys\tspr_int\tspr_letter\ttitle\tyear_from\n1\t43\t\t…Ольгопольского уезда\t1802\n", encoding="utf-8")
    (tmp_path / "legacy.tsv").write_text("opys\tspr\ttitle\tsource\n1\t12а\tx\tfile\n", encoding="utf-8")
    merged = archive_tables.inventory(spark, f"{tmp_path}/merged.tsv").first()
    legacy = archive_tables.inventory(spark, f"{tmp_path}/legacy.tsv").first()
    assert merged["spr"] == "43" and merged["spr_letter"] == "" and merged["title_alt"] is None and merged["schema"] == "merged"
    assert (legacy["spr_int"], legacy["spr_letter"], legacy["title_src"]) == (12, "а", "file")
    assert archive_tables.optional_table(spark, f"{tmp_path}/none.tsv") is None
    run = tmp_path / "run1"
    run.mkdir()
    (run / "_htr_meta.json").write_text(json.dumps({"version": 1, "engine": "e", "pages": {"0001": {"lines": 14, "chars": 258}, "0002": {"lines": 18, "chars": 628}}}))
    (run / "0001.txt").write_text("a\nb")
    pages = archive_tables.run_pages(archive_tables.runs(spark, f"{tmp_path}/*/_htr_meta.json"))
    assert {(r["run"], r["scan"], r["lines"]) for r in pages.collect()} == {("run1", "0001", 14), ("run1", "0002", 18)}
    assert archive_tables.decoded(spark, f"{tmp_path}/run1/*.txt").first()["page"] == "0001"


def test_packs_and_coverage(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    archive_tables.write_pack(rows, f"{tmp_path}/p1", "gazetteer", "2024-01-01")
    rows.write.parquet(f"{tmp_path}/p2/rows")
    found, problems = archive_tables.read_packs(spark, [f"{tmp_path}/p1", f"{tmp_path}/p2"])
    assert found.count() == 2 and found.first()["pack_id"] == "p1" and len(problems) == 1
    with pytest.raises(FileNotFoundError):
        archive_tables.read_packs(spark, [f"{tmp_path}/p2"])

    def refuses():
        raise SourceUnavailable("not installed")

    answer = federated({"a": lambda: Answer(rows.where("id > 9"), coverage_of(rows, "a")), "b": refuses})
    assert answer.rows.count() == 0 and answer.zero_means_nothing_found() and answer.warnings == ["b: not installed"]
    with pytest.raises(SourceUnavailable):
        federated({"b": refuses})


def test_orphans_query_knows_small_orders(spark, tmp_path):
    """An order of any price claims its customer."""
    import __spark_entry__ as entry

    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 10.0), (2, 500000.0)], "o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r["c_custkey"] for r in entry.queries()["orphans_anti"](spark, str(tmp_path)).collect()] == [3]
