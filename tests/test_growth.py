"""Growth that the review of round 3 found: what is asked of some rows, lines, classes or streams costs in proportion."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom import storage
from ledgerloom.operators import decode, gazetteer, graph, nearest
from tests.test_nearest import edited, name, plain


def test_some_cards_meet_close_names_only(spark, monkeypatch):
    """Stated queries get what all pairs give, and no pass compares them with every place."""
    monkeypatch.setattr(gazetteer, "_confused", lambda *_: pytest.fail("compared with every place"))
    rng = random.Random(6)
    words = [name(rng) for _ in range(80)]
    places = [(k, edited(rng, rng.choice(words)), edited(rng, rng.choice(words))) for k in range(200)] + [(500 + k, "скрізь", "скрізь") for k in range(20)] + [(600, None, ""), (601, "", None)]
    table = spark.createDataFrame(places, "card long, norm_uk string, norm_ru string")
    got = sorted(tuple(r) for r in gazetteer.confusers(table, table.where("card % 10 = 0")).select("card", "confuser", "score").collect())
    assert got == [r for r in plain(places, 78, 8) if r[0] % 10 == 0]


def test_persons_are_not_held_whole(spark):
    """Persons listed from a small table are many rows: no task gets all of them."""
    families = spark.createDataFrame([("f", "h", "w", None, None, ["c", "x"], None, [])], "family_id string, husband string, wife string, hypothetical_husband string, hypothetical_wife string, children array<string>, hypothetical_children array<string>, facts array<struct<type:string,status:string,confidences:array<string>>>")
    persons = spark.createDataFrame([("h",), ("w",), ("c",)], "node string")
    links = graph.typed_links(families, persons)
    assert {tuple(r)[:3] for r in links.collect()} == {("h", "c", "parent"), ("w", "c", "parent"), ("h", "w", "spouse")}
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_sibling_classes_count_all_pairs(spark):
    """Every card with its classes and as many siblings as the pairs list, from which the pairs follow."""
    rng = random.Random(8)
    places = [(k, rng.choice("abc"), rng.choice(["х", "у", "z", "", None]), rng.choice(["x", "y", None])) for k in range(120)] + [(500, None, "х", "x")]
    table = spark.createDataFrame(places, "card long, section string, norm_uk string, norm_ru string")
    got = {r["card"]: r for r in gazetteer.sibling_classes(table).collect()}
    pairs = {tuple(r) for r in gazetteer.siblings(table).collect()}
    assert len(got) == len(places) and pairs
    assert {c: r["n_siblings"] for c, r in got.items()} == {p[0]: sum(a == p[0] for a, _ in pairs) for p in places}
    shared = lambda a, b: any(got[a][c] is not None and got[a][c] == got[b][c] for c in ("uk_class", "ru_class"))
    section = {p[0]: p[1] for p in places}
    known = [c for c in section if section[c] is not None]
    assert {(a, b) for a in known for b in known if section[a] != section[b] and shared(a, b)} == pairs


def test_only_candidates_near_a_stem_are_listed(spark):
    """Of all candidates those with a piece of a stem, in their order, also over line ends and where small letters are more letters."""
    rng = random.Random(16)
    parts = "li cen ses lic ense License ка ЛІЦ ς Σες İ x1 по-за (lic) ens e\x1cli licenseslicenses".split(" ")
    text = lambda: "".join(rng.choice(parts) + rng.choice(["", " ", " ", ". ", "\n", "\n\n"]) for _ in range(rng.randrange(60)))
    pages = spark.createDataFrame([("r", k, text()) for k in range(150)] + [("r", 999, None)], "run string, page long, text string")
    every = decode.page_candidates(pages)
    for stems, least in ((["licenses"], 88), (["license", "σεςка"], 90), (["lic"], 70)):
        hit = F.lit(False)
        for s in stems:
            hit = hit | decode.could_reach(s, least, F.col("norm"))
        key = ["run", "page", "line_no", "ord"]
        listed = lambda df: [(*r[:3], *r[4:]) for r in df.where(hit).select(*key, "surface", "norm").orderBy(*key).collect()]
        near = decode.near_candidates(pages, stems, least)
        assert listed(near) == listed(every)
        assert near.count() < every.count() or least == 70
        best = lambda df: sorted(tuple(r) for r in decode.search(df, stems, least).collect())
        assert best(near) == best(every)


def test_candidates_of_a_line_are_not_shuffled(spark):
    """Lines with their candidates are the candidates of pages, and come from each page's own row."""
    text = "ім'я Коваль\nчук ту(т)\n\nі ще слово одне тут\nа"
    pages = spark.createDataFrame([("r", 1, text), ("r", 2, None), ("r", 3, "")], "run string, page long, text string")
    lines = decode.line_candidates(pages)
    each = lines.select("run", "page", "line_no", F.posexplode("candidates").alias("ord", "c")).select("run", "page", "line_no", "ord", "c.surface", "c.norm")
    assert sorted(map(tuple, each.collect())) == sorted(map(tuple, decode.page_candidates(pages).collect()))
    from ledgerloom.plans import queries

    found = queries.QUERIES["decode_candidates"](spark, "/root/testdata/sf0.001")
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_islands_in_more_tasks_for_more_rows(spark, monkeypatch):
    """Runs with repeats, gaps and a number that is not known, in as many tasks as their rows take."""
    from ledgerloom import storage
    from ledgerloom.operators import sequences

    rows = spark.createDataFrame([("a", n) for n in (1, 2, 2, 3, 7, 9, 10, None)] + [("b", 2), (None, 5), (None, 6)], "g string, n int")
    want = [("", 5, 6, 2), ("a", 1, 3, 3), ("a", 7, 7, 1), ("a", 9, 10, 2), ("a", None, None, 1), ("b", 2, 2, 1)]
    got = sequences.islands(rows, ["g"], "n")
    assert sorted(((r["g"] or "", r["first"], r["last"], r["n"]) for r in got.collect()), key=str) == sorted(want, key=str)
    monkeypatch.setattr(storage, "TASK_ROWS", 1)
    assert sequences.islands(rows, ["g"], "n").rdd.getNumPartitions() == 11


def test_counted_forms_are_their_places(spark):
    """Counts, first and last places of forms in a text are those of all its places, and nothing is shuffled for them."""
    from ledgerloom.operators import spellings

    rng = random.Random(15)
    forms = ["аб", "ба", "аба", "б", "жжж", "ёж"]
    texts = spark.createDataFrame([(k, "".join(rng.choice("абжё ") for _ in range(rng.randrange(80)))) for k in range(60)] + [(100, None), (101, "")], "id long, text string").repartition(4)
    got = spellings.counted(texts, forms, "id")
    want = spellings.occurrences(texts, forms, "id").groupBy("id", "form").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first"), F.max("start").alias("last"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_keys_of_a_stream_share_their_state(spark, tmp_path, monkeypatch):
    """Many keys in few groups, over several batches, give what the finished log gives; the state is kept by group."""
    from ledgerloom.streaming import keyed
    from tests.test_keyed import ROWS, _streamed, at

    monkeypatch.setattr(keyed, "GROUPS", 3)
    assert issubclass(keyed.Submissions, keyed._Grouped) and issubclass(keyed.Silence, keyed._Grouped)
    rows = [(i, f"k{i * 7 % 23}", at(i * 11), f"p{i}") for i in range(300)]
    first = _streamed(spark, rows, tmp_path / "a", lambda s: keyed.idempotent(s, "key", "at", "id", 600))
    assert sorted(r["id"] for r in first) == sorted(r["id"] for r in keyed.idempotent_batch(spark.createDataFrame(rows, ROWS), "key", "at", "id", 600).collect())


def test_runs_are_resolved_by_tasks_of_bounded_rows(spark, monkeypatch):
    """More runs take more tasks, not larger ones: with 50 rows to a task no stored file has more, and the settings are as before afterwards."""
    from ledgerloom import storage
    from ledgerloom.operators import resolution

    monkeypatch.setattr(storage, "NAMED_ROWS", 50)
    library = spark.createDataFrame([(f"DAHMO/7/{k}", "DAHMO", "7", "1", str(k), "canonical") for k in range(400)], "case_key string, repo string, fund string, inventory string, case string, desc_source string")
    runs = spark.createDataFrame([(f"dahmo-7-1-{k}", "", "") for k in range(400)], "run string, meta_key string, case_dir string").coalesce(1)
    none = spark.createDataFrame([], "path string, case_key string")
    keys = ("spark.sql.shuffle.partitions", "spark.sql.files.maxRecordsPerFile", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(k) for k in keys]
    found = resolution.resolve_runs(runs, library, none, none.withColumnRenamed("path", "run"))
    got = found.withColumn("file", F.input_file_name()).collect()
    assert {(r["run"], r["case_key"], r["resolved_by"]) for r in got} == {(f"dahmo-7-1-{k}", f"DAHMO/7/{k}", "run_name") for k in range(400)}
    assert max(Counter(r["file"] for r in got).values()) <= 50
    assert [spark.conf.get(k) for k in keys] == before


def test_tables_counted_as_large_are_shuffled(spark):
    """A stored table beyond the bound is not sent to the executors, however small its file is."""
    table = storage.stored(spark.range(1000).withColumn("v", F.lit("x")), "large")
    rows = spark.range(50)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(rows.join(storage.broadcast_if_small(table, 1000), "id"))
    assert "Broadcast" not in plan(rows.join(storage.broadcast_if_small(table, 999), "id"))


@pytest.mark.parametrize("asked", [None, 40])
def test_no_join_of_names_is_left_to_the_size_of_files(spark, monkeypatch, asked):
    """With every table of names counted as large, no step gathers one in the driver: names, their forms, pieces and lists."""
    rng = random.Random(5)
    places = [(k, "".join(rng.choice("каробен") for _ in range(rng.randrange(3, 9))), rng.choice([None, "Орел" + "ь" * rng.randrange(9)])) for k in range(120)]
    table = spark.createDataFrame(places, "card long, norm_uk string, norm_ru string")
    queries = None if asked is None else table.where(F.col("card") < asked)
    want = sorted(map(tuple, nearest.all_confusers(table, queries=queries).collect()))
    plans, stored = [], nearest.stored
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(nearest, "stored", lambda df, name: stored(seen(df), name))
    monkeypatch.setattr(nearest, "broadcast_if_small", lambda df, *rows: storage.broadcast_if_small(df, 0))
    got = seen(nearest.all_confusers(table, queries=queries))
    assert sorted(map(tuple, got.collect())) == want and want
    assert sum("Join" in p for p in plans) >= 6 and not [p for p in plans if "Broadcast" in p]


def test_siblings_are_listed_in_pairs(spark):
    """The query lists each sibling of the stated parts, as its SQL did before classes and counts took their place (F2)."""
    from ledgerloom.plans import queries

    got = queries.QUERIES["siblings_theta"](spark, "/root/testdata/sf0.001")
    part = {r["p_partkey"]: (r["p_name"], r["p_type"]) for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()}
    want = {(a, b) for a in part for b in part if a % 100 == 0 and a != b and part[a][0] == part[b][0] and part[a][1] != part[b][1]}
    assert got.columns == ["card", "sibling"] and sorted(map(tuple, got.collect())) == sorted(want) and want


@pytest.mark.parametrize("some", [False, True])
def test_siblings_against_all_pairs(spark, some):
    """Each pair once, with names lacking, empty and shared by most cards, and cards in several rows; nothing is joined by broadcast."""
    rng = random.Random(11)
    rows = [(rng.randrange(90), rng.choice(["а", "б", "в", None]), rng.choice(["х", "х", "х", "y", "", None]), rng.choice(["x", "y", "z", "", None])) for _ in range(140)]
    rows += [(200 + k, "аб"[k % 2], "х", "z") for k in range(60)] + [rows[0], (None, "а", "х", "x")]
    table = spark.createDataFrame(rows, "card long, section string, norm_uk string, norm_ru string")
    same = lambda x, y: x is not None and x == y
    differ = lambda x, y: x is not None and y is not None and x != y
    want = {(a, b) for a, s, u, r in rows for b, o, v, q in rows if differ(a, b) and differ(s, o) and (same(u, v) or same(r, q)) and (not some or a % 10 == 0)}
    found = gazetteer.siblings(table, table.where("card % 10 = 0")) if some else gazetteer.siblings(table)
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 100
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_names_are_divided_over_tasks(spark, monkeypatch):
    """However few files names come from, one task makes the forms of a bounded number of them, with the same result (F1)."""
    names = storage.stored(spark.range(95).coalesce(1), "few")
    assert names.rdd.getNumPartitions() == 1 and max(storage.divided(names, 10).rdd.glom().map(len).collect()) <= 12
    rng = random.Random(6)
    places = [(k, "".join(rng.choice("каробен") for _ in range(rng.randrange(2, 8))), None) for k in range(80)]
    seen = []
    monkeypatch.setattr(nearest, "divided", lambda df, most: seen.append(most) or storage.divided(df, 9))
    table = spark.createDataFrame(places, "card long, norm_uk string, norm_ru string")
    assert sorted(map(tuple, nearest.all_confusers(table, 70, 4).collect())) == plain(places, 70, 4) and set(seen) == {nearest.NAMES_AT_ONCE}
