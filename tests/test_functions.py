import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import keys, normal
from ledgerloom.functions.similarity import partial_ratio_to, ratio, ratio_to


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def lcs_ratio(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return 200 * row[-1] / (len(a) + len(b))


def windows_ratio(a, b):
    s, t = sorted((a, b), key=len)
    best = max(lcs_ratio(s, t[max(0, k - len(s)) : k]) for k in range(1, len(t) + len(s)))
    return max(best, max(lcs_ratio(t, s[max(0, k - len(t)) : k]) for k in range(1, len(t) + len(s)))) if len(s) == len(t) else best


def test_ratio_against_definition(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abcé") for _ in range(rng.randrange(0, 12))), "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 12)))) for _ in range(200)]
    df = spark.createDataFrame([*pairs, ("", ""), ("a", ""), ("x" * 62, "x" * 62)], "a string, b string")
    for r in df.select("a", "b", ratio(F.col("a"), F.col("b")).alias("r")).collect():
        assert r["r"] == pytest.approx(lcs_ratio(r["a"], r["b"]))


def test_partial_ratio_against_definition(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "b string")
    for stem in ("abcda", "ddcb", "abcdabcdab"):
        for r in df.select("b", partial_ratio_to(stem, F.col("b")).alias("p"), ratio_to(stem, F.col("b")).alias("r")).collect():
            assert r["r"] == pytest.approx(lcs_ratio(stem, r["b"]))
            assert r["p"] == pytest.approx(windows_ratio(stem, r["b"]))


def test_spellings_in_three_scripts_meet(spark):
    forms = {one(spark, normal.matching_form(F.lit(x))) for x in ("Wójcik", "Вуйцик", "wujcik")}
    assert forms == {"vuicik", "vujcik"} or len(forms) <= 2
    assert one(spark, normal.matching_form(F.lit("Szczepański"))) == "scepanski"
    assert one(spark, normal.matching_form(F.lit("Щепанський"))) == "scepanskii"
    assert one(spark, normal.archival_form(F.lit("q0ѣ"))) == "goe"
    assert one(spark, normal.matching_form(F.lit(None).cast("string"))) == ""


def test_names(spark):
    assert one(spark, normal.name_form(F.lit("М'ястківка, м-ко."))) == "мястківка"
    assert one(spark, normal.name_form(F.lit('М"ястківка'))) == "мястківка"
    for form in ("Ольгопільського", "Ольгопільскому", "ольгопільський", "ОЛЬГОПІЛЬСЬКИЙ"):
        assert one(spark, normal.adjective(F.lit(form), "ий")) == "Ольгопільський"
    assert one(spark, normal.adjective(F.lit("Подільської"), "а")) == "Подільська" and one(spark, normal.adjective(F.lit("кут"), "а")) == "Кут"
    assert one(spark, normal.slug(F.lit("Кам'янець — Подільський"))) == "kam-anec-podilskii"
    assert one(spark, normal.initials(F.lit("Іван Петренко"))) == "ІП"


@pytest.mark.parametrize("text, want", [
    ("ДАХмО 315-1-8433", ("DAHMO", "315", "1", "8433")), ("DAHMO/315/8433", ("DAHMO", "315", "1", "8433")), ("ANRM/211-3/140", ("ANRM", "211", "3", "140")),
    ("S_CDIAK_F224_OP1_D864", ("CDIAK", "224", "1", "864")), ("Ф. 211 Оп. 3 Д. 140", (None, "211", "3", "140")), ("230-1-2а", (None, "230", "1", "2a")),
])
def test_shelf_marks(spark, text, want):
    assert tuple(one(spark, keys.shelf_mark(F.lit(text)))) == want


def test_keys_and_ranges(spark):
    assert one(spark, keys.shelf_mark(F.lit("nonsense"))) is None
    assert one(spark, keys.case_key(F.lit("ANRM"), F.lit("211"), F.lit("140"), F.lit("3"))) == "ANRM/211-3/140"
    assert one(spark, keys.candidate_keys(F.lit("ANRM"), F.lit("211"), F.lit("3"), F.lit("140"))) == ["ANRM/211-3/140", "ANRM/211/140"]
    assert one(spark, keys.case_number(F.lit("00114"))) == "114"
    assert one(spark, keys.case_number(F.lit(""))) is None
    assert tuple(one(spark, keys.leaf_range(F.lit("Л. 5-12 - село")))) == (5, 12)
    assert tuple(one(spark, keys.leaf_range(F.lit("Л. 5-…")))) == (5, None)
    assert tuple(one(spark, keys.leaf_range(F.lit("Л. 7 - село")))) == (7, 7)
    assert one(spark, keys.pages_of(F.lit("1-4,60"))) == [1, 2, 3, 4, 60]
    assert tuple(one(spark, keys.years_span(F.lit("метрики 1802–1815, спр. 12345")))) == (1802, 1815)
    assert keys.year_bounds("1850-1860") == (1850, 1860) and keys.year_bounds("1850") == (1850, 1850) and keys.year_bounds("x") is None
    assert one(spark, keys.leading_int(F.lit("12а"))) == 12 and one(spark, keys.leading_int(F.lit("а"))) == 0


def test_facts(spark):
    from ledgerloom.functions import facts

    assert one(spark, facts.region(F.array(F.lit("Вінницька область")))) == "podillia" and one(spark, facts.region(F.lit(None).cast("array<string>"))) == "other"
    names = spark.createDataFrame([(n,) for n in (" a.jpg", "a/b.jpg", ".hidden", "", "b\\c", "ok")], "n string").where(facts.is_bare_filename(F.col("n")))
    assert [r["n"] for r in names.collect()] == [" a.jpg", "ok"]
    media = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(u).alias("url"), F.lit(p).alias("path")) for t, u, p in (("doc", "x", ""), ("photo", "", ""), ("photo", "", "p.jpg"), ("photo", "http://y", ""))))
    assert tuple(one(spark, facts.photo(media))) == ("p.jpg", False)
    assert facts.shard_of("2/3") == (1, 3) and facts.shard_of("") == (0, 1) and facts.shard_of("1") == (0, 1)
    for bad in ("4/3", "0/2", "a/b"):
        with pytest.raises(ValueError):
            facts.shard_of(bad)
    assert one(spark, facts.weakest(F.array(F.lit("direct"), F.lit("negative"), F.lit("rumour")))) == "negative" and one(spark, facts.weakest(F.array().cast("array<string>"))) is None
    same = one(spark, facts.record_digest(F.lit("s"), F.lit(1).alias("a"))) == one(spark, facts.record_digest(F.lit("s"), F.lit(1).alias("a")))
    assert same and one(spark, facts.record_digest(F.lit("s"), F.lit(2).alias("a"))).startswith("s__")


def test_paths_say_cases(spark):
    from ledgerloom.operators import resolution

    def said(step, path):
        m = step(spark.createDataFrame([(path,)], "p string"), "p").first()["mark"]
        return m and tuple(m)

    path, slug = resolution.with_case_of_path, resolution.with_case_of_slug
    assert said(path, "data/raw/dahmo_315/spr-8433") == ("DAHMO", "315", None, "8433")
    assert said(path, "data\\raw\\davo\\010904-24-00114") == ("DAVO", "904", "24", "114")
    assert said(path, "D:/dahmo_230/230-1-2а") == ("DAHMO", "230", "1", "2a")
    assert said(path, "davo/f904_op24/77.pdf") == ("DAVO", "904", "24", "77")
    assert said(path, "data/raw/dahmo_226/op2-spr-148") == ("DAHMO", "226", "2", "148")
    assert said(path, "davo_opysy/spr-1") is None and said(path, "dahmo_archium/spr_5") is None and said(path, "") is None
    assert said(slug, "data/raw/cdiak_224/spr-864/pages") == ("CDIAK", "224", None, "864")
    assert said(slug, "dahmo_315_small/m357-1-23") == ("DAHMO", "357", "1", "23") and said(slug, "x") is None
    names = spark.createDataFrame([("spov1846-7864",), ("196-1-5953",), ("f904-24-010904-7029а",), ("t1",)], "n string")
    got = {r["n"]: r["k"] for r in names.select("n", resolution.name_numbers(resolution.name_tokens(F.col("n"))).alias("k")).collect()}
    assert got == {"spov1846-7864": ["7864"], "196-1-5953": ["196", "1", "5953"], "f904-24-010904-7029а": ["904", "24", "904", "7029а"], "t1": ["1"]}


def test_a_mark_is_read_once_however_often_its_parts_are_named(spark):
    """The plan of a key from a mark holds a bounded number of patterns, not one for each way through its conditions."""
    key = keys.once(keys.shelf_mark(F.col("c")), lambda m: keys.case_key(m["repo"], m["fund"], m["case"], m["inventory"]))
    rows = spark.createDataFrame([("ДАХмО 7-1-0012а",), ("ANRM/211-2/5",), ("Ф. 3 Оп. 2 Д. 4",), ("x",), (None,)], "c string").select(key.alias("k"))
    assert [r["k"] for r in rows.collect()] == ["DAHMO/7/12a", "ANRM/211-2/5", None, None, None]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp") < 60
