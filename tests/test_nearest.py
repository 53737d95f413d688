"""Most similar names of all cards against all pairs; the weighted ratio by published examples; linkage keeps every record."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import similarity
from ledgerloom.operators import gazetteer, linkage, nearest

SYLLABLES = "ка ра мо ві шин дор го ле бер див ське ів ок ниця поль лу".split()


def name(rng):
    word = "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 7)))
    return word if rng.random() < 0.9 else f"{word} {rng.choice(SYLLABLES)}"


def edited(rng, word):
    for _ in range(rng.randrange(3)):
        k = rng.randrange(len(word) + 1)
        word = rng.choice((word[:k] + "з" + word[k:], word[:k] + word[k + 1 :], word[:k] + "и" + word[k + 1 :]))
    return word


def plain(places, least, limit):
    first, second = ([p[k] or "" for p in places] for k in (1, 2))
    out = []
    for card, uk, ru in places:
        best = similarity.ratios_to(uk or "", first), similarity.ratios_to(uk or "", second), similarity.ratios_to(ru or "", first)
        scores = {}
        for (other, *_), *s in zip(places, *(x.tolist() for x in best), strict=True):
            if other != card and max(s) >= least:
                scores[other] = max(round(max(s)), scores.get(other, 0))
        out += [(card, c, s) for c, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:limit]]
    return sorted(out)


@pytest.mark.parametrize(("least", "limit"), [(78, 8), (70, 3), (90, 20)])
def test_against_all_pairs(spark, least, limit):
    rng = random.Random(least)
    words = [name(rng) for _ in range(120)]
    places = [(k, edited(rng, rng.choice(words)), rng.choice([rng.choice(words), name(rng)])) for k in range(260)]
    places += [(1000, "", ""), (1001, None, "ка"), (1002, "", None), (1003, "д", "ж"), (1004, "ж" * 70, "ж" * 64), (1005, "ж" * 69 + "д", "x")] + [(2000 + k, "скрізь", "скрізь") for k in range(30)]
    table = spark.createDataFrame(places, "card long, norm_uk string, norm_ru string")
    got = sorted((r["card"], r["confuser"], r["score"]) for r in nearest.all_confusers(table, least, limit).collect())
    assert got == plain(places, least, limit)


def test_empty_and_low(spark):
    assert nearest.all_confusers(spark.createDataFrame([], "card long, norm_uk string, norm_ru string")).count() == 0
    with pytest.raises(ValueError):
        nearest.all_confusers(spark.createDataFrame([], "card long, norm_uk string, norm_ru string"), 50)


def test_all_customers_agree_with_a_sample_of_queries(spark):
    """Names that differ in digits alone: the shortened forms are enough, no name asks further."""
    customers = spark.read.parquet("/root/testdata/sf0.01/customer.parquet").select(F.col("c_custkey").alias("card"), F.col("c_name").alias("norm_uk"), F.col("c_name").alias("norm_ru"))
    sample = customers.where("card % 50 = 7")
    got = nearest.all_confusers(customers).join(sample.select("card"), "card", "left_semi")
    want = gazetteer.confusers(customers, sample)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("card", "confuser", "score").collect())) and got.count() == 8 * sample.count()


def test_every_name_that_can_reach_is_met():
    """Pieces of the other name are among the probes whenever the similarity is reached."""
    rng = random.Random(3)
    for _ in range(400):
        a = name(rng)
        b = edited(rng, edited(rng, a)) or "к"
        for least in (67, 78, 90, 97):
            if similarity.ratios([a], [b])[0] >= least:
                keys = {f"{len(b)}.{g}.{i}.{p}" for g in nearest.GRAINS for i, (_, p) in enumerate(nearest.pieces(b, g))}
                assert keys & nearest.probes(a, least, [len(b), 99]), (a, b, least)


def test_weighted_ratio_by_published_examples():
    pairs = [
        ("this is a test", "this is a new test!!!", 85.5), ("this is a test", "this is a test", 100.0), ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 95.0),
        ("", "x", 0.0), ("abc", "abd", 200 * 2 / 6), ("x", "axb ccccccccc", 60.0),
    ]
    a, b, want = zip(*pairs, strict=True)
    assert similarity.weighted_ratios(list(a), list(b)) == pytest.approx(want)
    assert similarity.weighted_ratios(list(b), list(a)) == pytest.approx(want)


def test_linkage_keeps_records_without_a_year(spark):
    records = spark.createDataFrame([(1, "ковальчук", 1, None), (2, "ковальчук", 1, 1900), (3, "зовсім інше", 1, 1700), (4, None, 1, None)], "record_id int, name string, nation int, year int")
    persons = spark.createDataFrame([(10, "ковальчук", 1, 1750), (11, "ковальчик", 1, None)], "person_id int, name string, nation int, year int")
    pairs = linkage.candidate_pairs(records, persons, F.col("nation")).withColumnRenamed("p_person_id", "person_id")
    parts = {"surname": linkage.string_score(F.col("name"), F.col("p_name")), "given": F.lit(1.0), "patronymic": F.lit(0.0), "year": linkage.year_score(F.col("year"), F.col("p_year")), "place": F.lit(0.0)}
    got = {r["record_id"]: r for r in linkage.best_person(pairs.withColumn("score", linkage.total_score(parts, F.lit(False)))).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert (got[1]["proposed"], round(got[1]["score"], 6)) == (10, 0.8) and got[2]["proposed"] == 10 and got[4]["proposed"] is None


def test_names_that_share_their_beginning_stay_few(spark, monkeypatch):
    """Names that differ in digits and in capitals: second names are two letters from first ones, and no name meets all that share a piece."""
    places = [(k, f"supplier#{k:09d}", f"Supplier#{k:09d}") for k in range(400)] + [(9000 + k, f"supplier#{k:09d}", None) for k in range(0, 400, 40)]
    asked = []
    probing = nearest._probing
    monkeypatch.setattr(nearest, "_probing", lambda lengths: asked.append(1) or probing(lengths))
    table = spark.createDataFrame(places, "card long, norm_uk string, norm_ru string")
    got = sorted((r["card"], r["confuser"], r["score"]) for r in nearest.all_confusers(table).collect())
    assert got == plain(places, 78, 8) and not asked


def test_best_pairs_hold_the_best_of_all_pairs(spark, monkeypatch):
    """Names of one word and several, empty, long and lacking; in parts of a few rows each."""
    monkeypatch.setattr(linkage, "RECORDS_AT_ONCE", 7)
    monkeypatch.setattr(linkage, "PERSONS_AT_ONCE", 5)
    rng = random.Random(8)
    some = lambda: rng.choice([name(rng), name(rng), edited(rng, "ковальчук"), "supplier#%09d" % rng.randrange(300), "ж" * 70, "", None])
    rows = lambda n: [(k, some(), rng.choice([1, 2, None]), rng.choice([None, rng.uniform(0, 20)])) for k in range(n)]
    records = spark.createDataFrame(rows(60), "record_id int, name string, nation int, year double")
    persons = spark.createDataFrame(rows(40), "person_id int, name string, nation int, year double")
    parts = {"surname": linkage.string_score(F.col("name"), F.col("p_name")), "given": F.lit(0.0), "patronymic": F.lit(0.0), "year": linkage.year_score(F.col("year"), F.col("p_year")), "place": F.lit(0.0)}

    def best(pairs):
        return sorted(map(str, linkage.best_person(pairs.withColumnRenamed("p_person_id", "person_id").withColumn("score", linkage.total_score(parts, F.lit(False)))).collect()))

    few = linkage.best_pairs(records, persons, "nation", "person_id", linkage.BARE)
    every = linkage.candidate_pairs(records, persons, F.col("nation"))
    assert best(few) == best(every) and few.count() < every.count() / 2
