import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import inflection
from ledgerloom.operators import spellings


def test_forms_and_targets(spark):
    table = inflection.endings(spark)
    assert table.count() == 4 * 16 + 14
    stems = spark.createDataFrame([("sik", "uk", "Сікор"), ("sik", "pl", "Sikor")], "root string, orthography string, stem string")
    forms = {(r["orthography"], r["code"]): r["form"] for r in inflection.inflected(stems, table).collect()}
    assert forms["uk", "gen_f"] == "Сікорської" and forms["pl", "nom_p"] == "Sikorscy" and len(forms) == 32
    r = spark.range(1).select(inflection.broken(F.lit("Долищинський"), 4).alias("b"), inflection.broken(F.lit("До"), 4).alias("n"), inflection.targets(F.lit("sikorski")).alias("t")).first()
    assert tuple(r["b"]) == ("Доли- щинський", "Доли-", "щинський") and r["n"] is None
    assert [tuple(x) for x in r["t"]] == [("sikorski", 1.0), ("korski", 0.85), ("rski", 0.65), ("siko", 0.45)]


def test_slots(spark):
    rows = spark.createDataFrame([({"bank": "Долищин", "uk": "Долищин", "pl": "Dol"}, ["Долищенскій", "Долищинскій"]), ({"uk": "Бо"}, None)], "stems map<string,string>, extra array<string>")
    stems = F.col("stems")
    slots = ["gen_m@uk", " nom_m ", "lower( nom_f@pl )", "hyphen(gen_m@uk, 4)", "hyphen_head(lower(gen_m@uk),4)", "hyphen_tail('Сікорський', 5)", '"опіска"', "hyphen('до', 7)"]
    got = [r["f"] for r in rows.select(inflection.search_forms(stems, slots, "adj_skyi").alias("f")).collect()]
    assert got[0] == ["Долищинського", "Долищинскій", "dolska", "Доли- щинського", "доли-", "ський", "опіска"]
    assert got[1] == ["Боського", "Бось- кого", "бось-", "ський", "опіска"]
    for bad in ("gen_x@uk", "nom_p@bank", "hyphen(nom_m)", "hyphen(nom_m, x)", "nom_m@latin", ""):
        with pytest.raises(ValueError):
            inflection.slot(bad, stems, "adj_skyi")
    spelled = rows.select(inflection.all_spellings(stems, "noun_ov", F.col("extra"), ["'x'", "nom_m@bank"]).alias("s")).first()["s"]
    assert spelled[:3] == ["Долищинъ", "Долищина", "Долищину"] and spelled[-3:] == ["Долищенскій", "Долищинскій", "x"] and len(spelled) == len(set(spelled))
    assert rows.select(inflection.every_form(stems, "indeclinable").alias("f")).first()["f"] == ["Долищин"] * 32 + ["Dol"] * 16  # bank, uk, pl


def test_occurrences_against_every_position(spark):
    """Overlapping hits, forms within forms, letters beyond the basic plane, any batch."""
    rng = random.Random(8)
    draw = lambda n: "".join(rng.choice("абaв🙂 ") for _ in range(n))
    texts = [(k, draw(rng.randrange(60))) for k in range(80)] + [(100, None), (101, ""), (None, "аба"), (102, "аа" * 3000), (102, "аба")]
    forms = sorted({draw(rng.randrange(1, 5)) for _ in range(200)} | {"аба", "аа"})
    got = spellings.occurrences(spark.createDataFrame(texts, "id long, text string"), forms + [""], "id")
    want = Counter((i, f, k) for i, t in texts for f in forms for k in range(len(t or "")) if (t or "").startswith(f, k))
    assert Counter((r["id"], r["form"], r["start"]) for r in got.collect()) == want
    assert spellings.occurrences(spark.createDataFrame(texts, "id long, text string"), [], "id").count() == 0
