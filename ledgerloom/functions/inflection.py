"""Inflected forms of surnames, the slot language that names them, and the targets that damaged readings are compared with."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = ("nom", "gen", "dat", "acc", "ins", "loc", "voc")
# Endings by paradigm, orthography, gender and case in order; plural has two, "-" is no ending.
PARADIGMS = {
    "adj_skyi": {
        "bank": {"m": "скій ского скому ского скимъ скомъ скій", "f": "ская ской ской скую скою ской ская"},
        "ru_modern": {"m": "ский ского скому ского ским ском ский", "f": "ская ской ской скую ской ской ская", "p": "ские ских"},
        "ru_prereform": {"m": "скій скаго скому скаго скимъ скомъ скій", "f": "ская ской ской скую скою ской ская", "p": "скіе скихъ"},
        "uk": {"m": "ський ського ському ського ським ському ський", "f": "ська ської ській ську ською ській ська", "p": "ські ських"},
        "pl": {"m": "ski skiego skiemu skiego skim skim ski", "f": "ska skiej skiej ską ską skiej ska", "p": "scy skich"},
    },
    "noun_ov": {
        "bank": {"m": "ъ а у а ымъ ѣ ъ", "f": "а ой ой у ой ой а"},
        "ru_modern": {"m": "- а у а ым е -", "f": "а ой ой у ой ой а", "p": "ы ых"},
        "ru_prereform": {"m": "ъ а у а ымъ ѣ ъ", "f": "а ой ой у ой ой а", "p": "ы ыхъ"},
        "uk": {"m": "- а у а им і е", "f": "а ої ій у ою ій о", "p": "и их"},
    },
    "indeclinable": {orth: {"m": "- - - - - - -", "f": "- - - - - - -", "p": "- -"} for orth in ("bank", "ru_modern", "ru_prereform", "uk", "pl")},
}
#: The orthography of a slot that names none.
USUAL = "bank"
# Letters cut from the front of a root and what such a part is worth; a root's head alone.
LADDER = ((0, 1.0), (2, 0.85), (4, 0.65))
HEAD = (4, 0.45)


def coded(paradigm: str, orthography: str) -> dict[str, str]:
    """The endings of a paradigm in an orthography by code (nom_m, gen_f, ...), none if it has none there."""
    genders = PARADIGMS[paradigm].get(orthography, {})
    return {f"{case}_{gender}": "" if e == "-" else e for gender, listed in genders.items() for case, e in zip(CASES, listed.split(), strict=False)}


def endings(spark: SparkSession, paradigm: str = "adj_skyi") -> DataFrame:
    """(orthography, code, ending) of a paradigm: a fixed table of a few dozen rows."""
    rows = [(o, code, e) for o in PARADIGMS[paradigm] for code, e in coded(paradigm, o).items()]
    return spark.createDataFrame(rows, "orthography string, code string, ending string")


def every_form(stems: Column, paradigm: str) -> Column:
    """All forms of a map of stems by orthography, orthographies in the order of the paradigm, those without a stem left out."""

    def of(orthography: str) -> Column:
        stem = F.try_element_at(stems, F.lit(orthography))
        return F.when(stem.isNotNull(), F.array(*(F.concat(stem, F.lit(e)) for e in coded(paradigm, orthography).values())))

    return F.flatten(F.array_compact(F.array(*map(of, PARADIGMS[paradigm]))))


_CALL = re.compile(r"^(lower|hyphen|hyphen_head|hyphen_tail)\((.*)\)$", re.DOTALL)


def slot(text: str, stems: Column, paradigm: str) -> Column:
    """A slot of the language as a column over ``stems``, a map by orthography.

    A slot is ``code@orthography`` (a form of the paradigm), ``lower(slot)``,
    ``hyphen(slot, n)`` (the word broken after n letters) or its ``hyphen_head``
    and ``hyphen_tail``, or a literal in quotes.  It is parsed here, once, and
    gives null where a row has no stem for it or the word is too short to be
    broken; what no row could answer is an error.
    """
    said = text.strip()
    if len(said) > 1 and said[0] in "'\"" and said[-1] == said[0]:
        return F.lit(said[1:-1])
    if call := _CALL.match(said):
        name, inner = call.groups()
        if name == "lower":
            return F.lower(slot(inner, stems, paradigm))
        word, comma, cut = inner.rpartition(",")
        if not comma or not re.fullmatch(r"\s*-?\d+\s*", cut):
            raise ValueError(f"{text}: {name} takes a slot and the number of letters before the break")
        return broken(slot(word, stems, paradigm), int(cut))[{"hyphen": "whole", "hyphen_head": "head", "hyphen_tail": "tail"}[name]]
    code, _, orthography = (x.strip() for x in said.partition("@"))
    ending = coded(paradigm, orthography or USUAL).get(code)
    if ending is None:
        raise ValueError(f"{text}: {paradigm} has no form {code} in {orthography or USUAL}")
    return F.concat(F.try_element_at(stems, F.lit(orthography or USUAL)), F.lit(ending))


def search_forms(stems: Column, slots: list[str], paradigm: str) -> Column:
    """The forms of some slots in their order; those that a row cannot give are left out."""
    return F.array_compact(F.array(*(slot(s, stems, paradigm) for s in slots)))


def all_spellings(stems: Column, paradigm: str, extra: Column, recipe: list[str]) -> Column:
    """Every form in every orthography, then further spellings, then those of a recipe of slots; each once, in order."""
    return F.array_distinct(F.concat(every_form(stems, paradigm), F.coalesce(extra, F.array().cast("array<string>")), search_forms(stems, recipe, paradigm)))


def inflected(stems: DataFrame, table: DataFrame) -> DataFrame:
    """Every form of stems (root, orthography, stem): (root, orthography, code, form)."""
    return stems.join(F.broadcast(table), "orthography").select("root", "orthography", "code", F.concat("stem", "ending").alias("form"))


def spellings(forms: DataFrame) -> DataFrame:
    """Distinct forms of each root over all orthographies and cases."""
    return forms.groupBy("root").agg(F.array_sort(F.collect_set("form")).alias("spellings"))


def broken(word: Column, cut: int, joiner: str = " ") -> Column:
    """A word broken after ``cut`` letters: as a whole, its head and its tail; null where it is too short."""
    head, tail = F.concat(F.left(word, F.lit(cut)), F.lit("-")), F.substring(word, cut + 1, 1 << 30)
    return F.when((F.lit(cut) > 0) & (F.length(word) > cut), F.struct(F.concat(head, F.lit(joiner), tail).alias("whole"), head.alias("head"), tail.alias("tail")))


def targets(root: Column) -> Column:
    """A root, its tails and its head with their weights, as an array of (target, weight)."""
    steps = [F.when(F.length(root) > skip, F.struct(F.substring(root, skip + 1, 1 << 30).alias("target"), F.lit(w).alias("weight"))) for skip, w in LADDER]
    n, w = HEAD
    return F.array_compact(F.array(*steps, F.when(F.length(root) > n, F.struct(F.left(root, F.lit(n)).alias("target"), F.lit(w).alias("weight")))))
