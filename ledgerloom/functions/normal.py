"""Normal forms of names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that count as the same letter.
DIACRITICS = ("ąćęłńóśżźșşțţăâî", "acelnuszzssttaai")
DIGRAPHS = (("szcz", "sc"), ("sz", "s"), ("cz", "c"), ("rz", "r"), ("schi", "ski"), ("sche", "ske"), ("ghe", "ge"), ("ghi", "gi"), ("ch", "h"))
CYRILLIC = ("абвгґдеєёжзиіыїйклмнопрстуфхцчшэюя", "abvggdeeezziiiiiklmnoprstufhccseua")
HISTORIC = ("ѣѳѵѕѡq90", "efizoggo")
# What ends a settlement's name, and marks left out of names.
SETTLEMENT_TAIL = r"(?iu),?\s*(?:м-ко|м\.|с\.|сл\.|х\.|хут\.|сщ\.|мст\.)\s*\.?\s*$"
NAME_MARKS = "[’'ʼ`\"().,;:]+"


def matching_form(c: Column) -> Column:
    """Latin skeleton in which spellings of a name in several scripts meet; null becomes empty."""
    out = F.translate(F.lower(F.coalesce(c, F.lit(""))), *DIACRITICS)
    for pair, letter in DIGRAPHS:
        out = F.replace(out, F.lit(pair), F.lit(letter))
    out = F.replace(F.translate(out, "y", "i"), F.lit("щ"), F.lit("sc"))
    out = F.translate(F.translate(out, CYRILLIC[0] + "ъь", CYRILLIC[1]), "w", "v")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def archival_form(c: Column) -> Column:
    """The matching form with historic letters and common misreadings folded too."""
    return F.translate(matching_form(c), *HISTORIC)


def name_form(c: Column) -> Column:
    """A settlement's name without its type, marks and case."""
    bare = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), SETTLEMENT_TAIL, "")
    return F.trim(F.replace(F.lower(F.regexp_replace(bare, NAME_MARKS, "")), F.lit("ё"), F.lit("е")))


def latin_forms(*names: Column) -> Column:
    """Distinct matching forms of several names, joined by blanks."""
    return F.array_join(F.array_distinct(F.filter(F.array(*map(matching_form, names)), lambda x: x != "")), " ")


def flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def search_form(c: Column) -> Column:
    """Lower case, no apostrophes, anything but letters and digits a blank."""
    return flat(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[’'ʼ`]", ""), r"(?U)[^\w]+", " "))


def loose_form(c: Column) -> Column:
    """Case, soft sign and the i-letters folded."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), "іїь", "ии")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(matching_form(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def initials(c: Column) -> Column:
    words = F.split(flat(c), " ")
    return F.upper(F.concat(F.left(F.get(words, F.lit(0)), F.lit(1)), F.when(F.size(words) > 1, F.left(F.element_at(words, -1), F.lit(1))).otherwise("")))


def genitive(c: Column) -> Column:
    return F.regexp_replace(c, "ий$", "ого")


def adjective(c: Column, ending: str) -> Column:
    """An adjective in -sk-, in whatever case and in Russian or Ukrainian, as its stem with one ending.

    All forms share what comes up to the suffix; a word without the suffix
    stays as it is.  Capitals throughout become an initial one.
    """
    stem = F.regexp_replace(F.regexp_extract(c, r"(?iu)^(.*(?:[сц]ьк|ск))\p{L}{0,3}$", 1), "(?iu)ск$", "ськ")
    word = F.when(stem == "", c).otherwise(F.concat(F.when(stem == F.upper(stem), F.lower(stem)).otherwise(stem), F.lit(ending)))
    return F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, 2, 1 << 30))
