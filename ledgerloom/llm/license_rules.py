"""License scans by ordered signature rules (DataFrame functions only).

A text is reduced to its words, each with a space on either side, so that a
rule is a sequence of word patterns and neighbouring matches never share a
character.  A rule runs only on texts that hold its keyword.  All places of
all rules become intervals; an interval inside that of a rule of higher
priority, or of a longer match of the same priority, is suppressed, so "gnu
lesser general public license version 3" is not also a mention of the GPL.
What survives gives the labels and a score.

Edge cases: a null text is empty and has no words; repeated rows are judged
alike; texts of any length are scanned whole, in memory proportional to their
own length; an empty table yields no rows; columns other than id and text are
ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.text import ITEM_WORD, ascii_lower

#: The base phrases.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Priorities, the strongest evidence first, and the score each gives.
TAG, GRANT, NAME, MENTION = range(4)
SCORES = (1.0, 0.9, 0.7, 0.4)


@dataclass(frozen=True)
class Rule:
    """A sequence of word patterns; one ending in ``?`` may be absent."""

    label: str
    priority: int
    keyword: str
    words: str

    @property
    def gate(self) -> str:
        """The word that a text must hold before anything else is looked at: the rarest that the rule cannot do without."""
        return "license" if "license" in self.words.split() else self.keyword

    @property
    def pattern(self) -> str:
        parts = []
        for w in self.words.split():
            parts.append(f"(?: (?:{w[:-1]}) )?" if w.endswith("?") else f" (?:{w}) ")
        return "".join(parts)


def _numbered(template: str, versions: list[str], **more: str) -> list[tuple[str, str]]:
    """(version, words) of a name with each version, as words: 2.1 is two words."""
    return [(v, template.format(v=v.replace(".", " "), **more)) for v in versions]


def _rules() -> list[Rule]:
    rules: list[Rule] = []

    def add(label: str, priority: int, keyword: str, *signatures: str) -> None:
        rules.extend(Rule(label, priority, keyword, s) for s in signatures)

    for (words, label), keyword in zip(BASE.items(), ("mit", "apache", "cc"), strict=True):
        add(label, GRANT, keyword, words)
    # The GNU family: names, short forms and tags of every version.
    gnu = {
        "gpl": ("general public license", "gpl", ["1", "2", "3"]),
        "lgpl": ("lesser general public license", "lgpl", ["2", "2.1", "3"]),
        "lgpl-library": ("library general public license", "lgpl", ["2"]),
        "agpl": ("affero general public license", "agpl", ["1", "3"]),
        "fdl": ("free documentation license", "gfdl", ["1.1", "1.2", "1.3"]),
    }
    for family, (name, short, versions) in gnu.items():
        label = family.split("-")[0]
        for v, words in _numbered("{name} v|version? {v}", versions, name=name):
            add(f"{label}-{v}", GRANT, name.split()[0] if family != "gpl" else "general", f"under the terms of the gnu? {words}", f"licensed under the gnu? {words}")
            add(f"{label}-{v}", NAME, name.split()[0] if family != "gpl" else "general", f"gnu? {words}", f"gnu? {name} as published by the free software foundation either? version {v.replace('.', ' ')}")
            add(f"{label}-{v}", MENTION, short, f"{short} v|version? {v.replace('.', ' ')}")
            joined = f"{short}v{v.replace('.', ' ')}"
            add(f"{label}-{v}", MENTION, joined.split()[0], joined)
            for tail in ("", " only", " or later"):
                add(f"{label}-{v}", TAG, "spdx", f"spdx license identifier {short} {v.replace('.', ' ')} 0?{tail}")
        add(label, MENTION, name.split()[0] if family != "gpl" else "general", f"gnu {name}")
    # Creative Commons: every combination of its elements, as code and in words.
    spelled = {"by": "attribution", "nc": "noncommercial|commercial", "sa": "sharealike|alike", "nd": "noderivatives|noderivs|derivatives"}
    for combo in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
        label = "cc-" + combo.replace(" ", "-")
        add(label, MENTION, "cc", f"cc {combo}")
        words = " ".join(f"non|share|no? {spelled[x]}" if x != "by" else spelled[x] for x in combo.split())
        add(label, NAME, "commons", f"creative commons {words}")
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            number = v.replace(".", " ")
            add(f"{label}-{v}", NAME, "cc", f"cc {combo} {number}")
            add(f"{label}-{v}", TAG, "spdx", f"spdx license identifier cc {combo} {number}")
            add(f"{label}-{v}", TAG, "creativecommons", f"creativecommons org licenses {combo} {number}")
            add(f"{label}-{v}", GRANT, "commons", f"creative commons {words} {number}", f"creative commons {words} international|unported|generic? license version? {number}")
    add("cc0-1.0", TAG, "spdx", "spdx license identifier cc0 1 0")
    add("cc0-1.0", TAG, "creativecommons", "creativecommons org publicdomain zero 1 0")
    add("cc0-1.0", NAME, "cc0", "cc0 1 0", "cc0")
    add("public-domain", GRANT, "domain", "released|dedicated|placed to|into|in the public domain", "this is free and unencumbered software released into the public domain")
    # Licenses with numbered versions and a common short name.
    for label, keyword, name, versions in (
        ("apache", "apache", "apache software? license", ["1.0", "1.1", "2.0"]),
        ("mpl", "mozilla", "mozilla public license", ["1.0", "1.1", "2.0"]),
        ("epl", "eclipse", "eclipse public license", ["1.0", "2.0"]),
        ("cddl", "distribution", "common development and distribution license", ["1.0", "1.1"]),
        ("eupl", "union", "european union public licence|license", ["1.0", "1.1", "1.2"]),
        ("osl", "open", "open software license", ["1.0", "2.0", "2.1", "3.0"]),
        ("afl", "academic", "academic free license", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
        ("artistic", "artistic", "artistic license", ["1.0", "2.0"]),
        ("bsl", "boost", "boost software license", ["1.0"]),
        ("python", "python", "python software foundation license", ["2"]),
        ("php", "php", "php license", ["3.0", "3.01"]),
        ("zpl", "zope", "zope public license", ["1.1", "2.0", "2.1"]),
        ("ofl", "sil", "sil open font license", ["1.0", "1.1"]),
        ("ecl", "educational", "educational community license", ["1.0", "2.0"]),
        ("cecill", "cecill", "cecill free? software? license? agreement?", ["1.0", "1.1", "2.0", "2.1"]),
        ("upl", "universal", "universal permissive license", ["1.0"]),
        ("mulan", "mulan", "mulan permissive software license", ["1", "2"]),
        ("odbl", "database", "open database license", ["1.0"]),
        ("ipl", "ibm", "ibm public license", ["1.0"]),
        ("ncsa", "illinois", "university of illinois ncsa open source license", []),
        ("isc", "isc", "isc license", []),
        ("zlib", "zlib", "zlib libpng? license", []),
        ("unlicense", "unlicense", "the unlicense", []),
        ("wtfpl", "wtfpl", "wtfpl version? 2?", []),
        ("x11", "x11", "x11 license", []),
        ("postgresql", "postgresql", "postgresql license", []),
        ("openssl", "openssl", "openssl license", []),
        ("beerware", "beer", "beer ware license", []),
    ):
        for v, words in _numbered("{name} v|version? {v}", versions, name=name):
            add(f"{label}-{v}", GRANT, keyword, f"licensed|released|distributed under the terms? of? the? {words}")
            add(f"{label}-{v}", NAME, keyword, words)
            add(f"{label}-{v}", TAG, "spdx", f"spdx license identifier {label} {v.replace('.', ' ')}")
        add(label, MENTION if versions else NAME, keyword, name)
        add(label, TAG, "spdx", f"spdx license identifier {label}")
    # The short permissive texts, by sentences nobody writes otherwise.
    add("mit", TAG, "spdx", "spdx license identifier mit")
    add("mit", GRANT, "permission", "permission is hereby granted free of charge to any person obtaining a copy")
    add("mit", NAME, "mit", "the? mit license")
    add("mit", NAME, "licensed", "mit licensed")
    for how in ("licensed", "released", "distributed"):
        add("mit", NAME, how, f"{how} under the? mit")
    add("isc", GRANT, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee")
    add("zlib", GRANT, "misrepresented", "the origin of this software must not be misrepresented")
    for n, clause in ((2, "simplified|freebsd"), (3, "new|modified|revised"), (4, "original|old")):
        add(f"bsd-{n}-clause", TAG, "spdx", f"spdx license identifier bsd {n} clause")
        add(f"bsd-{n}-clause", NAME, "bsd", f"bsd {n} clause license?", f"{n} clause bsd license?", f"{clause} bsd license")
    add("bsd", GRANT, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted")
    add("bsd", MENTION, "bsd", "bsd license", "bsd style license")
    add("bsd", MENTION, "berkeley", "berkeley software distribution license")
    add("proprietary", GRANT, "reserved", "all rights reserved")
    add("proprietary", GRANT, "proprietary", "proprietary and confidential", "this software is proprietary")
    return list(dict.fromkeys(rules))


RULES = _rules()


KEYWORDS = sorted({r.keyword for r in RULES})
#: Finds a gate word that stands alone, or beside a letter beyond ASCII.
GATE = rf"(?<![a-z0-9])(?:{'|'.join(sorted({r.gate for r in RULES}))})(?![a-z0-9])"
#: ITEM_WORD for texts that are not lower-cased yet.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_LABELS = "array<struct<label:string,priority:int>>"


def spaced(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def _words_before(at: Column) -> Column:
    """Words before character ``at`` (from 1) of the spaced text, which has two spaces for each."""
    head = F.substring(F.col("spaced"), F.lit(1), at - 1)
    return F.floor((F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit("")))) / 2).cast("long")


def _places(rule: Column) -> Column:
    """All matches of a rule: what lies between them and they themselves tell where they are."""
    between, found = F.split("spaced", rule["pattern"], -1), F.regexp_extract_all("spaced", rule["pattern"], F.lit(0))
    gaps = F.zip_with(found, between, lambda m, b: F.struct(F.length(b).alias("gap"), F.length(m).alias("size")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,minus_end:int,priority:int,label:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        one = F.struct(begin.alias("start"), (-begin - x["size"]).alias("minus_end"), rule["priority"].alias("priority"), rule["label"].alias("label"))
        return F.struct((begin + x["size"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    # The text after the last match has no match to its right.
    return F.aggregate(F.filter(gaps, lambda g: g["size"].isNotNull()), start, step)["out"]


def _surviving(hits: Column) -> Column:
    """Labels and priorities of hits that no earlier hit of at least their priority contains.

    ``hits`` are sorted by start, longest first, then priority, so whatever
    contains a hit comes before it; per priority the furthest end so far is
    all that is needed.
    """
    levels = range(len(SCORES))
    start = F.struct(F.array(*(F.lit(0) for _ in levels)).alias("ends"), F.array().cast(NO_LABELS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["minus_end"]
        reach = F.array_max(F.slice(acc["ends"], F.lit(1), x["priority"] + 1))
        ends = F.transform(acc["ends"], lambda e, i: F.when(i == x["priority"], F.greatest(e, end)).otherwise(e))
        kept = F.struct(x["label"].alias("label"), x["priority"].alias("priority"))
        # Labels repeat; one of each is enough.
        new = (reach < end) & ~F.array_contains(acc["out"], kept)
        return F.struct(ends.alias("ends"), F.when(new, F.concat(acc["out"], F.array(kept))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(hits, start, step)["out"]


def licenses(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its words, the base phrases' places, the labels and the score."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = documents.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.regexp_count(text, F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"))
    words = F.regexp_extract_all(ascii_lower(F.col("_text")), F.lit(ITEM_WORD), 0)
    # Most texts hold no keyword and go no further.
    df = df.withColumn("spaced", F.when(F.lower("_text").rlike(GATE), F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))).otherwise("")).drop("_text")
    df = df.withColumn("_present", F.when(F.col("spaced") != "", F.filter(F.array(*(F.lit(f" {k} ") for k in KEYWORDS)), lambda k: F.contains(F.col("spaced"), k))))
    # As one literal: hundreds of nested expressions would keep the planner busy for seconds.
    listed_rules = json.dumps([{"keyword": f" {r.keyword} ", "pattern": r.pattern, "label": r.label, "priority": r.priority} for r in RULES])
    rules = F.from_json(F.lit(listed_rules), "array<struct<keyword:string,pattern:string,label:string,priority:int>>")
    active = F.filter(rules, lambda r: F.array_contains("_present", r["keyword"]))
    df = df.withColumn("_active", F.when(F.size("_present") > 0, active))
    df = df.withColumn("_hits", F.when(F.size("_active") > 0, F.sort_array(F.flatten(F.transform("_active", _places)))))
    df = df.withColumn("found", F.coalesce(_surviving(F.col("_hits")), F.array().cast(NO_LABELS)))

    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        stretch = spaced(phrase)
        n = ((F.length("spaced") - F.length(F.replace(F.col("spaced"), F.lit(stretch), F.lit("")))) / len(stretch)).cast("long")
        first, last = F.instr("spaced", F.lit(stretch)), F.instr(F.reverse("spaced"), F.lit(stretch[::-1]))
        counts.append(n)
        firsts.append(F.when(first > 0, first))
        lasts.append(F.when(last > 0, F.length("spaced") - (last - 1) - len(stretch) + 1))
        labels.append(F.when(n > 0, F.lit(label)))
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base = F.array_compact(F.array(*labels))
    scores = F.array(*map(F.lit, SCORES))
    best = F.array_min(F.transform("found", lambda x: x["priority"]))
    df = df.withColumn("_base", base)
    return df.select(
        "doc_id", "n_words", sum(counts[1:], counts[0]).alias("n_base"), _words_before(F.least(*firsts)).alias("first_word"), _words_before(F.greatest(*lasts)).alias("last_word"),
        listed(F.col("_base")).alias("base_labels"), listed(F.concat("_base", F.transform("found", lambda x: x["label"]))).alias("labels"),
        F.coalesce(F.get(scores, F.least(best, F.when(F.size("_base") > 0, GRANT))), F.lit(0.0)).alias("score"),
    )


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
