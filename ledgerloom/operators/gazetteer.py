"""Gazetteer search: tiers of matches, cards with their cases, like-named places."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.functions.normal import matching_form
from ledgerloom.functions.similarity import could_reach, ratio_to, ratios_to
from ledgerloom.operators import nearest
from ledgerloom.storage import broadcast_if_small, shuffled, stored

FUZZY_LEAST, LATIN_LEAST, CONFUSER_LEAST = 82, 84, 78


def exact_score(q: str, name: Column, other: Column) -> Column:
    """100 for an equal name, 92 for a prefix, 84 for an infix."""
    either = lambda f: f(name) | f(other)
    return F.when(either(lambda c: c == q), 100).when(either(lambda c: c.startswith(q)), 92).when(either(lambda c: c.contains(q)), 84)


def fuzzy_score(q: str, name: Column, other: Column, translit: Column | None = None) -> Column:
    """0.8 of the similarity or 0.7 of the Latin one, compared only where a piece of the query occurs."""
    near = lambda c: F.when(could_reach(q, FUZZY_LEAST, c), ratio_to(q, c))
    similar = F.greatest(near(name), near(other))
    fuzzy = F.when(similar >= FUZZY_LEAST, F.floor(similar * 0.8).cast("int"))
    if translit is not None and any("a" <= c.lower() <= "z" for c in q):
        forms = F.filter(F.split(translit, " "), lambda x: x != "")
        latin = F.when(could_reach(q, LATIN_LEAST, translit), F.array_max(F.transform(forms, lambda x: ratio_to(q, x))))
        fuzzy = F.coalesce(fuzzy, F.when(latin >= LATIN_LEAST, F.floor(latin * 0.7).cast("int")))
    return fuzzy


def find_places(places: DataFrame, q: str, limit: int | None = None) -> DataFrame:
    """Places (card, norm_uk, norm_ru, n_cases, ...) by tier, best first.

    The looser tier adds rows only where the stricter ones give fewer than
    ``limit``: it scores below them all, so otherwise nothing is compared.
    """
    if not q:
        scored = places.withColumn("score", F.lit(0))
    else:
        # Each name once, its forms worked out and stored: what follows compares short strings.
        forms = ["norm_uk", "norm_ru", *(["translit"] if "translit" in places.columns else [])]
        blank = {c: F.coalesce(c, F.lit("")) for c in forms}
        names = stored(places.select(*(v.alias(c) for c, v in blank.items())).distinct(), "place-names")
        either = F.col("norm_uk"), F.col("norm_ru")
        exact = names.withColumn("score", exact_score(q, *either))
        hits = exact.where("score is not null")
        found = places.withColumns(blank)
        scored = found.join(broadcast_if_small(stored(hits, "names-exact")), forms)
        if limit is None or scored.select("card").distinct().limit(limit).count() < limit:
            translit = F.col("translit") if "translit" in forms else None
            hits = exact.withColumn("score", F.coalesce("score", fuzzy_score(q, *either, translit))).where("score is not null")
            scored = found.join(broadcast_if_small(stored(hits, "names-near")), forms)
        scored = scored.select(*places.columns, "score")
    best = F.row_number().over(W.Window.partitionBy("card").orderBy(F.desc("score")))
    scored = scored.withColumn("_nth", best).where("_nth = 1").drop("_nth")
    ordered = scored.orderBy(F.desc("score"), F.desc("n_cases"), "card")
    return ordered.limit(limit) if limit else ordered


#: Tasks that the cards of one name and section are dealt out to.
SIBLING_DEALS = 32


def siblings(places: DataFrame, mine: DataFrame | None = None) -> DataFrame:
    """Pairs (card, sibling) with an equal name in either column and different sections; of the cards ``mine``, all by default.

    An OR of two equalities would compare all pairs, and pairs made by each
    equality would all be shuffled to drop those found twice.  So names and
    sections are paired, by a join for each equality, however many cards have
    them; cards meet through these, each pair once, and only pairs with a card
    that has several names or sections are told apart afterwards.  Namesakes
    are dealt out, as a few names may be those of most cards.
    """
    mine = places if mine is None else mine
    kind = F.struct("norm_uk", "norm_ru", "section")
    kinds = lambda df: df.select(kind.alias("_g")).distinct()

    def by(name: str) -> DataFrame:
        a = kinds(mine).select("_g", F.col(f"_g.{name}").alias("_name"))
        b = kinds(places).select(F.col("_g").alias("_other"), F.col(f"_g.{name}").alias("_name"))
        return a.join(shuffled(b), "_name").where("_g.section <> _other.section").select("_g", "_other")

    linked = by("norm_uk").union(by("norm_ru")).distinct()
    asked = mine.select("card", kind.alias("_g")).join(shuffled(linked), "_g").select("card", "_other").distinct()
    dealt = asked.withColumn("_deal", F.explode(F.array(*(F.lit(k) for k in range(SIBLING_DEALS)))))
    theirs = places.select(F.col("card").alias("sibling"), kind.alias("_other")).distinct()
    counted = theirs.groupBy("sibling").agg(F.count(F.lit(1)).alias("_n"), F.min("_other").alias("_other"))

    def pairs(some: DataFrame) -> DataFrame:
        met = some.withColumn("_deal", F.pmod(F.hash("sibling"), F.lit(SIBLING_DEALS))).join(shuffled(dealt), ["_other", "_deal"])
        return met.where("card <> sibling").select("card", "sibling")

    again = theirs.join(shuffled(counted.where("_n > 1").select("sibling")), "sibling", "left_semi")
    return pairs(counted.where("_n = 1").select("sibling", "_other")).union(pairs(again).distinct())


def sibling_classes(places: DataFrame) -> DataFrame:
    """(card, uk_class, ru_class, n_siblings) of every card: the smallest card of each of its names, and its number of siblings.

    The pairs that ``siblings`` lists follow from it: two cards with a class in
    common and different sections.  Cards are counted by names and section,
    and the counts of the one name and of the other less those of both, each
    without the own section, are the number, so nothing is paired.
    """
    both = ["norm_uk", "norm_ru"]
    groups = stored(places.groupBy(*both, "section").agg(F.count("section").alias("_n"), F.min("card").alias("_first")), "namesakes")

    def others(*names: str) -> Column:
        total = lambda *by: F.sum("_n").over(W.Window.partitionBy(*by))
        known = F.lit(True)
        for c in names:
            known = known & F.col(c).isNotNull()
        return F.when(known, total(*names) - total(*names, "section")).otherwise(0)

    least = lambda name: F.when(F.col(name).isNotNull(), F.min("_first").over(W.Window.partitionBy(name)))
    n = F.when(F.col("section").isNotNull(), others("norm_uk") + others("norm_ru") - others(*both)).otherwise(0)
    counted = stored(groups.select(F.struct(*both, "section").alias("_g"), least("norm_uk").alias("uk_class"), least("norm_ru").alias("ru_class"), n.alias("n_siblings")), "sibling-counts")
    return places.select("card", F.struct(*both, "section").alias("_g")).join(broadcast_if_small(counted), "_g").drop("_g")


#: Query cards that one pass over the places compares.
CONFUSER_BLOCK = 2000


def _confused(queries: list, least: float, limit: int, schema: T.StructType):
    """A comparison of places with some query cards: from each batch the best of each card."""

    arrow = to_arrow_schema(schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Names are compared once, however many places have them.
            place: dict[str, int] = {}
            uk, ru = (np.fromiter((place.setdefault(n or "", len(place)) for n in batch[c].to_pylist()), np.int64, len(batch)) for c in ("norm_uk", "norm_ru"))
            names, cards = list(place), np.array(batch["confuser"].to_pylist(), object)
            lengths = np.fromiter(map(len, names), np.int64, len(names))
            # Places by card, to break ties.
            turn = np.empty(len(cards), np.int64)
            turn[np.argsort(cards, kind="stable")] = np.arange(len(cards))

            def scores(word: str) -> np.ndarray:
                out = np.zeros(len(names))
                # 200 * min / (a + b) bounds the similarity from above.
                near = np.flatnonzero(200.0 * np.minimum(lengths, len(word)) >= least * (lengths + len(word)))
                out[near] = ratios_to(word, [names[k] for k in near.tolist()])
                return out

            for card, own_uk, own_ru in queries:
                first = scores(own_uk)
                second = first if own_ru == own_uk else scores(own_ru)
                s = np.maximum(np.maximum(first[uk], first[ru]), second[uk])
                hit = np.flatnonzero((s >= least) & (cards != card))
                rounded = np.rint(s[hit]).astype(np.int32)
                top = np.lexsort((turn[hit], -rounded))[:limit]
                columns = ([card] * len(top), cards[hit][top].tolist(), rounded[top])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return compare


def confusers(places: DataFrame, queries: DataFrame, least: float = CONFUSER_LEAST, limit: int = 8) -> DataFrame:
    """For each card of a stated set of queries, the most similar names of other cards.

    Names meet through forms with letters deleted and an index of pieces (see
    ``nearest``), so that a query meets a bounded number of close names and
    not all places.  Where so little similarity is asked for that pieces say
    nothing, the queries go to the places in blocks of CONFUSER_BLOCK, a pass
    each; a batch of places sends on the best few of each query alone.
    """
    if least >= nearest.LOWEST:
        return nearest.all_confusers(places, least, limit, queries)
    spark = places.sparkSession
    # Comparing costs far more than moving the names, so they are dealt out however few files they come from.
    rows = places.select(F.col("card").alias("confuser"), "norm_uk", "norm_ru").repartition(spark.sparkContext.defaultParallelism)
    kind = places.schema["card"].dataType
    schema = T.StructType([T.StructField("card", kind), T.StructField("confuser", kind), T.StructField("score", T.IntegerType())])
    asked = queries.select("card", F.coalesce("norm_uk", F.lit("")), F.coalesce("norm_ru", F.lit(""))).toLocalIterator()
    found = None
    while block := [tuple(r) for r in islice(asked, CONFUSER_BLOCK)]:
        one = stored(rows.mapInArrow(_confused(block, least, limit, schema), schema), "confusers")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], schema)
    nth = F.row_number().over(W.Window.partitionBy("card").orderBy(F.desc("score"), "confuser"))
    return found.withColumn("_nth", nth).where(F.col("_nth") <= limit).drop("_nth")


def place_cards(places: DataFrame, cases: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Each place with how many of its cases there are and how many are on disk."""
    held = cases.join(on_disk.select("fund", "case", F.lit(True).alias("_held")).distinct(), ["fund", "case"], "left")
    counts = held.groupBy("card").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.coalesce("_held", F.lit(False))).alias("n_on_disk"), F.min(F.nullif("year_from", F.lit(0))).alias("year_from"), F.max("year_to").alias("year_to"))
    return places.join(counts, "card", "left").fillna(0, ["n_cases", "n_on_disk"])


def merged_by_mark(cases: DataFrame) -> DataFrame:
    """Rows of one shelf mark as one: parishes in order of appearance, years, how many."""
    parishes = F.transform(F.array_sort(F.collect_list(F.when(F.col("parish") != "", F.struct("position", "parish")))), lambda x: x["parish"])
    return cases.groupBy("card", "mark").agg(F.array_distinct(parishes).alias("parishes"), F.min(F.nullif("year_from", F.lit(0))).alias("year_from"), F.max("year_to").alias("year_to"), F.count(F.lit(1)).alias("n"))


def places_of_fund(cases: DataFrame, places: DataFrame) -> DataFrame:
    """Villages of each (inventory, case): the first two and how many more."""
    named = cases.join(places.select("card", "name"), "card")
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]))
    out = named.groupBy("inventory", "case").agg(names.alias("names"))
    more = F.when(F.size("names") > 2, F.concat(F.lit(" +"), (F.size("names") - 2).cast("string"))).otherwise("")
    return out.select("inventory", "case", F.concat(F.array_join(F.slice("names", 1, 2), ", "), more).alias("label"))


def best_with_margin(scored: DataFrame, key: str, least: float = 93, margin: float = 3) -> DataFrame:
    """The best match of each key if it is good enough and clearly ahead of the second."""
    w = W.Window.partitionBy(key).orderBy(F.desc("score"), "candidate")
    ranked = scored.withColumn("_nth", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w))
    return ranked.where((F.col("_nth") == 1) & (F.col("score") >= least) & (F.col("score") - F.coalesce("_next", F.lit(0)) >= margin)).drop("_nth", "_next")


def unique_or_strongest(candidates: DataFrame, key: str) -> DataFrame:
    """One candidate per key if it is alone at the highest strength; ambiguity gives none."""
    top = candidates.groupBy(key).agg(F.max(F.struct("strength", "candidate")).alias("_best"), F.max("strength").alias("_top"))
    at_top = candidates.join(top, key).where(F.col("strength") == F.col("_top")).groupBy(key).agg(F.count_distinct("candidate").alias("_n"))
    return top.join(at_top, key).where("_n = 1").select(key, F.col("_best.candidate").alias("candidate"))


def with_latin_forms(places: DataFrame) -> DataFrame:
    """Places with the matching forms of both their names, for queries in Latin script."""
    forms = F.array_distinct(F.filter(F.array(matching_form(F.col("name_uk")), matching_form(F.col("name_ru"))), lambda x: x != ""))
    return places.withColumn("translit", F.array_join(forms, " "))


# Endings of districts' adjectives in the matching form, and the least similarity of roots.
ADJECTIVE_ENDINGS = ("skogo", "skomu", "skoi", "skii", "skij", "skiy", "skoy", "ska", "sk")
ROOT_LEAST, ROOT_LETTERS = 80, 3


def place_root(c: Column) -> Column:
    """The matching form of a place without an adjective's ending, if four letters are left of it."""
    form = matching_form(c)
    return F.coalesce(F.nullif(F.regexp_extract(form, rf"^(.{{4,}}?)(?:{'|'.join(ADJECTIVE_ENDINGS)})$", 1), F.lit("")), form)


def of_place(rows: DataFrame, q: str, *columns: str) -> DataFrame:
    """Rows that name a place in one of some columns, in whatever script, case or derived form.

    Roots are compared: one begins the other, or they are much alike.  Whole
    forms would not do, as districts share their endings.
    """
    root = rows.sparkSession.range(1).select(place_root(F.lit(q)).alias("r")).first()["r"]
    if len(root) < ROOT_LETTERS:
        return rows.limit(0)
    marked = rows.withColumn("_roots", F.filter(F.array(*(place_root(F.col(c)) for c in columns)), lambda r: r != ""))
    begins = F.exists("_roots", lambda r: r.startswith(root) | F.startswith(F.lit(root), r))
    alike = F.exists("_roots", lambda r: (F.length(r) >= ROOT_LETTERS) & (ratio_to(root, r) >= ROOT_LEAST))
    return marked.where(begins | alike).drop("_roots")
