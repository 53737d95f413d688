"""The most similar other names of every card: a self-join by similarity that loses no pair.

Names are compared once, however many cards have them, and no name meets one
that it cannot be among the best of.

1. Names with a letter deleted are looked up in each other: two names that
   share such a form are close, and what shares none is at most so similar as
   their lengths allow.  Names whose best are better than that are done; the
   others are looked up once more with two letters deleted.  Names of one
   length that share a form are at least so similar as it is long, so of each
   form, length and kind the few smallest cards are enough: whoever comes
   after them comes after them in every list.  However many names share a
   form, a name meets a bounded number of them.
2. The others look for all names that may still enter their best.  The
   similarity that it takes fixes how many letters d may be inserted or
   deleted, so of d + 1 pieces of the other name one comes through unchanged,
   shifted by no more than what was inserted or deleted: the pieces are an
   inverted index, by the name's length, number of pieces and piece.

Whatever meets is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.functions.similarity import ratios
from ledgerloom.storage import broadcast_if_small, divided, shuffled, stored

#: Below this similarity a name may have fewer letters than pieces.
LOWEST = 67
#: Numbers of pieces in which names are indexed.
GRAINS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
#: Letters that the rounds of the first step delete, and the longest names of which two are deleted: their forms grow as the square.
DELETED, LONGEST = (1, 2), 40
#: Names whose forms or pieces one task makes, hundreds of each.
NAMES_AT_ONCE = 20_000
#: Rows with a name that may be sent to every executor: some 15 MB.
SENT_ROWS = 100_000


def shortened(name: str, deleted: int = 1) -> set[str]:
    """A name as it is, and with so many letters or fewer deleted."""
    found = last = {name}
    for _ in range(deleted):
        last = {n[:k] + n[k + 1 :] for n in last for k in range(len(n))}
        found = found | last
    return found


def _shortened(deleted: int):
    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                rows = [(form, n) for n in batch["name"].slice(lo, 500).to_pylist() for form in shortened(n, deleted)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["form", "name"])

    return shorten


def unseen_most(length: int, lengths: list[int], deleted: int = 1) -> int:
    """The highest rounded similarity to a name of this length that a name may have which shares no shortened form with it."""
    shared = ((min(length, other, max(length, other) - deleted - 1), other) for other in lengths)
    return max((round(200 * s / (length + other)) for s, other in shared if s > 0), default=0)


def pieces(name: str, grain: int) -> list[tuple[int, str]]:
    """A name cut into so many even pieces: (start, letters)."""
    cuts = [len(name) * k // grain for k in range(grain + 1)]
    return [(a, name[a:b]) for a, b in pairwise(cuts)]


def probes(name: str, least: float, lengths: list[int]) -> set[str]:
    """Keys of all pieces that a name similar enough may have unchanged."""
    found, n = set(), len(name)
    for other in lengths:
        d = int((1 - least / 100) * (n + other) + 1e-9)
        d -= (n + other - d) % 2
        if d < abs(n - other):
            continue
        ours, theirs = (d + n - other) // 2, (d - n + other) // 2
        grain = next(g for g in GRAINS if g > d)
        cuts = [other * k // grain for k in range(grain + 1)]
        for i, (a, b) in enumerate(pairwise(cuts)):
            found |= {f"{other}.{grain}.{i}.{name[p : p + b - a]}" for p in range(max(0, a - theirs), min(n - (b - a), a + ours) + 1)}
    return found


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(f"{len(n)}.{g}.{i}.{piece}", n) for n in batch["name"].to_pylist() for g in GRAINS if g < 2 * len(n) + 2 for i, (_, piece) in enumerate(pieces(n, g))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["key", "other"])


def _probing(lengths: list[int]):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, n) for n, least in zip(batch["name"].to_pylist(), batch["least"].to_pylist(), strict=True) for key in probes(n, least, lengths)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["key", "name"])

    return probe


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = ratios(batch["name"].to_pylist(), batch["other"].to_pylist())
        yield pa.RecordBatch.from_arrays([batch["name"], batch["other"], pa.array(s)], ["name", "other", "ratio"])


def scored(pairs: DataFrame, least: float) -> DataFrame:
    """(name, other, score) of pairs that are similar enough, rounded half to even as scores are shown."""
    found = pairs.select("name", "other").mapInArrow(_scored, "name string, other string, ratio double").where(F.col("ratio") >= least)
    return found.select("name", "other", F.bround("ratio", 0).cast("int").alias("score"))


def _first(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    nth = F.row_number().over(W.Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_nth", nth).where(F.col("_nth") <= most).drop("_nth")


def _sent(table: DataFrame) -> DataFrame:
    """A stored table of names, sent to every executor if it is counted and small; no join here is left to Spark's guess."""
    return broadcast_if_small(table, SENT_ROWS)


def _lists(pairs: DataFrame, holders: DataFrame, most: int) -> DataFrame:
    """(name, kind, confuser, score): the best ``most`` cards for a name as a first and as a second name.

    First names are compared with both names of others, second names with
    first names alone.
    """
    theirs = holders.withColumnRenamed("name", "other").withColumnRenamed("kind", "their")
    met = pairs.join(_sent(theirs), "other").withColumn("kind", F.explode(F.when(F.col("their") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    best = met.groupBy("name", "kind", "confuser").agg(F.max("score").alias("score"))
    return _first(best, ["name", "kind"], [F.desc("score"), F.col("confuser")], most)


def _sharing(names: DataFrame, holders: DataFrame, deleted: int, most: int, some: bool) -> DataFrame:
    """(name, other): of the names that share a form with a name, for each length and kind those of the ``most`` smallest cards.

    Where ``some`` names ask, only forms that one of them has go further.
    """
    longest = LONGEST if deleted > 1 else 1 << 30
    shorten = lambda df, limit: divided(df.where(F.length("name") <= limit).select("name"), NAMES_AT_ONCE).mapInArrow(_shortened(deleted), "form string, name string")
    theirs = shorten(holders.select("name").distinct(), longest + deleted)
    ours = shorten(names, longest)
    if some:
        asked = stored(ours.select("form").distinct(), "forms-asked")
        theirs = theirs.join(_sent(asked), "form", "left_semi")
    theirs = theirs.join(_sent(holders), "name").withColumnRenamed("name", "other")
    # Cards are counted, not rows: one may have several names that share a form.
    nth = F.dense_rank().over(W.Window.partitionBy("form", F.length("other"), "kind").orderBy("confuser"))
    few = theirs.withColumn("_nth", nth).where(F.col("_nth") <= most).select("form", "other").distinct()
    return ours.join(shuffled(few), "form").select("name", "other").distinct()


def _open(forms: DataFrame, lists: DataFrame, lengths: list[int], deleted: int, least: float, most: int) -> DataFrame:
    """(name, least): names that one they share no form with may still be among the best of, and the similarity that it takes."""
    fewer = lambda n: deleted if n <= LONGEST else 1
    table = F.create_map(*(F.lit(x) for n in lengths for x in (n, unseen_most(n, lengths, fewer(n))))) if lengths else F.create_map(F.lit(0), F.lit(0))
    reached = lists.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last"))
    asked = forms.select("name", "kind").distinct().join(shuffled(reached), ["name", "kind"], "left").withColumn("unseen", table[F.length("name")])
    full = F.coalesce(F.col("n") >= most, F.lit(False))
    open_ = asked.where((F.col("unseen") >= least - 0.5) & ~(full & (F.col("last") > F.col("unseen"))))
    # Scores are rounded, so half a point less than the last one may still equal it.
    needed = F.when(full, F.greatest(F.lit(float(least)), F.col("last") - 0.5)).otherwise(F.lit(float(least)))
    return open_.groupBy("name").agg(F.min(needed).alias("least"))


def all_confusers(places: DataFrame, least: float = 78, limit: int = 8, queries: DataFrame | None = None) -> DataFrame:
    """(card, confuser, score): for every card (card, norm_uk, norm_ru) the most similar other cards, of equal ones the smallest.

    With ``queries``, for their cards alone, against all places.  A null name is an empty one; empty names only equal each other; cards that
    repeat with their names count once.
    """
    if least < LOWEST:
        raise ValueError(f"least must be {LOWEST} or more")
    named = F.posexplode(F.array(F.coalesce("norm_uk", F.lit("")), F.coalesce("norm_ru", F.lit("")))).alias("kind", "name")
    forms = stored(places.select("card", named).distinct(), "name-forms")
    asking = forms if queries is None else stored(queries.select("card", named).distinct(), "query-forms")
    # One more than the limit, as a card itself may be among them.
    most = limit + 1
    holders = stored(_first(forms.withColumnRenamed("card", "confuser"), ["name", "kind"], [F.col("confuser")], most), "name-holders")
    names = stored(forms.select("name").distinct(), "names")
    lengths = sorted(r[0] for r in names.select(F.length("name")).distinct().collect())

    close, rest = None, names if queries is None else stored(asking.select("name").distinct(), "query-names")
    for deleted in DELETED:
        met = _sharing(rest, holders, deleted, most, rest is not names)
        pairs = stored(scored(met if close is None else met.unionByName(close.select("name", "other")).distinct(), least), "names-close")
        lists = stored(_lists(pairs, holders, most), "confusers-close")
        close, rest = pairs, stored(_open(asking, lists, lengths, deleted, least, most), "names-open")
        if rest.isEmpty():
            break
    if not rest.isEmpty():
        keys = divided(rest, NAMES_AT_ONCE).mapInArrow(_probing(lengths), "key string, name string")
        index = divided(names, NAMES_AT_ONCE).mapInArrow(_indexed, "key string, other string")
        met = keys.join(shuffled(index), "key").select("name", "other").distinct()
        more = stored(scored(met, least), "names-far")
        pairs = pairs.join(_sent(rest), "name", "left_anti").unionByName(more)
        lists = stored(_lists(pairs, holders, most), "confusers-all")
    found = asking.join(_sent(lists), ["name", "kind"]).where("card <> confuser").groupBy("card", "confuser").agg(F.max("score").alias("score"))
    return _first(found, ["card"], [F.desc("score"), F.col("confuser")], limit).select("card", "confuser", "score")
