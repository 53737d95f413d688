"""Linking extracted records to known persons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.functions.similarity import FULL, PARTS_FROM, WORD_BITS, letters, weighted_ratio, weighted_ratios

# Weights of the parts of a score, and its thresholds.
WEIGHTS = {"surname": 0.40, "given": 0.30, "patronymic": 0.10, "year": 0.15, "place": 0.05}
SIGMA = 3.0
PROPOSED, REVIEWED = 0.60, 0.85
#: What surname and year count where nothing else is known, as in ``total_score`` without a patronymic.
BARE = (WEIGHTS["surname"] + WEIGHTS["patronymic"] * 4 / 7, WEIGHTS["year"])


def string_score(a: Column, b: Column) -> Column:
    """0 to 1 by the weighted ratio; nothing where either is lacking."""
    return weighted_ratio(a, b) / 100


def year_score(a: Column, b: Column) -> Column:
    """Falls off as a Gaussian with the distance in years; unknown years score nothing."""
    d = (a - b).cast("double")
    return F.coalesce(F.exp(-(d * d) / (2 * SIGMA * SIGMA)), F.lit(0.0))


def total_score(parts: dict[str, Column], has_patronymic: Column) -> Column:
    """Weighted sum; without a patronymic its weight goes to surname and given name, four to three."""
    share = WEIGHTS["patronymic"]
    full = sum((F.lit(WEIGHTS[k]) * parts[k] for k in WEIGHTS), F.lit(0.0))
    bare = sum((F.lit(WEIGHTS[k]) * parts[k] for k in ("year", "place")), F.lit(0.0))
    bare = bare + (WEIGHTS["surname"] + share * 4 / 7) * parts["surname"] + (WEIGHTS["given"] + share * 3 / 7) * parts["given"]
    return F.when(has_patronymic, full).otherwise(bare)


def best_person(scored: DataFrame, record: str = "record_id", person: str = "person_id") -> DataFrame:
    """The best-scoring person of each record, the first of equals, with the standing that the score gives."""
    best = scored.groupBy(record).agg(F.max_by(F.struct(person, "score"), F.struct("score", (-F.col(person)).alias("p"))).alias("b"))
    status = F.when(F.col("b.score") >= REVIEWED, "reviewing").otherwise("new")
    return best.select(record, F.when(F.col("b.score") >= PROPOSED, F.col(f"b.{person}")).alias("proposed"), F.col("b.score").alias("score"), status.alias("status"))


def candidate_pairs(records: DataFrame, persons: DataFrame, *blocks: Column) -> DataFrame:
    """Pairs that agree on at least one blocking key: an equality join for each, united."""
    found = None
    for k in blocks:
        a, b = records.withColumn("_k", k), persons.withColumn("_k", k)
        one = a.join(b.withColumnsRenamed({c: f"p_{c}" for c in persons.columns}), "_k").drop("_k")
        found = one if found is None else found.union(one)
    return found if len(blocks) == 1 else found.distinct()


#: Records and persons of a block that one task compares at a time.
RECORDS_AT_ONCE, PERSONS_AT_ONCE = 2000, 4000


class Names:
    """Names that many others are compared with: their letters as columns, those that all share read once for all."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.lengths = np.fromiter(map(len, names), np.int64, len(names))
        self.single = np.fromiter((n != "" and not any(c.isspace() for c in n) for n in names), bool, len(names))
        codes = letters(names)
        self.alphabet, place = np.unique(codes, return_inverse=True)
        place = place.reshape(codes.shape)
        # The first place of the table is for what lies beyond a name's end.
        place = np.where(np.arange(codes.shape[1]) < self.lengths[:, None], place + 1, 0)
        self.columns = [c[:1] if (c == c[0]).all() else np.ascontiguousarray(c) for c in place.T] if names else []

    def weighted(self, word: str) -> np.ndarray:
        """weighted_ratios of a word and each name.

        Of two single words of like lengths it is their plain similarity,
        which takes one pass over the letters for all names at once.
        """
        plain = self.single & (np.maximum(self.lengths, len(word)) < PARTS_FROM * np.minimum(self.lengths, len(word)))
        if not word or len(word) > WORD_BITS or any(c.isspace() for c in word):
            plain[:] = False
        out = np.zeros(len(self.names))
        if plain.any():
            table = np.zeros(len(self.alphabet) + 1, np.uint64)
            for k, c in enumerate(word):
                at = np.searchsorted(self.alphabet, ord(c))
                if at < len(self.alphabet) and self.alphabet[at] == ord(c):
                    table[at + 1] |= np.uint64(1 << k)
            state = np.full(1, FULL)
            for column in self.columns:
                u = state & table[column]
                state = ((state + u) & FULL) | (state - u)
            common = np.bitwise_count(~state & FULL).astype(np.int64)
            out = np.where(plain, 200.0 * common / np.maximum(self.lengths + len(word), 1), 0.0)
        rest = np.flatnonzero(~plain).tolist() if word else []
        if rest:
            out[rest] = weighted_ratios([word] * len(rest), [self.names[k] for k in rest])
        return out


def _years(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def best_pairs(records: DataFrame, persons: DataFrame, block: str, person: str, weights: tuple[float, float]) -> DataFrame:
    """Of the pairs that agree on a block those that may be a record's best by name and year: the columns of ``candidate_pairs``.

    Records and persons have the block, a name and a year; ``weights`` are
    those of name and year.  All pairs of a block are compared, but only the
    best of each part of its persons leave the task that compared them, so
    what is written grows with the records, not with the pairs.  Persons alike
    in name and year count once, the smallest.
    """
    kept = persons.groupBy(block, "name", "year").agg(F.min(person).alias(person))
    counted = lambda df, size, n: df.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(n))
    parts = counted(records, RECORDS_AT_ONCE, "_rs").join(counted(kept, PERSONS_AT_ONCE, "_ps"), block)
    part = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ours = records.join(parts, block).withColumns({"_r": part("_rs", *records.columns), "_p": every("_ps")}).select(*records.columns, "_r", "_p")
    theirs = kept.join(parts, block).withColumns({"_p": part("_ps", "name", "year"), "_r": every("_rs")}).select(*kept.columns, "_r", "_p")
    fields = [*records.schema.fields, *(T.StructField(f"p_{f.name}", f.dataType) for f in kept.schema.fields)]
    arrow = to_arrow_schema(T.StructType(fields))
    (w_name, w_year), own, other = weights, records.columns, kept.columns

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return arrow.empty_table()
        b = b.sort_by(person)
        names = [n or "" for n in b["name"].to_pylist()]
        distinct = {n: k for k, n in enumerate(dict.fromkeys(names))}
        place, known = np.array([distinct[n] for n in names]), Names(list(distinct))
        years, mine = _years(b["year"]), _years(a["year"])
        left, right = [], []
        for k, word in enumerate(a["name"].to_pylist()):
            s = known.weighted(word or "")[place] / 100
            d = mine[k] - years
            y = np.nan_to_num(np.exp(-(d * d) / (2 * SIGMA * SIGMA)))
            total = w_name * s + w_year * y
            near = np.flatnonzero(total >= total.max() - 1e-9)
            # Of equal parts the first person; sums that only rounding tells apart all stay.
            first: dict[tuple[float, float], int] = {}
            for i in near.tolist():
                first.setdefault((s[i], y[i]), i)
            left += [k] * len(first)
            right += first.values()
        found = [a.column(c).take(pa.array(left)) for c in own] + [b.column(c).take(pa.array(right)) for c in other]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(found, arrow, strict=True)], schema=arrow)

    keys = [block, "_r", "_p"]
    # Comparing costs far more than moving the rows, so that few bytes are no reason for few tasks.
    spark = records.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return ours.repartition(n, *keys).groupBy(*keys).cogroup(theirs.repartition(n, *keys).groupBy(*keys)).applyInArrow(best, T.StructType(fields))
