"""Search in machine-read text: lines, candidate words, fuzzy scores, context."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.functions.similarity import could_reach, partial_ratios_to, pieces_needed, ratios_to

# What separates words, and how much a line must say to count.
TOKEN = "[^\\s.,;:()\\[\\]{}/\\\\|«»\"'’—–-]+"
MEANINGFUL, MOST_LINES = 24, 4


def lines_of(pages: DataFrame, text: str = "text") -> DataFrame:
    """A row per line: (run, page, line_no, line), numbers from 1."""
    return pages.select("run", "page", F.posexplode(F.split(text, "\n", -1)).alias("_at", "line")).select("run", "page", (F.col("_at") + 1).alias("line_no"), "line")


#: Lines before a line whose last words a broken word may begin with.
BEFORE = 3


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("(?U)" + TOKEN), 0)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small input, of fewer parts than there are cores, dealt out; a large one as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def page_candidates(pages: DataFrame, normal=F.lower, text: str = "text") -> DataFrame:
    """Words a name may be hiding in, of pages with their whole text: each page is one row, so its lines are not brought together by a shuffle."""
    return _exploded(_page_lines(pages, text), normal)


def line_candidates(pages: DataFrame, normal=F.lower, text: str = "text") -> DataFrame:
    """(run, page, line_no, candidates): the same with those of a line as an array of (surface, norm) in order, for what is asked of lines; nothing is shuffled."""
    lines = _page_lines(pages, text)
    listed = F.transform(_listed(), lambda c: F.struct(c["surface"].alias("surface"), normal(c["raw"]).alias("norm")))
    # Generated, so that whatever reads the array several times does not make it several times.
    return lines.select("run", "page", "line_no", F.explode(F.array(listed)).alias("candidates"))


def _page_lines(pages: DataFrame, text: str) -> DataFrame:
    """Lines with words, as tokens (_t) with the last words of the lines before (_p1, _p2, _p3)."""
    pages = spread(pages.select("run", "page", text))
    numbered = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct((i + 1).alias("line_no"), _tokens(line).alias("_t")))
    df = pages.select("run", "page", F.filter(numbered, lambda x: F.size(x["_t"]) > 0).alias("_ls"))
    last = lambda i: F.element_at(F.get("_ls", i)["_t"], -1)
    with_before = F.transform("_ls", lambda x, i: F.struct(x["line_no"].alias("line_no"), x["_t"].alias("_t"), *(last(i - k).alias(f"_p{k}") for k in range(1, BEFORE + 1))))
    return df.select("run", "page", F.explode(with_before).alias("_l")).select("run", "page", "_l.*")


def candidates(lines: DataFrame, normal=F.lower) -> DataFrame:
    """Words a name may be hiding in: single ones, neighbours joined, and words broken over line ends.

    (run, page, line_no, ord, surface, norm), ord being the order in which
    equal scores are preferred.  For tables of lines; where a page is one row,
    ``page_candidates`` gives the same without bringing its lines together.
    """
    w = W.Window.partitionBy("run", "page").orderBy("line_no")
    df = lines.withColumn("_t", _tokens(F.col("line"))).where("size(_t) > 0")
    return _exploded(df.withColumns({f"_p{k}": F.lag(F.element_at("_t", -1), k).over(w) for k in range(1, BEFORE + 1)}), normal)


def _listed() -> Column:
    """Candidates (surface, raw) of a line as tokens (_t) with the last words of the lines before (_p1, _p2, _p3)."""
    first = F.get("_t", F.lit(0))
    none = F.array().cast("array<struct<surface:string,raw:string>>")

    def broken(back: int) -> Column:
        prev = F.col(f"_p{back}")
        ok = (F.length(prev) + F.length(first) >= 7) & (F.lit(back == 1) | ((F.length(prev) >= 3) & (F.length(first) >= 3)))
        mark = "-" if back == 1 else f"-{back}⏎"
        one = F.struct(F.concat(prev, F.lit(mark), first).alias("surface"), F.concat(prev, first).alias("raw"))
        return F.when(ok, F.array(one)).otherwise(none)

    def at(i: Column) -> Column:
        a, b, c = (F.get("_t", i + k) for k in range(3))
        item = lambda *parts: F.array(F.struct(F.concat_ws(" ", *parts).alias("surface"), F.concat(*parts).alias("raw")))
        one = F.when(F.length(a) >= 4, item(a)).otherwise(none)
        two = F.when(F.length(a) + F.length(b) >= 6, item(a, b)).otherwise(none)
        short = (F.length(a) <= 8) & (F.length(b) <= 8) & (F.length(c) <= 8)
        three = F.when(short & (F.length(a) + F.length(b) + F.length(c) >= 9), item(a, b, c)).otherwise(none)
        return F.concat(one, two, three)

    inside = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_t") - 1), at))
    return F.concat(broken(1), broken(2), broken(3), inside)


def _exploded(df: DataFrame, normal) -> DataFrame:
    """A row for each candidate of such lines."""
    exploded = df.select("run", "page", "line_no", F.posexplode(_listed()).alias("ord", "_c"))
    return exploded.select("run", "page", "line_no", "ord", F.col("_c.surface").alias("surface"), normal(F.col("_c.raw")).alias("norm"))


#: The same words for Python, whose \\s holds some control characters that are no white space.
PYTHON_TOKEN = re.compile(TOKEN.replace("\\s", "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"))
#: Rows that travel together.
NEAR = 20_000


def _fold(s: str) -> str:
    """Small letters, of a sigma the same one at the end of a word and inside."""
    return s.lower().replace("ς", "σ")


def _shorter_joined(p: list[str], first: str) -> Iterator[tuple[int, str, str]]:
    """(ord, surface, raw) of a line's first word joined to the last words of the lines before, the nearest first."""
    for back, prev in enumerate(p, 1):
        if len(prev) + len(first) >= 7 and (back == 1 or len(prev) >= 3 and len(first) >= 3):
            yield back - 1, prev + ("-" if back == 1 else f"-{back}⏎") + first, prev + first


def _with_piece(words: list[str], pieces: list[str]) -> set[tuple[int, int]]:
    """(first word, number of words) of the stretches of up to three words that have a piece, once they are joined."""
    n, joined = len(words), "".join(words)
    low = _fold(joined)
    if len(low) != len(joined):
        return {(i, k) for i in range(n) for k in (1, 2, 3) if i + k <= n}
    starts, found = [], set()
    for piece in pieces:
        at = low.find(piece)
        while at >= 0:
            starts = starts or [0, *accumulate(map(len, words))]
            a, b = bisect_right(starts, at) - 1, bisect_right(starts, at + len(piece) - 1) - 1
            found |= {(i, k) for i in range(max(0, b - 2), a + 1) for k in range(b - i + 1, 4) if i + k <= n}
            at = low.find(piece, at + 1)
    return found


def near_in_page(text: str, pieces: list[str]) -> Iterator[tuple[int, int, str, str]]:
    """(line_no, ord, surface, raw) of the candidates of a page that have one of the pieces; ord orders a line's candidates."""
    before: list[str] = []
    for line_no, line in enumerate(text.split("\n"), 1):
        words = PYTHON_TOKEN.findall(line)
        if not words:
            continue
        for ord_, surface, raw in _shorter_joined(before, words[0]):
            low = _fold(raw)
            if any(p in low for p in pieces):
                yield line_no, ord_, surface, raw
        for i, k in sorted(_with_piece(words, pieces)):
            part = words[i : i + k]
            size = sum(map(len, part))
            if size >= (4, 6, 9)[k - 1] and (k < 3 or max(map(len, part)) <= 8):
                yield line_no, BEFORE + 3 * i + k - 1, " ".join(part), "".join(part)
        before = [words[-1], *before[: BEFORE - 1]]


def near_candidates(pages: DataFrame, stems: list[str], least: float, text: str = "text") -> DataFrame:
    """Those candidates of pages that may reach ``least`` for some stem, as ``page_candidates`` has them for F.lower.

    What has no piece of a stem is not listed at all: a line is read word by
    word only around the places where its words, joined, have one.  ``ord``
    orders a line's candidates alike, with gaps.
    """
    needed = [pieces_needed(s, least) for s in _usable(stems)]
    if any("" in p for p in needed):
        return page_candidates(pages, F.lower, text)
    pieces = sorted({_fold(p) for p in set().union(*needed)})
    source = spread(pages.select("run", "page", text))
    schema = T.StructType([*source.schema.fields[:2], T.StructField("line_no", T.IntegerType()), T.StructField("ord", T.IntegerType()), T.StructField("surface", T.StringType()), T.StructField("raw", T.StringType())])
    arrow = to_arrow_schema(schema)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            rows: list[tuple] = []
            for run, page, page_text in zip(*(batch[k].to_pylist() for k in range(3)), strict=True):
                for found in near_in_page(page_text or "", pieces):
                    rows.append((run, page, *found))
                    if len(rows) >= NEAR:
                        yield packed(rows)
                        rows = []
            if rows:
                yield packed(rows)

    return source.mapInArrow(find, schema).select("run", "page", "line_no", "ord", "surface", F.lower("raw").alias("norm"))


def best_scores(stems: list[str], norms: list[str]) -> np.ndarray:
    """The best similarity of each candidate to any stem.

    A candidate too short for a stem scores nothing by it; one no shorter than
    the stem may match it with any stretch of its length.
    """
    best = np.zeros(len(norms))
    for stem in stems:
        fit = [k for k, n in enumerate(norms) if len(n) >= max(4, int(0.6 * len(stem)))]
        best[fit] = np.maximum(best[fit], ratios_to(stem, [norms[k] for k in fit]))
        longer = [k for k in fit if len(norms[k]) >= len(stem)]
        best[longer] = np.maximum(best[longer], partial_ratios_to(stem, [norms[k] for k in longer]))
    return best


def score_to(stems: list[str], norm: Column) -> Column:
    """best_scores of a column, a batch at a time; repeated candidates are scored once."""

    @F.pandas_udf(T.DoubleType())
    def scored(norms: pd.Series) -> pd.Series:
        place, distinct = pd.factorize(norms.fillna(""))
        return pd.Series(best_scores(stems, list(distinct))[place])

    return scored(norm)


def _usable(stems: list[str]) -> list[str]:
    usable = [s for s in stems if len(s) >= 3]
    if not usable:
        raise ValueError("the query is too short")
    return usable


def scored_hits(found: DataFrame, stems: list[str], least: float, norm: str = "norm") -> DataFrame:
    """Rows whose ``norm`` reaches ``least`` for some stem, with its similarity in ``_s``.

    Rows that share no piece with a stem, and so cannot reach it, are dropped
    before anything is compared.
    """
    usable = _usable(stems)
    near = found.where(reduce(lambda a, b: a | b, [could_reach(s, least, F.col(norm)) for s in usable]))
    return near.withColumn("_s", score_to(usable, F.col(norm))).where(F.col("_s") >= least)


def search(found: DataFrame, stems: list[str], least: float = 80) -> DataFrame:
    """The best candidate of each line that reaches the threshold."""
    top = scored_hits(found, stems, least).groupBy("run", "page", "line_no").agg(F.max(F.struct("_s", (-F.col("ord")).alias("o"), "surface", "norm")).alias("b"))
    return top.select("run", "page", "line_no", (F.col("line_no") - 1).alias("line_index"), F.bround("b._s", 0).cast("int").alias("score"), F.col("b.surface").alias("surface"), F.col("b.norm").alias("norm"))


def meaning(line: Column) -> Column:
    """Characters of a line that say something: its words of three letters and more, and what is no word."""
    tokens = _tokens(line)
    rest = F.length(F.trim(F.regexp_replace(line, "(?U)" + TOKEN, "")))
    return rest + F.aggregate(tokens, F.lit(0), lambda a, t: a + F.when(F.length(t) >= 3, F.length(t)).otherwise(0))


def context(lines: DataFrame, hits: DataFrame, side: int = 2) -> DataFrame:
    """Hits with the lines before and after: outward until enough is said, four at most.

    Neighbours come from a window over each page, computed for pages with hits
    alone.
    """
    pages = hits.select("run", "page").distinct()
    near = lines.join(pages, ["run", "page"], "left_semi").withColumn("_m", meaning(F.col("line")))
    w = W.Window.partitionBy("run", "page").orderBy("line_no")
    item = F.struct(F.trim("line").alias("line"), F.col("_m").alias("m"))
    near = near.withColumn("_before", F.reverse(F.collect_list(item).over(w.rowsBetween(-MOST_LINES, -1)))).withColumn("_after", F.collect_list(item).over(w.rowsBetween(1, MOST_LINES)))

    def outward(items: Column) -> Column:
        start = F.struct(F.lit(0).alias("said"), F.array().cast("array<string>").alias("out"))
        full = lambda acc: (acc["said"] >= MEANINGFUL) & (F.size(acc["out"]) >= side)
        step = lambda acc, x: F.when(full(acc), acc).otherwise(F.struct((acc["said"] + x["m"]).alias("said"), F.concat(acc["out"], F.array(x["line"])).alias("out")))
        return F.aggregate(items, start, step)["out"]

    around = near.select("run", "page", "line_no", F.reverse(outward(F.col("_before"))).alias("before"), outward(F.col("_after")).alias("after"))
    return hits.join(around, ["run", "page", "line_no"])


def second_voice(hits: DataFrame, lines: DataFrame, runs: DataFrame) -> DataFrame:
    """The same line as another engine read it: the latest other run of the case with another engine."""
    a = runs.select("run", "case_key", "engine")
    b = runs.select(F.col("run").alias("other"), "case_key", F.col("engine").alias("_engine"), "updated")
    pair = a.join(b, "case_key").where("run <> other and engine <> _engine")
    best = pair.groupBy("run").agg(F.max_by("other", F.struct("updated", "other")).alias("other"))
    said = lines.select(F.col("run").alias("other"), "page", "line_no", F.col("line").alias("other_line"))
    return hits.join(best, "run", "left").join(said, ["other", "page", "line_no"], "left")


#: A page's lines, its share of the median characters to a line, and its contrast, by which it is suspect.
PHANTOM_LINES, PHANTOM_SHARE, FAINT = 25, 0.30, 40


def phantom_pages(pages: DataFrame, group: str = "run", least_lines: int = PHANTOM_LINES, share: float = PHANTOM_SHARE) -> DataFrame:
    """Pages with many lines but far fewer characters to a line than their run's median, if also faint or enhanced."""
    full = pages.where("lines > 0").withColumn("cpl", F.col("chars") / F.col("lines"))
    medians = full.groupBy(group).agg(F.median("cpl").alias("median_cpl"), F.count(F.lit(1)).alias("n_pages"))
    faint = F.coalesce(F.col("contrast") < FAINT, F.lit(False))
    odd = (F.col("lines") >= least_lines) & (F.col("cpl") < share * F.col("median_cpl")) & (faint | F.coalesce("enhanced", F.lit(False)))
    return full.join(medians, group).where(odd).withColumn("reason", F.when(faint, "faint").otherwise("enhanced"))


def with_neighbours(rows: DataFrame, seed: Column, group: list[str], order: str) -> DataFrame:
    """Seed rows and the rows next to them, blank ones left out."""
    w = W.Window.partitionBy(*group).orderBy(order).rowsBetween(-1, 1)
    return rows.withColumn("_near", F.max(F.coalesce(seed, F.lit(False)).cast("int")).over(w)).where("_near = 1").drop("_near")


#: Similarity from which a word is an anchor, the band in which a surname may hide, and the letters that each needs.
ANCHOR_LEAST, ANCHOR_LETTERS, SURNAME_LETTERS = 82, 5, 7
GREY, CLEAR = 60, 78


def rescue_pick(lines: DataFrame, surnames: list[str], confusers: list[str], anchors: list[str], normal=F.lower, grey: float = GREY, clear: float = CLEAR) -> DataFrame:
    """Lines (run, page, line_no, line) worth reading again, with the lines next to them.

    A line is picked if a word of it resembles an anchor, a first name or a
    patronymic of the family, or if a longer word lies in the grey band of the
    surnames and no confuser explains it better.  Surnames may match a stretch
    of a word, confusers only the whole.
    """
    words = lines.select("run", "page", "line_no", F.explode(F.regexp_extract_all("line", F.lit("(?U)" + TOKEN), 0)).alias("word")).withColumn("norm", normal(F.col("word")))

    @F.pandas_udf(T.BooleanType())
    def picked(norms: pd.Series) -> pd.Series:
        place, distinct = pd.factorize(norms.fillna(""))
        names = list(distinct)
        best = lambda stems, score: np.max([score(s, names) for s in stems], axis=0) if stems else np.zeros(len(names))
        sizes = np.fromiter(map(len, names), np.int64, len(names))
        anchored = (sizes >= ANCHOR_LETTERS) & (best(anchors, ratios_to) >= ANCHOR_LEAST)
        full, confused = best_scores(surnames, names), best(confusers, ratios_to)
        hidden = (sizes >= SURNAME_LETTERS) & (confused < full) & (full >= grey) & (full < clear)
        return pd.Series((anchored | hidden)[place])

    seeds = words.where(picked(F.col("norm"))).select("run", "page", "line_no").distinct()
    near = seeds.select("run", "page", F.explode(F.array(*(F.col("line_no") + d for d in (-1, 0, 1)))).alias("line_no")).distinct()
    return lines.where(F.trim("line") != "").join(near, ["run", "page", "line_no"], "left_semi")
