"""Quality rules by distribution divergence (DataFrame functions only).

Each document is described by two histograms: its characters by class, and
its words by which of its language's most common words they are, if any.  The
lists of common words are counted over all documents of every language there
is, and so are the references: the same histograms over all documents of a
language.  A document whose Jensen-Shannon distance to the reference of its
language is large does not read like prose of it.  Histograms of short
documents are noisy, so below a minimum length the distances decide nothing,
nor do references of languages with few words in all.

Edge cases: a null text has no words and fails the base rules; a document
without a language, or in one with too few words, is judged by the base rules
alone; repeated rows are judged alike; an empty table yields no rows.
Columns other than id, text and language are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.llm.text import SPACED_WORD
from ledgerloom.storage import broadcast_if_small, stored

#: Words in a language's list, and fewest words of a language that make a reference.
COMMON_WORDS = 24
REFERENCE_WORDS = 2000
CLASSES = ("lower", "upper", "digits", "spaces", "symbols", "other")
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: Fewest words for which the distances count.
CLASS_JUDGED_WORDS = 50
WORD_JUDGED_WORDS = 100
#: Largest distances (0 to 1) from the language that still pass.
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.30


def _matched(text: str, pattern: str) -> Column:
    """How many code points of a text ``pattern`` matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def with_repeats(docs: DataFrame, words: str, window: int = WINDOW) -> DataFrame:
    """Add n_repeat_words: words in windows that occur twice or more in their text.

    Windows are compared by 64-bit hash.  Most texts repeat none, and for them
    nothing is sorted.
    """
    starts = F.sequence(F.lit(0), F.size(words) - window)
    # Single elements: slice() would copy the whole array for every window.
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(window))))
    df = docs.withColumn("_hashes", F.when(F.size(words) > window, hashes).otherwise(F.array().cast("array<bigint>")))
    ordered = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_ordered", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), ordered))
    beside = lambda j: F.try_element_at("_ordered", j)["h"]
    twins = F.filter("_ordered", lambda x, j: F.when(j > 0, beside(j) == x["h"]).otherwise(False) | F.coalesce(beside(j + 2) == x["h"], F.lit(False)))
    df = df.withColumn("_at", F.sort_array(F.transform(twins, lambda x: x["i"])))
    new = F.transform("_at", lambda p, j: F.least(F.lit(window), F.coalesce(F.try_element_at("_at", j + 2) - p, F.lit(window))))
    total = F.coalesce(F.aggregate(new, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(0))
    return df.withColumn("n_repeat_words", total.cast("long")).drop("_hashes", "_ordered", "_at")


def rows_with_words(documents: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    df = documents.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return df.withColumn("_words", F.regexp_extract_all("_text", F.lit(SPACED_WORD), 0))


def common_words(rows: DataFrame, k: int = COMMON_WORDS) -> DataFrame:
    """(lang, common, counts, longest): the k most frequent words of every language over all rows, and their greatest length; stored.

    The count combines before the shuffle, and of each task's words only the k
    most frequent of a language go to where they are ranked.
    """
    n = rows.where("lang is not null").select("lang", F.explode("_words").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    # A language is told by its words, not by the marks of tables.
    n = n.where(F.col("word").rlike(r"\p{L}"))
    best = n.withColumn("_nth", F.row_number().over(W.Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("_nth") <= k)
    listed = F.array_sort(F.collect_list(F.struct("_nth", "word", "n")))
    lists = best.groupBy("lang").agg(listed.alias("l"), F.max(F.length("word")).alias("longest"))
    return stored(lists.select("lang", F.col("l.word").alias("common"), F.col("l.n").alias("counts"), "longest"), "common-words")


def features(rows: DataFrame, common: DataFrame) -> DataFrame:
    """The base counts and the histograms of each document of rows_with_words."""
    df = rows.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(SPACED_WORD)))
    # Most characters are lower-case letters, so the other classes are counted in what is left without them.
    df = with_repeats(df, "_words").withColumn("_rest", F.regexp_replace("_text", r"\p{Ll}+", ""))
    df = df.join(broadcast_if_small(common.select("lang", "common", "longest")), "lang", "left")
    df = df.select(
        "doc_id", "lang", "common", F.size("_words").cast("long").alias("n_words"), F.length("_text").cast("long").alias("_length"), F.length("_rest").cast("long").alias("_unlike"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        _matched("_rest", r"[#*$%&|<>]+").alias("n_symbols"), _matched("_rest", r"[\x20\x09-\x0D]+").alias("_spaces"),
        _matched("_rest", r"\p{Lu}+").alias("_upper"), _matched("_rest", r"\p{Nd}+").alias("_digits"),
        F.filter("_words", lambda w: F.length(w) <= F.col("longest")).alias("_short"),
    )
    df = df.withColumn("word_chars", F.col("_length") - F.col("_spaces"))
    other = F.col("_unlike") - F.col("_upper") - F.col("_digits") - F.col("_spaces") - F.col("n_symbols")
    classes = F.array(F.col("_length") - F.col("_unlike"), "_upper", "_digits", "_spaces", "n_symbols", other).alias("classes")
    listed = F.transform("common", lambda w: (F.size("_short") - F.size(F.array_remove("_short", w))).cast("long")).alias("listed")
    return df.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", classes, listed)


def _with_rest(listed: Column, n_words: Column) -> Column:
    """A common-word histogram with the words outside the list as its last bin."""
    return F.concat(listed, F.array(n_words - F.aggregate(listed, F.lit(0).cast("long"), lambda a, b: a + b)))


def references(found: DataFrame, common: DataFrame, least: int = REFERENCE_WORDS) -> DataFrame:
    """(lang, ref_classes, ref_words) over all documents of each language that has enough words, stored."""
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(len(CLASSES))]
    n = found.where("lang is not null").groupBy("lang").agg(*sums, F.sum("n_words").alias("n")).where(F.col("n") >= least)
    ref = n.join(common, "lang").select("lang", F.array(*(f"c{i}" for i in range(len(CLASSES)))).alias("ref_classes"), _with_rest(F.col("counts"), F.col("n")).alias("ref_words"))
    return stored(ref, "quality-references")


def js_distance(counts: Column, reference: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits: 0 for equal, 1 for disjoint histograms."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    share = lambda c: F.transform(c, lambda x: x / total(c))
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    terms = F.zip_with(share(counts), share(reference), lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2))


def judged(found: DataFrame, refs: DataFrame) -> DataFrame:
    """Add base_failed, the distances from the document's language, and the verdict."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    df = found.withColumn("base_failed", failed).join(broadcast_if_small(refs), "lang", "left")
    df = df.withColumn("class_distance", F.when(F.col("n_words") >= CLASS_JUDGED_WORDS, js_distance(F.col("classes"), F.col("ref_classes"))))
    df = df.withColumn("word_distance", F.when(F.col("n_words") >= WORD_JUDGED_WORDS, js_distance(_with_rest(F.col("listed"), F.col("n_words")), F.col("ref_words"))))
    diverges = F.coalesce((F.col("class_distance") > MAX_CLASS_DISTANCE) | (F.col("word_distance") > MAX_WORD_DISTANCE), F.lit(False))
    return df.withColumn("kept", ~(failed | diverges)).drop("ref_classes", "ref_words")


def quality(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, distances and verdict of every document."""
    rows = rows_with_words(documents, id_col, text_col, lang_col)
    common = common_words(rows)
    found = stored(features(rows, common), "quality-features")
    return judged(found, references(found, common)).drop("lang", "classes", "listed")


def op7_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality(documents).drop("class_distance", "word_distance")
