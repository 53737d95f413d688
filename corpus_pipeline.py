"""The training-corpus pipeline: each stage applies one operator to what the stage before kept.

1. languages: documents without a letter, or in none of the languages learned, go.
2. near_duplicates: one document of each group stays, linked by five-word shingles of similarity 0.8.
3. decontamination: documents with a passage of a benchmark item go.
4. secrets: secrets found in the texts are masked.
5. packing: the texts become token sequences, given as pieces with their ids (``grouped_packing.sequences`` joins them).

All but the last stage return the columns of documents.  Decisions are made
per row, by id and text, so documents that share an id are judged one by one;
of rows that repeat both, near_duplicates keeps one.

Edge cases: a null or empty text has no letter and goes; rows without an id or
a language take part like any other, an id that is null losing to one that is
not; where no row has a language, all that has a letter passes; without a lang
or n_chars column the stages work and add none; columns of any other name
travel along untouched; texts are taken whole at any length, up to 64 of them in
a Python batch; an empty table comes out of each stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import grouped_packing, language_mixture, postings_index, secret_novelty, vantage_simhash
from ledgerloom.llm.text import arrow_batches
from ledgerloom.llm.vantage_simhash import row_key
from ledgerloom.storage import broadcast_if_small, scratch, stored

#: Words from which on a text is asked whether it is in one of the languages.
JUDGED_WORDS = 5


def keyed(docs: DataFrame) -> DataFrame:
    """Documents as (row, key, doc_id, text, lang), whatever else their columns are called."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    return docs.select(F.struct("*").alias("row"), row_key().alias("key"), "doc_id", "text", lang)


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Documents whose key is not in a stored table; texts stay where they are while that is small."""
    return keyed(docs).join(broadcast_if_small(keys), "key", "left_anti").select("row.*")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those that no mixture of the languages explains better than chance does.

    The models learn from what is not held out.  A short text is not judged by
    its gain.
    """
    rows = keyed(docs).select("key", "doc_id", "text", "lang")
    model = language_mixture.learned(rows.where(~language_mixture.held_out(F.col("doc_id"))))
    if not model.languages:
        # Nothing is labelled, so all that can be told is whether there is a word.
        return docs.where(F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    found = language_mixture.identified(rows, model, ["key"])
    unlike = (F.col("n_words") >= JUDGED_WORDS) & (F.col("gain") <= 0)
    return without(docs, stored(found.where((F.col("lang_pred") == language_mixture.UNDETERMINED) & (F.col("n_words") == 0) | unlike).select("key").distinct(), "no-language"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group."""
    found = stored(vantage_simhash.near_copies(docs.select("doc_id", "text")).groupBy("key", "keeper").count(), "groups")
    repeated = stored(found.where("key = keeper and count > 1").select("key"), "repeated")
    gone = stored(found.where("key <> keeper").select("key").unionByName(repeated), "near-copies")
    kept = without(docs, gone)
    if repeated.isEmpty():
        return kept
    # Rows that repeat id and text: one of them.
    again = keyed(docs).join(broadcast_if_small(repeated), "key", "left_semi").select("key", "row").dropDuplicates(["key"])
    return kept.unionByName(again.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item, or all of a shorter one."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = postings_index.decontaminated(keyed(docs).select("key", "text"), benchmark, id_col="key")
    return without(docs, stored(found.where("size(items) > 0").select(F.col("doc_id").alias("key")).distinct(), "contaminated"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets in every text."""
    clean = secret_novelty.redacted(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    with arrow_batches(spark):
        return stored(clean, "masked")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of every document into sequences: a row per piece with its token ids, its sequence and its place there."""
    return grouped_packing.pack(spark, docs.select("doc_id", "text"), with_ids=True)


STAGES = [("languages", languages), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: SQL has neither the models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to the documents of ``sf_dir``, each stage reading what the last one wrote.

    A stage's own tables, and its input once used, are deleted.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with scratch(spark) as paths:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            paths.discard(docs.stored_at)
            if before:
                paths.add(before)
            before = docs.stored_at
    return docs
