"""Language identification as inference of a mixture of languages.

A document is a bag of words, each drawn from one of several languages in
unknown proportions.  Character n-gram models say how likely each word is in
each language; expectation-maximisation finds the proportions that make the
document most likely.  The languages are then ranked by their shares, and the
first one, two, three ... of them are fitted alone: each further language must
raise the log likelihood by more than a price that grows with the logarithm of
the document's length.  The prediction is the language with the largest share
of the set chosen.  The empty set competes too: ``gain`` is by how much, for
each n-gram, the chosen mixture explains the document better than a model in
which all n-grams are equally likely.  At zero or below, the text is in none of
the languages learned.

The models are counts of hashed character n-grams over a bounded sample of
labelled documents: about FIT_DOCUMENTS distinct texts of each language, those
whose hashes fall below a threshold.  Every label is fitted, however many there
are; a language takes a quarter of a megabyte of every process.  Nothing but
the text takes part in a prediction, and whole texts do.

Edge cases: null texts and texts without a letter are `und` with score 0; a
document in a language that was never labelled gets the closest one, with a
gain that tells; without any labelled document every prediction is `und`;
repeated rows get equal predictions; an empty table yields no rows; columns
besides those asked for are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.llm.text import arrow_batches
from ledgerloom.storage import stored

#: Distinct labelled texts of each language that a model is fitted on, about.
FIT_DOCUMENTS = 1000
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Rounds of expectation-maximisation over all languages, and over each set tried.
ROUNDS, SET_ROUNDS = 8, 4
#: The price of each further language in units of log word count.
PRICE = 2.0
#: Likelihoods (words times languages) held at a time, but for a single longer document.
NUMBERS_PER_BLOCK = 1_000_000
UNDETERMINED = "und"

#: Runs of letters, and whatever counts as a number without being a digit.
RUN = re.compile(r"[^\W\d_]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("gain", T.DoubleType()), T.StructField("n_words", T.LongType())])


def words_of(text: str | None) -> list[str]:
    """The words of a text in lower case: runs of letters alone."""
    runs = RUN.findall(text.lower()) if text else []
    if all(map(str.isalpha, runs)):
        return runs
    return [w for r in runs for w in "".join(c if c.isalpha() else " " for c in r).split()]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of word) of all bigrams and trigrams of words, their edges marked by a space."""
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), "<u4").astype(np.uint64)
    space = codes == 32
    word = np.cumsum(space) - 1
    two = (codes[:-1] * MIX + codes[1:]) * MIX
    # A trigram around a space would span two words.
    three = np.flatnonzero(~space[1:-1])
    wide = (two[three] + codes[three + 2]) * MIX
    # A bigram or trigram that ends in a space belongs to the word before it.
    owner = word[:-1]
    shift = np.uint64(64 - 16)
    return np.concatenate((two >> shift, wide >> shift)).astype(np.int64), np.concatenate((owner, word[three]))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: Log probability of each bucket (rows) in each language (columns).
    log_p: np.ndarray

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word in each language."""
        bucket, owner = grams(words)
        return np.stack([np.bincount(owner, self.log_p[bucket, k], len(words)) for k in range(len(self.languages))], axis=1)

    def shares(self, ll: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each document's best language, its share, and the log likelihood of the set chosen.

        Documents are stretches of rows, a row being a distinct word with how
        often it occurs.
        """
        n_langs = ll.shape[1]
        # Relative to each word's best language, so that nothing underflows.
        top = ll.max(axis=1)
        p = np.exp(ll - top[:, None]).astype(np.float32)
        counts = counts.astype(np.float32)

        def summed(x: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, at, axis=0)

        sizes = summed(counts.astype(np.float64), starts)

        def rows_of(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Rows of some documents, whose each is, and where each begins."""
            lengths = np.diff(np.append(starts, len(ll)))[docs]
            at = np.cumsum(lengths) - lengths
            return np.repeat(starts[docs] - at, lengths) + np.arange(lengths.sum()), np.repeat(np.arange(len(docs)), lengths), at

        def improved(pi: np.ndarray, docs: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
            """Shares of some documents after some rounds, and their log likelihoods."""
            rows, doc, at = rows_of(docs)
            ours, n = p[rows], counts[rows]
            for _ in range(rounds):
                joint = ours * pi[doc]
                joint *= (n / np.maximum(joint.sum(axis=1), 1e-30))[:, None]
                pi = (summed(joint, at) / sizes[docs, None]).astype(np.float32)
            worth = n * np.log(np.maximum((ours * pi[doc]).sum(axis=1), 1e-30), dtype=np.float64)
            return pi, summed(worth, at)

        every = np.arange(len(starts))
        full, _ = improved(np.full((len(starts), n_langs), 1 / n_langs, np.float32), every, ROUNDS)
        rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
        # No shares do better than these by more than log(max gradient) a word, the likelihood being concave in them.
        mixed = np.maximum((p * np.repeat(full, np.diff(np.append(starts, len(ll))), axis=0)).sum(axis=1), 1e-30)
        slope = summed(p * (counts / mixed)[:, None], starts).max(axis=1) / sizes
        limit = summed(counts * np.log(mixed, dtype=np.float64), starts) + sizes * np.log(np.maximum(slope, 1))
        ceiling = summed(top * counts, starts)
        totals = summed(ll * counts[:, None], starts)
        alone = totals.argmax(axis=1)
        best_pi = np.eye(n_langs, dtype=np.float32)[alone]
        best = np.take_along_axis(totals, alone[:, None], axis=1)[:, 0] - ceiling
        reached = best.copy()
        price = PRICE * np.log(sizes + 1)
        docs, size = every, 2
        while size <= n_langs and len(docs := docs[best[docs] < (limit - price * (size - 1))[docs]]):
            pi = np.where(rank[docs] < size, full[docs], 0)
            pi, worth = improved(pi / np.maximum(pi.sum(axis=1, keepdims=True), 1e-30), docs, SET_ROUNDS)
            paid = worth - price[docs] * (size - 1)
            better = paid > best[docs]
            won = docs[better]
            best[won], reached[won], best_pi[won] = paid[better], worth[better], pi[better]
            size += 1
        return best_pi.argmax(axis=1), best_pi.max(axis=1), reached + ceiling

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, int]]:
        """(language, its share, gain, words) of each text."""
        split = [words_of(t) for t in texts]
        out = [(UNDETERMINED, 0.0, 0.0, len(words)) for words in split]
        if not self.languages:
            return out
        most = max(1, NUMBERS_PER_BLOCK // len(self.languages))
        block: list[int] = []
        held = 0
        for k, words in enumerate(split):
            if block and held + len(words) > most:
                self._predict_block(block, split, out)
                block, held = [], 0
            if words:
                block.append(k)
                held += len(words)
        if block:
            self._predict_block(block, split, out)
        return out

    def _predict_block(self, block: list[int], split: list[list[str]], out: list[tuple[str, float, float, int]]) -> None:
        place: dict[str, int] = {}
        index = np.fromiter((place.setdefault(w, len(place)) for k in block for w in split[k]), np.int64)
        doc = np.repeat(np.arange(len(block)), [len(split[k]) for k in block])
        distinct, counts = np.unique(doc * len(place) + index, return_counts=True)
        doc, index = np.divmod(distinct, len(place))
        starts = np.searchsorted(doc, np.arange(len(block)))
        words = list(place)
        langs, shares, reached = self.shares(self.likelihoods(words)[index], counts, starts)
        # A word of n letters has n + 1 pairs and n triples, its edges counted.
        grams_in = np.add.reduceat((2 * np.fromiter(map(len, words), np.int64, len(words)) + 1)[index] * counts, starts)
        gains = (reached / grams_in + np.log(BUCKETS)) / np.log(2)
        for k, lang, share, gain in zip(block, langs.tolist(), shares.tolist(), gains.tolist(), strict=True):
            out[k] = self.languages[lang], min(1.0, float(share)), gain, len(split[k])


def learned(documents: DataFrame, per_language: int = FIT_DOCUMENTS) -> Model:
    """A model from labelled documents (doc_id, text, lang), one for every label that has texts.

    A text counts once however many copies it has, so the sample of a language
    stays near ``per_language`` distinct texts and no text has a larger share
    of it than another.
    """
    usable = documents.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    # A row per language to the driver.
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    share: Column = F.element_at(F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / max(n, 1))))), F.col("lang"))
    unit = F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63))
    sample = usable.where(unit <= share).dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS)
        for text in pdf["text"]:
            words = words_of(text)
            total += np.bincount(grams(words)[0], minlength=BUCKETS) if words else 0
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "total": [total.tobytes()]})

    rows = sorted((r["lang"], np.log((x := np.frombuffer(r["total"]) + SMOOTHING) / x.sum()).astype(np.float32)) for r in sample.groupBy("lang").applyInPandas(count, "lang string, total binary").toLocalIterator())
    return Model([r[0] for r in rows], np.stack([r[1] for r in rows], axis=1) if rows else np.zeros((BUCKETS, 0), np.float32))


def identified(documents: DataFrame, model: Model, kept: list[str]) -> DataFrame:
    """The columns ``kept`` of documents, text among the input's, with lang_pred, score, gain and n_words; stored."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # a quarter of a megabyte a language
    source = documents.select(*kept, F.col("text").alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], *FOUND.fields])
    arrow = to_arrow_schema(schema)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.predict(batch.column(len(kept)).to_pylist())
            columns = [*batch.columns[:-1], *(pa.array([f[k] for f in found], field.type) for k, field in enumerate(list(arrow)[len(kept) :]))]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    with arrow_batches(documents.sparkSession):
        return stored(source.mapInArrow(predict, schema), "languages")


def held_out(doc_id: Column) -> Column:
    """Documents that no model learns from."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1, F.lit(False))


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learned(documents.where(~held_out(F.col("doc_id"))))
    return identified(documents, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
