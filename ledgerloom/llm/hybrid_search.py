"""Ranked lexical search: term-at-a-time over short lists, then document-at-a-time over long ones.

The corpus is indexed in segments, one per some megabytes of text, with a list
of (document, occurrences) for every term.  Segments are stored, so one index
answers many sets of queries, and statistics read only its terms and sizes.

Within a segment a query's short lists are summed into accumulators first.
These then stand as one more iterator, bounded by their largest sum, beside the
long lists, each bounded by its best contribution.  Documents are visited in
order, a stretch at a time: iterators whose bounds together cannot reach the
score that the k-th best document has so far offer no candidates and are only
looked up for candidates of the others, as long as their bounds still matter.
A bound is never below what it bounds, and a candidate that may equal the k-th
score stays, so the result is exact.

Segments are independent; a task keeps its own best documents over all its
segments, and the tasks' best meet in two steps, groups of tasks first.  Queries
travel in blocks of bounded size, a larger set takes more passes.

Edge cases: a null text has no term; a document without a term does not count;
an item without an id, or without a term that some document holds, has no
result; items that share an id are one item with the terms of all; a document
without an id comes after others of equal score; repeated documents are ranked
one by one; texts are taken whole at any length (one text may be a segment);
other columns are ignored; without documents there are no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.llm.text import ITEM_WORD, arrow_batches, ascii_lower, item_words
from ledgerloom.storage import scratch, stored

TOP = 50
#: Characters of text after which a segment is closed.
SEGMENT_CHARS = 4_000_000
#: Segments are megabytes each, so few of them travel together.
SEGMENTS_PER_BATCH = 8
#: Terms of queries, with repeats, that one pass looks up.
TERMS_PER_PASS = 500_000
#: A list is short if no more than one in so many documents of the segment is in it.
SHORT_SHARE = 16
#: Documents of a stretch, after which the score to beat is looked at again.
STRETCH = 512
#: Groups of tasks whose best documents meet first.
TASK_GROUPS = 256

SEGMENT = T.StructType([
    T.StructField("documents", T.LongType()),
    T.StructField("words", T.LongType()),
    T.StructField("terms", T.StringType()),
    T.StructField("sizes", T.BinaryType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("lengths", T.BinaryType()),
    T.StructField("docs", T.BinaryType()),
    T.StructField("counts", T.BinaryType()),
])
BEST = "item_id long, doc_id long, score long"


def _segment(ids: list, texts: list[list[bytes]]) -> dict:
    """One segment: each term's documents in order with the term's occurrences."""
    code: dict[bytes, int] = {}
    codes = np.fromiter((code.setdefault(w, len(code)) for words in texts for w in words), np.int64)
    lengths = np.array([len(words) for words in texts], np.int64)
    n = max(1, len(ids))
    # Sorted by term, then by document.
    places, counts = np.unique(codes * n + np.repeat(np.arange(len(ids)), lengths), return_counts=True)
    docs = (places % n).astype(np.int32)
    sizes = np.bincount(places // n, minlength=len(code)).astype(np.int32)
    return {
        "documents": int((lengths > 0).sum()), "words": int(lengths.sum()), "terms": b"\n".join(code).decode(), "sizes": sizes.tobytes(), "doc_ids": ids,
        "lengths": lengths.tobytes(), "docs": np.diff(docs, prepend=np.int32(0)).tobytes(), "counts": counts.astype(np.int32).tobytes(),
    }


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(SEGMENT)
    ids: list = []
    texts: list[list[bytes]] = []
    held = 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(item_words(text))
            held += len(text or "")
            if held >= SEGMENT_CHARS:
                yield pa.RecordBatch.from_pylist([_segment(ids, texts)], schema)
                ids, texts, held = [], [], 0
    if ids:
        yield pa.RecordBatch.from_pylist([_segment(ids, texts)], schema)


def build_index(documents: DataFrame) -> DataFrame:
    """Index the terms of ``documents`` (doc_id, text) and store the segments in the shared folder."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_batches(documents.sparkSession):
        return stored(docs.mapInArrow(_index_batches, SEGMENT), "search-index")


def queries_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, terms): the distinct terms of each item that has an id."""
    words = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(ITEM_WORD), 0)
    terms = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.explode(words).alias("term"))
    return terms.groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


@dataclass(frozen=True)
class Statistics:
    """What a score needs to know of the corpus: documents with a term, all terms, and the weight of each term asked for."""

    documents: int
    words: int
    weights: dict[str, int]


def _sizes_of(wanted: frozenset[str]):
    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = dict.fromkeys(wanted, 0)
        for batch in batches:
            for terms, numbers in zip(batch["terms"], batch["sizes"], strict=True):
                for term, size in zip(terms.split("\n"), np.frombuffer(numbers, np.int32).tolist()):
                    if term in held:
                        held[term] += size
        found = [(t, n) for t, n in held.items() if n]
        yield pd.DataFrame(found, columns=["term", "size"]).astype({"size": "int64"})

    return sizes


def statistics(index: DataFrame, wanted: frozenset[str]) -> Statistics:
    """Counts over all segments; of terms, those of one block of queries."""
    documents, words = index.agg(F.sum("documents"), F.sum("words")).first()
    documents, words = documents or 0, words or 0
    with arrow_batches(index.sparkSession, SEGMENTS_PER_BATCH):
        found = index.select("terms", "sizes").mapInPandas(_sizes_of(wanted), "term string, size long").groupBy("term").agg(F.sum("size").alias("size")).collect()
    weights = {r["term"]: math.floor(1000 * math.log((2 * documents + 2) / (2 * r["size"] + 1))) for r in found}
    return Statistics(documents, words, {t: w for t, w in weights.items() if w > 0})


class Best:
    """The k best documents so far: highest score first, of equal ones the smallest id, those without an id last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.scores, self.ids, self.nameless = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def floor(self) -> int:
        """The least score that may still enter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        scores, ids, nameless = (np.concatenate(pair) for pair in ((self.scores, scores), (self.ids, ids), (self.nameless, nameless)))
        kept = np.lexsort((ids, nameless, -scores))[: self.k]
        self.scores, self.ids, self.nameless = scores[kept], ids[kept], nameless[kept]


@dataclass(frozen=True)
class Bounded:
    """Documents in order, what each gets, and the most that any gets."""

    docs: np.ndarray
    gains: np.ndarray
    bound: int


def accumulated(lists: list[Bounded]) -> Bounded:
    """Short lists summed into one, term after term."""
    if len(lists) == 1:
        return lists[0]
    docs = np.concatenate([x.docs for x in lists])
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    firsts = np.flatnonzero(np.diff(docs, prepend=-1))
    sums = np.add.reduceat(np.concatenate([x.gains for x in lists])[order], firsts)
    return Bounded(docs[firsts], sums, int(sums.max()))


class Segment:
    """A stored segment opened for search."""

    def __init__(self, row, corpus: Statistics) -> None:
        ends = np.cumsum(np.frombuffer(row.sizes, np.int32), dtype=np.int64).tolist()
        self.at = {t: span for t, span in zip(row.terms.split("\n"), zip([0, *ends], ends)) if t in corpus.weights}
        self.docs = np.cumsum(np.frombuffer(row.docs, np.int32), dtype=np.int32)
        self.counts = np.frombuffer(row.counts, np.int32)
        lengths = np.frombuffer(row.lengths, np.int64)
        if len(lengths) and 50 * int(lengths.max()) * corpus.documents >= 1 << 62:
            self.m = np.array([50 + 50 * n * corpus.documents // corpus.words for n in lengths.tolist()], np.int64)
        else:
            self.m = 50 + 50 * lengths * corpus.documents // max(1, corpus.words)
        self.nameless = np.array([d is None or d != d for d in row.doc_ids], bool)
        self.ids = np.array([0 if n else int(d) for d, n in zip(row.doc_ids, self.nameless.tolist(), strict=True)], np.int64)
        self.weights = corpus.weights
        self.lists: dict[str, Bounded] = {}

    def list_of(self, term: str) -> Bounded:
        """A term's documents and what the term adds to each score; worked out once for all queries."""
        found = self.lists.get(term)
        if found is None:
            lo, hi = self.at[term]
            docs, tf = self.docs[lo:hi], self.counts[lo:hi].astype(np.int64)
            gains = self.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * self.m[docs]))
            found = self.lists[term] = Bounded(docs, gains, int(gains.max()))
        return found

    def search(self, terms: list[str], best: Best) -> None:
        """Add to ``best`` what this segment holds for a query."""
        lists = [self.list_of(t) for t in terms if t in self.at]
        if sum(x.bound for x in lists) < best.floor:
            return
        most = len(self.ids) // SHORT_SHARE
        short = [x for x in lists if len(x.docs) <= most]
        iterators = [x for x in lists if len(x.docs) > most]
        if short:
            iterators.append(accumulated(short))
        iterators.sort(key=lambda x: x.bound)
        # The most that an iterator and all with lower bounds give together.
        reach = np.cumsum([x.bound for x in iterators]).tolist()
        for lo in range(0, len(self.ids), STRETCH):
            if reach[-1] < best.floor:
                return
            self._stretch(iterators, reach, lo, min(lo + STRETCH, len(self.ids)), best)

    def _stretch(self, iterators: list[Bounded], reach: list[int], lo: int, hi: int, best: Best) -> None:
        floor = best.floor
        leading = next(k for k, r in enumerate(reach) if r >= floor)
        scores = np.zeros(hi - lo, np.int64)
        for x in iterators[leading:]:
            a, b = np.searchsorted(x.docs, (lo, hi))
            scores[x.docs[a:b] - lo] += x.gains[a:b]
        candidates = np.flatnonzero(scores)
        for k in range(leading - 1, -1, -1):
            candidates = candidates[scores[candidates] + reach[k] >= floor]
            if not len(candidates):
                return
            x = iterators[k]
            at = np.searchsorted(x.docs, candidates + lo)
            at[at == len(x.docs)] = 0
            held = x.docs[at] == candidates + lo
            scores[candidates[held]] += x.gains[at[held]]
        candidates = candidates[scores[candidates] >= floor]
        if len(candidates):
            best.add(scores[candidates], self.ids[candidates + lo], self.nameless[candidates + lo])


def _searcher(wanted: list[tuple[int, list[str]]], corpus: Statistics, k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [Best(k) for _ in wanted]
        for batch in batches:
            for row in batch.itertuples(index=False):
                segment = Segment(row, corpus)
                for (_, terms), found in zip(wanted, best, strict=True):
                    segment.search(terms, found)
        for (item, _), found in zip(wanted, best, strict=True):
            if len(found.scores):
                yield pd.DataFrame({"item_id": item, "doc_id": pd.array(found.ids, "Int64"), "score": found.scores}).assign(doc_id=lambda x: x["doc_id"].mask(found.nameless))

    return search


def _blocks(queries: DataFrame) -> list[DataFrame]:
    """Stored queries in as many blocks as their terms need, half-filled on average."""
    total = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = 1 if total <= TERMS_PER_PASS else -(-2 * total // TERMS_PER_PASS)
    return [queries.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k) for k in range(passes)]


def _searched(index: DataFrame, block: DataFrame, k: int) -> DataFrame:
    wanted = [(r["item_id"], list(r["terms"])) for r in block.collect()]
    corpus = statistics(index, frozenset(t for _, terms in wanted for t in terms))
    wanted = [(item, kept) for item, terms in wanted if (kept := [t for t in terms if t in corpus.weights])]
    with arrow_batches(index.sparkSession, SEGMENTS_PER_BATCH):
        return stored(index.mapInPandas(_searcher(wanted, corpus, k), BEST).withColumn("tasks", F.spark_partition_id() % TASK_GROUPS), "best-of-tasks")


def search(index: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each query (item_id, terms)."""
    found = reduce(DataFrame.unionByName, [_searched(index, block, k) for block in _blocks(stored(queries, "queries"))])
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    near = found.withColumn("rank", F.row_number().over(W.Window.partitionBy("item_id", "tasks").orderBy(*order))).where(F.col("rank") <= k)
    last = near.withColumn("rank", F.row_number().over(W.Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return last.select("item_id", "rank", "doc_id", "score")


def op12_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as paths:
        index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        out = stored(search(index, queries_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))), "ranked")
        paths.discard(out.stored_at)
    return out
