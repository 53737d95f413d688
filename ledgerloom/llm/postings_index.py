"""Benchmark decontamination through a distributed positional inverted index.

The corpus is indexed in segments, one per Arrow batch of documents.  Within
a segment every word has one running position, documents are one empty
position apart, and each term keeps its sorted list of positions.  Segments
are stored, so one index answers many test sets.

A phrase is looked up by its rarest term in the segment.  That term's list,
shifted back by the term's place in the phrase, holds the possible starts; the
other terms' lists, likewise shifted, are intersected with it from rare to
common, and a segment without one of the terms is left at once.  Proximity
matches start from the rarest term too and ask for every other term nearby.

Segments are independent: nothing is shuffled, a hot term or a group of copies
costs each segment its own share, and a lost task repeats its segments alone.
The phrases travel to the tasks in blocks of a bounded size; a larger test set
takes more passes over the stored index, never a larger block.

Edge cases: a null text has no words; a test item without words or without an
id has no windows; repeated items count once by id and repeated documents each
get a row, also where whole files repeat; a text of any length is indexed whole,
one that is longer than a segment is a segment of its own; an empty test set leaves everything clean; an empty corpus gives no
rows; columns other than ids and texts are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.llm.text import ITEM_WORD, arrow_batches, ascii_lower, item_words
from ledgerloom.storage import discard, stored

WINDOW = 10
#: Words of a document within which all words of a stretch of an item count as near.
SPAN = 20
#: Phrases that one pass over the index looks up; about 100 bytes each in the driver and in tasks.
PHRASES_PER_PASS = 200_000
#: Characters of text after which a segment is closed.
SEGMENT_CHARS = 4_000_000

SEGMENT = T.StructType([
    T.StructField("segment", T.StringType()),
    T.StructField("doc_ids", T.ArrayType(T.StringType())),
    T.StructField("n_words", T.ArrayType(T.IntegerType())),
    T.StructField("terms", T.StringType()),
    T.StructField("sizes", T.BinaryType()),
    T.StructField("postings", T.BinaryType()),
])
HITS = "segment string, place int, doc_id string, n_words long, starts array<int>, ends array<int>, items array<string>, near array<string>"
#: Segments are megabytes each, so few of them travel together.
SEGMENTS_PER_BATCH = 8


def _segment(ids: list, texts: list[list[bytes]]) -> dict:
    """One segment of the index over the words of some documents."""
    code: dict[bytes, int] = {}
    codes = np.fromiter((code.setdefault(w, len(code)) for words in texts for w in words), np.int32)
    lengths = np.array([len(words) for words in texts], np.int32)
    # Each document is followed by one empty position, so no phrase runs on into the next.
    positions = np.arange(len(codes), dtype=np.int32) + np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    order = np.argsort(codes, kind="stable")
    sizes = np.bincount(codes, minlength=len(code)).astype(np.int32)
    # Steps from one position to the next are small, and so compress well.
    steps = np.diff(positions[order], prepend=np.int32(0))
    # A name of its own even beside a segment with the same contents; once stored it stays.
    return {"segment": uuid.uuid4().hex, "doc_ids": ids, "n_words": lengths, "terms": b"\n".join(code).decode(), "sizes": sizes.tobytes(), "postings": steps.tobytes()}


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


def build_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index the words of ``documents`` and store the segments in the shared folder.

    Ids of any type are kept as strings.
    """
    docs = documents.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    with arrow_batches(documents.sparkSession):
        return stored(docs.mapInArrow(_index_batches, SEGMENT), "postings")


class Segment:
    """A stored segment opened for look-ups."""

    def __init__(self, row) -> None:
        self.name = row.segment
        self.n_words = np.asarray(row.n_words, np.int64)
        self.doc_ids = list(row.doc_ids)
        ends = np.cumsum(np.frombuffer(row.sizes, np.int32), dtype=np.int64).tolist()
        self.at = dict(zip(row.terms.split("\n"), zip([0, *ends], ends)))
        self.postings = np.cumsum(np.frombuffer(row.postings, np.int32), dtype=np.int32)
        # First position of each document.
        self.base = np.concatenate(([0], np.cumsum(self.n_words + 1)))[:-1]

    def positions(self, term: str) -> np.ndarray:
        lo, hi = self.at[term]
        return self.postings[lo:hi]

    def phrase(self, terms: list[str]) -> np.ndarray:
        """Positions at which the terms stand one after another."""
        spans = []
        for k, t in enumerate(terms):
            if t not in self.at:
                return np.empty(0, np.int32)
            lo, hi = self.at[t]
            spans.append((hi - lo, k, lo, hi))
        spans.sort()
        _, k, lo, hi = spans[0]
        starts = self.postings[lo:hi] - k
        for _, k, lo, hi in spans[1:]:
            if not len(starts):
                break
            listed = self.postings[lo:hi]
            found = np.searchsorted(listed, starts + k)
            found[found == len(listed)] = 0
            starts = starts[listed[found] == starts + k]
        return starts

    def near(self, terms: list[str], span: int) -> np.ndarray:
        """Positions of the rarest term with every other term in one stretch of ``span`` words around it."""
        terms = sorted(set(terms), key=lambda t: self.at[t][1] - self.at[t][0] if t in self.at else -1)
        if not terms or terms[0] not in self.at or any(t not in self.at for t in terms):
            return np.empty(0, np.int32)
        lists = [self.positions(t) for t in terms[1:]]
        anchors = self.positions(terms[0])
        for listed in lists:  # drop anchors that lack a term on both sides
            at = np.searchsorted(listed, anchors - span + 1)
            anchors = anchors[(at < len(listed)) & (listed[np.minimum(at, len(listed) - 1)] < anchors + span)]
        kept = []
        for a in anchors.tolist():
            doc = np.searchsorted(self.base, a, "right") - 1
            lo, hi = max(self.base[doc], a - span + 1), min(self.base[doc] + self.n_words[doc], a + span)
            stretches = [x[np.searchsorted(x, lo) : np.searchsorted(x, hi)] for x in lists]
            if not all(map(len, stretches)):
                continue
            # The best stretch starts at the anchor or at some term before it.
            for left in {a, *(int(p) for x in stretches for p in x if p < a)}:
                if a - left < span and all(np.searchsorted(x, left) < np.searchsorted(x, left + span) for x in stretches):
                    kept.append(a)
                    break
        return np.array(kept, np.int32)


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, terms): the distinct windows of each item; a shorter item is one window."""
    words = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(ITEM_WORD), 0)
    df = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words.alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    df = df.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, window))).alias("terms"))
    return df.distinct()


def stretches_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, terms): each item cut into stretches of ``window`` words, the last one shorter, as what to look for nearby."""
    words = F.regexp_extract_all(ascii_lower(F.col(text_col)), F.lit(ITEM_WORD), 0)
    df = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words.alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(window))
    return df.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, window))).alias("terms")).distinct()


def _probe(phrases: list[tuple[str, list[str], bool]], span: int):
    """A look-up of some (item, terms, whether nearby will do) in whatever segments a task holds."""
    by_terms: dict[tuple[tuple[str, ...], bool], set[str]] = {}
    for item, terms, nearby in phrases:
        by_terms.setdefault((tuple(terms), nearby), set()).add(item)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                segment = Segment(row)
                found: dict[int, tuple[list[tuple[int, int]], set[str], set[str]]] = {}
                for (terms, nearby), items in by_terms.items():
                    at = segment.near(terms, span) if nearby else segment.phrase(terms)
                    docs = np.searchsorted(segment.base, at, "right") - 1
                    for doc, start in zip(docs.tolist(), (at - segment.base[docs]).tolist(), strict=True):
                        spans, named, close = found.setdefault(doc, ([], set(), set()))
                        if nearby:
                            close |= items
                        else:
                            spans.append((start, start + len(terms)))
                            named |= items
                yield _hits(segment, found)

    return probe


def _hits(segment: Segment, found: dict) -> pd.DataFrame:
    """A row per document of a segment, its spans merged."""
    rows = []
    for doc, (doc_id, n) in enumerate(zip(segment.doc_ids, segment.n_words.tolist(), strict=True)):
        spans, named, close = found.get(doc, ((), (), ()))
        starts: list[int] = []
        ends: list[int] = []
        for s, e in sorted(spans):
            if ends and s <= ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                starts.append(s)
                ends.append(e)
        rows.append((segment.name, doc, doc_id, n, starts, ends, sorted(named), sorted(close)))
    return pd.DataFrame(rows, columns=["segment", "place", "doc_id", "n_words", "starts", "ends", "items", "near"])


def _blocks(phrases: DataFrame) -> list[DataFrame]:
    """Stored phrases in as many blocks as their number needs, half-filled on average so that an uneven hash overfills none."""
    total = phrases.count()
    passes = 1 if total <= PHRASES_PER_PASS else -(-2 * total // PHRASES_PER_PASS)
    return [phrases.where(F.pmod(F.xxhash64("item", "terms"), F.lit(passes)) == k) for k in range(passes)]


def find_phrases(index: DataFrame, windows: DataFrame, stretches: DataFrame | None = None, span: int = SPAN) -> DataFrame:
    """Matches per document: its words, merged spans of the words that windows hit, their items, and items with a stretch nearby.

    Both tables have item and terms.  With more phrases than PHRASES_PER_PASS
    the index is read once per block of them and the blocks' spans are merged
    per document afterwards.
    """
    wanted = windows.select("item", "terms", F.lit(False).alias("nearby"))
    if stretches is not None:
        wanted = wanted.unionByName(stretches.select("item", "terms", F.lit(True).alias("nearby")))
    found = [_looked_up(index, block, span, f"hits-{k}") for k, block in enumerate(_blocks(stored(wanted, "windows")))]
    return found[0] if len(found) == 1 else _united(reduce(DataFrame.unionByName, found))


def _looked_up(index: DataFrame, wanted: DataFrame, span: int, name: str) -> DataFrame:
    """The stored hits of at most PHRASES_PER_PASS phrases, with the segment and the document's place in it."""
    probe = _probe([(r["item"], r["terms"], r["nearby"]) for r in wanted.collect()], span)
    with arrow_batches(index.sparkSession, SEGMENTS_PER_BATCH):
        return stored(index.mapInPandas(probe, HITS), name)


def _united(hits: DataFrame) -> DataFrame:
    """Merge the spans and items that several passes found in a document.

    A document's row from each pass meets the others: as many rows as there
    are passes.
    """
    spans = F.sort_array(F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))))
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    df = hits.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), spans.alias("spans"), every("items"), every("near"))
    # The words hit are those between 0 and the last end that some span covers: each span adds what lies beyond the ends before it.
    reach = F.aggregate("spans", F.struct(F.array().cast("array<struct<starts:int,ends:int>>").alias("out"), F.lit(0).alias("end")), _beyond)
    df = df.withColumn("new", reach["out"])
    return df.select("segment", "place", "doc_id", "n_words", F.col("new.starts").alias("starts"), F.col("new.ends").alias("ends"), "items", "near")


def _beyond(state, span):
    start = F.greatest(span["starts"], state["end"])
    piece = F.array(F.struct(start.alias("starts"), span["ends"].alias("ends")))
    return F.struct(F.when(span["ends"] > start, F.concat(state["out"], piece)).otherwise(state["out"]).alias("out"), F.greatest(span["ends"], state["end"]).alias("end"))


def find_near(index: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """Proximity matches: (doc_id, item, word) where every term of a phrase falls within ``span`` words.

    ``word`` is the place of the phrase's rarest term.  ``phrases`` has item and
    terms; more than PHRASES_PER_PASS of them take more passes over the index.
    """
    found = [_near(index, block, span) for block in _blocks(stored(phrases.select("item", "terms"), "phrases"))]
    return reduce(DataFrame.unionByName, found)


def _near(index: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    wanted = [(r["item"], list(r["terms"])) for r in phrases.collect()]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                segment, rows = Segment(row), []
                for item, terms in wanted:
                    for at in segment.near(terms, span).tolist():
                        doc = int(np.searchsorted(segment.base, at, "right")) - 1
                        rows.append((segment.doc_ids[doc], item, at - int(segment.base[doc])))
                yield pd.DataFrame(rows, columns=["doc_id", "item", "word"]).astype({"word": "int64"})

    with arrow_batches(index.sparkSession, SEGMENTS_PER_BATCH):
        return stored(index.mapInPandas(probe, "doc_id string, item string, word long"), "near")


def decontaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", span: int | None = None) -> DataFrame:
    """Per document: words, items with an occurring window, spans of hit words, and with a ``span`` items that come near; the index goes when done."""
    index = build_index(documents, id_col)
    found = find_phrases(index, windows_of(benchmark, window=window), stretches_of(benchmark, window=window) if span else None, span or SPAN)
    discard(index)
    return found.withColumn("doc_id", F.col("doc_id").cast(documents.schema[id_col].dataType))


def op1_benchmark_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_near: items of which a stretch of ten words lies within twenty, in any order."""
    found = decontaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), span=SPAN)
    hit = F.aggregate(F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"),
    )
