"""SimHash near-duplicates, found with vantage-point trees.

A fingerprint is one or more words of 64 bits, and parts of it are searched
with radius 1.  For each part, a vantage-point tree over a bounded sample cuts
the space into shards: an inner node holds a vantage point and the median
distance from it, and points at up to that distance go one way, the others the
other way.  By the triangle inequality a query must look on both sides only
where its own distance is within the radius of the cut.  So every point goes to
its home shard, and also, as a query, to those shards beyond its boundary.
Each shard then builds its own tree and answers its queries by the same rule.
Points that come that close in a part are compared on the whole fingerprint.

``near_duplicates`` (op5) links fingerprints of 64 bits that differ in at most
three.  Two such differ in at most one bit of one of their 32-bit halves, so
the halves as parts lose nothing.

``near_copies`` links texts whose sets of five-word shingles have a Jaccard
similarity of at least 0.8.  Such texts differ in about a seventh of all bits,
too many for a tree of one word, so fingerprints have 32 words, two parts of
each of twelve are searched, and the pairs found are checked on the sets:
nothing is linked wrongly, and a pair of exactly 0.8 is missed once in some
forty times, one of 0.85 once in a thousand, more alike ones hardly ever.

Every row takes part and no bucket is capped: the sample only places the cuts.
A shard reports a spanning forest of the links it finds, so a group of n
copies costs about n rows, never n squared, and exact copies are one
point to begin with.  Components are contracted in rounds of joins whose
tables are written out between rounds.

Edge cases: a text of fewer words than a shingle has its whole word sequence as
one shingle; null or wordless texts have fingerprint zero and link like any
other (for near_copies they are one point without links); repeated rows and ids
each get a row; a component's id ignores null ids unless it has no other; an
empty table yields no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.llm.text import arrow_batches, spaced_words
from ledgerloom.storage import broadcast_if_small, stored

SEED = 42
#: Shingles whose bits are counted at a time; a byte holds the count.
SHINGLES_PER_BLOCK = 255
#: Points in a shard, and the sample that places the cuts (more where there are more shards).
SHARD_POINTS, SAMPLE, SAMPLE_PER_SHARD = 50_000, 65_536, 8
#: Points in a shard where each has but a word, so that fewer visit others.
WORD_SHARD_POINTS = 200_000
#: Points below which a shard's tree compares directly.
LEAF = 48
RADIUS = 1
#: Pairs of sets in an Arrow batch; a set may take a megabyte.
PAIR_BATCH = 256


@dataclass(frozen=True)
class Scheme:
    """What a fingerprint is made of, and what links two of them."""

    shingle: int
    #: 64-bit words of a fingerprint.
    words: int
    #: (word, lowest bit, width) of the parts that are searched.
    parts: tuple[tuple[int, int, int], ...]
    #: Most bits in which linked fingerprints differ, and most in the word of the part by which they were found.
    max_bits: int
    max_word_bits: int
    #: Whether a shingle counts as often as it occurs.
    repeats: bool

    def part(self, fps: np.ndarray, k: int) -> np.ndarray:
        word, low, width = self.parts[k]
        return ((fps[:, word] >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.uint32)


NARROW = Scheme(3, 1, ((0, 0, 32), (0, 32, 32)), 3, 3, True)
#: At a similarity of 0.8 fingerprints differ in 309 bits of 2048 with a deviation of 16, in a word in 10 of 64 with one of 3.
#: Parts of twelve words find the pairs; all words tell the similarity well enough that few pairs are left to be checked.
WIDE = Scheme(5, 32, tuple((w, low, 21) for w in range(12) for low in (0, 32)), 344, 13, False)
#: Least similarity of near copies, as hundredths so that it is compared exactly.
ALIKE_PERCENT = 80


def shingles(text: str | None, size: int) -> np.ndarray:
    """Hashes of a text's word shingles, in order."""
    words = spaced_words(text)
    n = max(1, len(words) - size + 1) if words else 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist() if words else []
    lasts = ends[min(size, len(words)) - 1 :].tolist() if words else []
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, lasts, strict=True)), np.uint64, n)


def spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` numbers for each hash: itself, then mixtures that share no bits with it or each other."""
    x = hashes[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x[:, 1:] = (x[:, 1:] ^ (x[:, 1:] >> np.uint64(shift))) * np.uint64(factor)
    return x


def simhash(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """Bits set in over half the hashes, as ``words`` numbers; zero without hashes."""
    ones = np.zeros(64 * words, np.int64)
    for lo in range(0, len(hashes), SHINGLES_PER_BLOCK):
        bits = np.unpackbits(spread(hashes[lo : lo + SHINGLES_PER_BLOCK], words).astype("<u8").view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def fingerprint(text: str | None) -> int:
    """op5's 64-bit fingerprint, as an unsigned number."""
    return int(simhash(shingles(text, NARROW.shingle))[0])


def row_key() -> Column:
    """A row's identity by doc_id and text, 128 bits; equal only for rows that repeat both."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.when(F.col("text").isNull(), "-").otherwise("+"), F.coalesce("text", F.lit(""))).cast("binary"))


def fingerprints(documents: DataFrame, scheme: Scheme = NARROW) -> DataFrame:
    """(doc_id, key, point, bits) of documents (doc_id, text), stored.

    ``bits`` holds the fingerprint's words.  ``point`` is what copies share:
    the fingerprint itself, or a 128-bit digest of the set of shingles where
    that is what counts.  ``key`` tells rows of one id apart by their text.
    """
    kinds = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("point", T.BinaryType()), T.StructField("bits", T.BinaryType())])
    schema = to_arrow_schema(kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, bits = [], []
            for text in batch["text"].to_pylist():
                hashes = shingles(text, scheme.shingle)
                if not scheme.repeats:
                    hashes = np.unique(hashes)
                bits.append(simhash(hashes, scheme.words).astype("<u8").tobytes())
                points.append(bits[-1] if scheme.repeats else xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(points, pa.binary()), pa.array(bits, pa.binary())], schema=schema)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text")
    with arrow_batches(documents.sparkSession):
        return stored(docs.mapInArrow(read, kinds), "fingerprints")


class VantageTree:
    """Cuts of the Hamming space of a part, made from a sample; leaves are shards."""

    def __init__(self, points: np.ndarray, leaves: int, seed: int = 0) -> None:
        self.vantage: list[int] = []
        self.cut: list[int] = []
        self.sides: list[tuple[int, int]] = []
        self.leaves = 0
        self.rng = np.random.default_rng(seed)
        self.root = self._grow(np.unique(points), leaves)

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        """Number of the node made: negative for leaf -1 - k."""
        if leaves > 1 and len(points) > 1:
            vantage, cut, inside = best_cut(points, self.rng)
            if 0 < inside.sum() < len(points):
                k = len(self.vantage)
                self.vantage.append(vantage), self.cut.append(cut), self.sides.append((0, 0))
                self.sides[k] = self._grow(points[inside], (leaves + 1) // 2), self._grow(points[~inside], leaves // 2)
                return k
        self.leaves += 1
        return -self.leaves

    def homes_and_visits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of point, leaf, whether it is the point's home) for all leaves within RADIUS."""
        at, leaf, home = [], [], []
        stack = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while stack:
            node, index, own = stack.pop()
            if not len(index):
                continue
            if node < 0:
                at.append(index), leaf.append(np.full(len(index), -1 - node)), home.append(own)
                continue
            d, cut = np.bitwise_count(points[index] ^ np.uint32(self.vantage[node])).astype(np.int16), self.cut[node]
            near, far = d <= cut + RADIUS, d > cut - RADIUS
            stack.append((self.sides[node][0], index[near], own[near] & (d[near] <= cut)))
            stack.append((self.sides[node][1], index[far], own[far] & (d[far] > cut)))
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (at, leaf, home))


def best_cut(points: np.ndarray, rng: np.random.Generator) -> tuple[int, int, np.ndarray]:
    """A vantage point, the cut nearest the median distance, and who lies inside; of a few tries the most even."""
    best = None
    for vantage in rng.choice(points, min(4, len(points)), replace=False):
        d = np.bitwise_count(points ^ vantage)
        cut = int(np.median(d))
        for c in (cut, cut - 1):
            inside = d <= c
            uneven = abs(int(inside.sum()) * 2 - len(points))
            if best is None or uneven < best[0]:
                best = uneven, int(vantage), c, inside
    return best[1:]


class Forest:
    """Union-find over positions, by smaller root."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def root(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return int(k)

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def close_pairs(part: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (query, own point) positions of a shard that differ in up to RADIUS bits of the part.

    A vantage-point tree over the own points is walked with all queries at
    once: the same triangle bound says which of them go on to which side.
    """
    rng = np.random.default_rng(0)
    stack = [(np.flatnonzero(home), np.arange(len(part)))]
    while stack:
        points, queries = stack.pop()
        if not len(points) or not len(queries):
            continue
        if len(points) > LEAF:
            vantage, cut, inside = best_cut(part[points], rng)
            if 0 < inside.sum() < len(points):
                d = np.bitwise_count(part[queries] ^ np.uint32(vantage)).astype(np.int16)
                stack.append((points[inside], queries[d <= cut + RADIUS]))
                stack.append((points[~inside], queries[d > cut - RADIUS]))
                continue
        # Few points, or points that no cut tells apart: compare block by block.
        for lo in range(0, len(queries), 4096):
            block = queries[lo : lo + 4096]
            for plo in range(0, len(points), 1024):
                some = points[plo : plo + 1024]
                q, p = np.nonzero(np.bitwise_count(part[block][:, None] ^ part[some][None, :]) <= RADIUS)
                q, p = block[q], some[p]
                yield q[q != p], p[q != p]


@dataclass(frozen=True)
class Shard:
    """The points of a shard of one part: fingerprints, who is at home, and in which group each is (-1: in none)."""

    fps: np.ndarray
    home: np.ndarray
    group: np.ndarray
    scheme: Scheme
    k: int

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Linked pairs, each perhaps both ways round."""
        for q, p in close_pairs(self.scheme.part(self.fps, self.k), self.home):
            ok = self.word_bits(q, p, self.k) <= self.scheme.max_word_bits
            q, p = q[ok], p[ok]
            ok = np.bitwise_count(self.fps[q] ^ self.fps[p]).sum(axis=1, dtype=np.int64) <= self.scheme.max_bits
            yield q[ok], p[ok]

    def word_bits(self, q: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
        """Bits in which pairs differ in the word of a part."""
        word = self.scheme.parts[k][0]
        return np.bitwise_count(self.fps[q, word] ^ self.fps[p, word])

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that connect all that is linked."""
        forest, links = Forest(len(self.fps)), []
        for q, p in self.found():
            links += [(a, b) for a, b in zip(q.tolist(), p.tolist(), strict=True) if forest.join(a, b)]
        return tuple(np.array(links, np.int64).reshape(-1, 2).T)

    def across(self) -> tuple[np.ndarray, np.ndarray]:
        """All linked pairs of different groups that no earlier part finds."""
        out = []
        for q, p in self.found():
            new = self.group[q] != self.group[p]
            q, p = q[new], p[new]
            for k in range(self.k):
                apart = np.bitwise_count(self.scheme.part(self.fps[q], k) ^ self.scheme.part(self.fps[p], k)) > RADIUS
                late = apart | (self.word_bits(q, p, k) > self.scheme.max_word_bits)
                q, p = q[late], p[late]
            out.append((q, p))
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2

    def partnered(self) -> np.ndarray:
        """Points with another close to them in the part's word, all there is of their fingerprints here."""
        has = np.zeros(len(self.fps), bool)
        for q, p in close_pairs(self.scheme.part(self.fps, self.k), self.home):
            ok = self.word_bits(q, p, self.k) <= self.scheme.max_word_bits
            has[q[ok]] = has[p[ok]] = True
        return np.flatnonzero(has)


def numbers(column: pa.Array, words: int) -> np.ndarray:
    """Binary values of ``words`` 64-bit numbers each as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, words)


def searched(points: DataFrame, scheme: Scheme, task: str, shard_points: int = SHARD_POINTS) -> DataFrame:
    """What every shard of every part finds among ``points`` (point, bits, group, parts), each point once.

    ``parts`` lists the parts in which a point takes part, null standing for
    all.  ``task`` is a method of Shard: pairs of points come back as (a, b),
    single points with the part's number as b.
    """
    shards = max(1, -(-points.count() // shard_points))
    # A bounded sample by hash places the cuts; every point is searched whatever they are.
    words = 1 + max(word for word, _, _ in scheme.parts)
    head = F.substring("bits", 1, 8 * words).alias("bits")
    sample = points.select("point", head).orderBy(F.xxhash64("point")).limit(max(SAMPLE, SAMPLE_PER_SHARD * shards)).select("bits").toArrow()["bits"]
    known = numbers(sample.combine_chunks(), words) if len(sample) else np.zeros((0, words), np.uint64)
    trees = [VantageTree(scheme.part(known, k), shards, seed=k) for k in range(len(scheme.parts))]
    first = np.cumsum([0, *(t.leaves for t in trees)])
    narrow = task == "partnered"
    dealt = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("home", T.BooleanType()), T.StructField("point", T.BinaryType()), T.StructField("bits", T.BinaryType()), T.StructField("group", T.LongType())])
    pair = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    dealt_schema, pair_schema = to_arrow_schema(dealt), to_arrow_schema(pair)
    numbered = pa.array([k.to_bytes(2, "big") for k in range(len(trees))], pa.binary())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = numbers(batch["bits"], scheme.words)
            parts = batch["parts"].to_pylist()
            for k, tree in enumerate(trees):
                ours = np.flatnonzero([p is None or k in p for p in parts])
                at, leaf, home = tree.homes_and_visits(scheme.part(fps[ours], k))
                rows = pa.array(ours[at])
                bits = pa.array([x.tobytes() for x in fps[:, scheme.parts[k][0]]], pa.binary()) if narrow else batch["bits"]
                yield pa.RecordBatch.from_arrays([pa.array((leaf + first[k]).astype(np.int32)), pa.array(home.astype(bool)), batch["point"].take(rows), bits.take(rows), batch["group"].take(rows)], schema=dealt_schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=dealt_schema).combine_chunks()
        ids = table["shard"].to_numpy()
        order = np.argsort(ids, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1) if len(order) else []:
            ours = table.take(pa.array(rows)).combine_chunks()
            k = int(np.searchsorted(first, ids[rows[0]], "right")) - 1
            fps = numbers(ours["bits"].combine_chunks(), 1 if narrow else scheme.words)
            if narrow:  # one word stands for all
                fps = np.broadcast_to(fps, (len(fps), scheme.words))
            found = getattr(Shard(fps, ours["home"].to_numpy(), ours["group"].to_numpy(), scheme, k), task)()
            a, b = (found, np.full(len(found), k)) if narrow else found
            point = ours["point"].combine_chunks()
            others = numbered if narrow else point
            for lo in range(0, len(a), 10_000):
                yield pa.RecordBatch.from_arrays([point.take(pa.array(a[lo : lo + 10_000])), others.take(pa.array(b[lo : lo + 10_000]))], schema=pair_schema)

    routed = points.select("point", "bits", "group", "parts").mapInArrow(route, dealt)
    return routed.repartitionById(int(first[-1]), F.col("shard")).mapInArrow(search, pair)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b), the smallest node of a component being its root.

    Each round points every node at its smallest neighbour, follows that
    pointer once more, and contracts the edges to what lies between roots.
    Nodes meet as pre-aggregated minima; hot nodes only appear in joins that
    Spark can split.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    k = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to")), f"cc-step-{k}")
        ahead = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        step = stored(step.join(ahead, "to").select("node", F.col("further").alias("to")), f"cc-jump-{k}")
        one, two = step.select(F.col("node").alias("a"), F.col("to").alias("ra")), step.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        edges = stored(edges.join(one, "a").join(two, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"cc-edges-{k}")
        if k == 0:
            found = step.select("node", F.col("to").alias("root"))
        else:
            onward = step.select(F.col("node").alias("root"), "to")
            found = found.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        found = stored(found, f"cc-roots-{k}")
        k += 1
    return found


def points_of(prints: DataFrame) -> DataFrame:
    """(point, bits, first): one row per point, however many copies it has, with its first row; those without an id come last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    return stored(prints.groupBy("point").agg(F.min("bits").alias("bits"), first), "points")


def grouped(prints: DataFrame, points: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, key, bits, component_id, keeper) of ``prints``, whose ``points`` are linked by ``edges`` (a, b).

    ``component_id`` is the smallest doc_id of the component and ``keeper`` the
    key of a row that has it.
    """
    roots = components(edges)
    rooted = stored(points.join(roots.withColumnRenamed("node", "point"), "point", "left").select("point", "first", F.coalesce("root", "point").alias("root")), "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.select("point", "root").join(firsts, "root").select("point", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("keeper"))
    return prints.join(stored(named, "named"), "point").select("doc_id", "key", "bits", "component_id", "keeper")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Groups of documents (doc_id, text) whose 64-bit fingerprints link, as ``grouped`` gives them."""
    prints = fingerprints(documents)
    points = points_of(prints)
    return grouped(prints, points, searched(whole(points), NARROW, "forest"))


def whole(points: DataFrame) -> DataFrame:
    """Points of no group, to be searched in all parts."""
    return points.withColumns({"group": F.lit(-1).cast("long"), "parts": F.lit(None).cast("array<int>")})


def alike(a: np.ndarray, b: np.ndarray, percent: int = ALIKE_PERCENT) -> bool:
    """Whether two sets have at least that similarity."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def checked(documents: DataFrame, pairs: DataFrame, points: DataFrame, percent: int = ALIKE_PERCENT) -> DataFrame:
    """Those of ``pairs`` (a, b) of points whose sets of shingles are alike; stored.

    Only one text of each point of a pair is read again, and each pair carries
    one set to where the other is.
    """
    sides = pairs.select(F.col("b").alias("point"), F.col("a").alias("hub")).unionByName(pairs.select(F.col("a").alias("point"), F.lit(None).cast("binary").alias("hub")))
    asked = sides.groupBy("point").agg(F.collect_list("hub").alias("hubs"), F.max(F.col("hub").isNull()).alias("is_hub"))
    asked = stored(points.select("point", F.col("first.key").alias("key")).join(asked, "point"), "asked")
    rows = documents.select(row_key().alias("key"), "text").join(broadcast_if_small(asked.select("key")), "key", "left_semi")
    sets_kind = T.StructType([T.StructField("key", T.StringType()), T.StructField("shingles", T.BinaryType())])
    edge_kind = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    sets_schema, edge_schema = to_arrow_schema(sets_kind), to_arrow_schema(edge_kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t, WIDE.shingle)).astype("<u8").tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(sets, pa.binary())], schema=sets_schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [alike(np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8"), percent) for x, y in zip(batch["ours"], batch["theirs"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], schema=edge_schema).filter(pa.array(near, pa.bool_()))

    with arrow_batches(documents.sparkSession):
        # Rows that repeat id and text have equal sets; one is enough.
        sets = stored(rows.mapInArrow(read, sets_kind), "sets").dropDuplicates(["key"]).join(asked, "key")
    hubs = sets.where("is_hub").select(F.col("point").alias("a"), F.col("shingles").alias("theirs"))
    members = sets.select(F.explode("hubs").alias("a"), F.col("point").alias("b"), F.col("shingles").alias("ours"))
    with arrow_batches(documents.sparkSession, PAIR_BATCH):
        return stored(members.join(hubs, "a").select("a", "b", "ours", "theirs").mapInArrow(compare, edge_kind), "alike")


def near_copies(documents: DataFrame) -> DataFrame:
    """Groups of documents (doc_id, text) whose sets of five-word shingles are alike, as ``grouped`` gives them.

    First one word of each fingerprint tells which points may have a partner
    at all, and in which parts; only those are searched with all words.  The
    forest of what is found is checked.  Where checking leaves several groups,
    all further pairs found between them are checked too, so no link depends on
    which pairs the forest happened to take.
    """
    prints = fingerprints(documents, WIDE)
    points = points_of(prints)
    # A text without words is like no other.
    worded = whole(points.where(F.col("bits") != F.lit(bytes(8 * WIDE.words))))
    part = F.conv(F.hex("b"), 16, 10).cast("int")
    partnered = searched(worded, WIDE, "partnered", WORD_SHARD_POINTS).groupBy(F.col("a").alias("point")).agg(F.collect_set(part).alias("parts"))
    some = stored(worded.drop("parts").join(broadcast_if_small(stored(partnered, "partnered")), "point"), "some-points")
    either = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    forest = stored(either(searched(some, WIDE, "forest")), "forest")
    edges = checked(documents, forest, points)

    linked = forest.select(F.col("a").alias("point")).union(forest.select("b")).distinct()
    group = F.xxhash64(F.coalesce("root", "point"))
    rest = some.drop("group").join(linked, "point", "left_semi").join(components(edges).withColumnRenamed("node", "point"), "point", "left")
    rest = stored(rest.select("point", "bits", "parts", group.alias("group")), "linked-points")
    across = stored(either(searched(rest, WIDE, "across")).join(forest, ["a", "b"], "left_anti"), "across")
    # The bits have served.
    narrow = prints.withColumn("bits", F.lit(None).cast("binary"))
    return grouped(narrow, points, edges.unionByName(checked(documents, across, points)))


def op5_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    # Bytes are stored lowest first.
    return found.select("doc_id", F.lower(F.regexp_replace(F.hex("bits"), "(..)" * 8, "$8$7$6$5$4$3$2$1")).alias("fingerprint"), "component_id")
