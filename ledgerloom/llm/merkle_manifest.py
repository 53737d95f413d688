"""A Merkle manifest of a dataset by slot pivots.

Leaves are digests of rows, in order within a group (a tree); every ``fanout``
consecutive nodes become their parent.  The children of a parent are spread
into slot columns by conditional aggregates: concatenated they are the parent's
digest, and without a node's own slot they are its siblings.

One aggregate spreads ``fanout ** levels`` nodes at once and builds that many
levels of parents from its columns, so a tree of N leaves takes a shuffle for
each ``levels`` levels, the first one of all leaves and each next one of a
fraction.  The rows of such an aggregate (a hop) are stored; proofs go down the
hops, so what is carried to a leaf's row is shared by all leaves of that row.
Leaves get their places by ranges, so a tree of any size is spread over tasks.

Edge cases: nulls of any column are part of the leaf, told apart from empty
texts; a null group is a tree of its own, the first; a tree of one leaf is that
leaf; rows with equal order are told apart by their digest, and rows that
repeat altogether each have a leaf; texts are hashed whole at any length; other
columns are ignored; an empty table has no tree and no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.places import placed
from ledgerloom.storage import scratch, stored

FANOUT = 2
#: Levels of a tree that one aggregate builds, from 32 slot columns.
LEVELS = 5


def field(c: Column) -> Column:
    """A value with its length in bytes, so that no two rows read alike."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def tree_key(group: Column) -> Column:
    """A group as a key without nulls, in the same order, null first."""
    return F.coalesce(F.concat(F.lit("."), group.cast("string")), F.lit(""))


@dataclass(frozen=True)
class Trees:
    """Stored trees: hops from the leaves upwards, and (tree, hop, digest) of each root."""

    hops: list[DataFrame]
    roots: DataFrame
    fanout: int
    levels: int


def _hop(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Nodes (tree, n, place, item) spread into slots, a row for each ``fanout ** levels``, with the levels of parents above them.

    ``n`` is the number of nodes that the tree has at this height: no parent is
    formed above its root.
    """
    width = fanout**levels
    slot = F.col("place") % width
    columns = [F.max(F.when(slot == s, F.col("item"))).alias(f"slot_{s}") for s in range(width)]
    wide = nodes.groupBy("tree", "n", F.expr(f"place div {width}").alias("at")).agg(*columns)
    items = F.filter(F.array(*(f"slot_{s}" for s in range(width))), lambda item: item.isNotNull())
    rows = wide.select("tree", "n", "at", items.alias("items"))
    height = reduce(Column.__add__, ((F.col("n") > fanout**k).cast("int") for k in range(levels)))

    def parents(children: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(children) - 1) / fanout).cast("int"))
        return F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(children, k * fanout + 1, fanout), ""), 256))

    steps = F.slice(F.array(*map(F.lit, range(levels))), F.lit(1), height)
    grown = F.aggregate(steps, F.array(F.transform("items", lambda i: i["digest"])), lambda below, _: F.concat(below, F.array(parents(F.element_at(below, -1)))))
    return rows.withColumn("levels", grown)


def build(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> Trees:
    """Trees over nodes (tree string, place from 0, item struct with a digest)."""
    width = fanout**levels
    sizes = stored(nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "tree-sizes")
    most = sizes.agg(F.max("n")).first()[0] or 0
    nodes = nodes.join(sizes, "tree")
    hops, roots = [], []
    while True:
        hop = stored(_hop(nodes, fanout, levels), f"hop-{len(hops)}")
        top = F.element_at(F.element_at("levels", -1), 1)
        roots.append(hop.where(F.col("n") <= width).select("tree", F.lit(len(hops)).alias("hop"), top.alias("digest")))
        hops.append(hop)
        if most <= width:
            return Trees(hops, stored(reduce(DataFrame.unionByName, roots), "roots"), fanout, levels)
        most = -(-most // width)
        nodes = hop.where(F.col("n") > width).select("tree", F.ceil(F.col("n") / width).alias("n"), F.col("at").alias("place"), F.struct(top.alias("digest")).alias("item"))


def _siblings(trees: Trees, slot: Column) -> Column:
    """For each level of a hop's row the children of a node's parent without its own slot, as what stands left and right of it."""
    f = trees.fanout
    powers = F.slice(F.array(*(F.lit(f**k) for k in range(trees.levels))), F.lit(1), F.size("levels") - 1)

    def beside(power: Column, level: Column) -> Column:
        nodes = F.col("levels")[level]
        own = F.floor(slot / power).cast("int")
        first = own - own % f
        return F.struct(F.array_join(F.slice(nodes, first + 1, own - first), "").alias("left"), F.array_join(F.slice(nodes, own + 2, first + f - own - 1), "").alias("right"))

    return F.transform(powers, beside)


def proofs(trees: Trees, above: DataFrame, result: Callable[[Column, Column], Column]) -> DataFrame:
    """For every leaf ``result(item, proof)``, a struct, with whatever ``above`` has beside.

    ``above`` gives for each tree the proof of its root (empty if there is
    nothing above).  A proof is an array of (left, right), from the leaf up.
    """
    width = trees.fanout**trees.levels
    kept = [c for c in above.columns if c not in ("tree", "proof")]
    tops = above.join(trees.roots.select("tree", "hop"), "tree")
    higher = None
    for k in range(len(trees.hops) - 1, -1, -1):
        here = tops.where(F.col("hop") == k).select("tree", F.lit(0).cast("long").alias("at"), "proof", *kept)
        wanted = here if higher is None else here.unionByName(higher)
        found = trees.hops[k].join(wanted, ["tree", "at"])
        with_proof = lambda make: F.transform("items", lambda item, s: make(item, s, F.concat(_siblings(trees, s), F.col("proof"))))
        if k:
            rows = with_proof(lambda item, s, proof: F.struct((F.col("at") * width + s).alias("at"), proof.alias("proof")))
        else:
            rows = with_proof(lambda item, s, proof: F.transform(F.array(proof), lambda p: result(item, p))[0])
        higher = found.select("tree", *kept, F.explode(rows).alias("row")).select("tree", *kept, "row.*")
        if k:
            higher = stored(higher, f"proofs-{k}")
    return higher


def no_proof() -> Column:
    return F.array().cast("array<struct<left:string,right:string>>")


def siblings_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof in their order."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""
    return F.aggregate(proof, leaf, lambda node, p: F.sha2(F.concat(p["left"], node, p["right"]), 256))


@dataclass(frozen=True)
class Manifest:
    """The trees of all groups, the tree over their roots, and the root of all (None without rows)."""

    groups: Trees
    top: Trees
    root: str | None


def manifest(leaves: DataFrame, order: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> Manifest:
    """Trees over stored leaves (tree, digest, other columns), ordered by ``order`` and then by digest within each tree."""
    others = [c for c in leaves.columns if c != "tree"]
    item = F.struct("digest", *(c for c in others if c != "digest"))
    in_place = placed(leaves, "tree", [*order, "digest"]).select("tree", "place", item.alias("item"))
    groups = build(in_place, fanout, levels)
    subroots = groups.roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    top = build(placed(subroots, "tree", ["group"]).select("tree", "place", F.struct("digest", "group").alias("item")), fanout, levels)
    found = top.roots.first()
    return Manifest(groups, top, found and found["digest"])


def group_proofs(m: Manifest) -> DataFrame:
    """(tree, subroot, proof) of the root of each group."""
    above = m.top.roots.select("tree", no_proof().alias("proof"))
    found = proofs(m.top, above, lambda item, proof: F.struct(item["group"].alias("group"), item["digest"].alias("subroot"), proof.alias("proof")))
    return stored(found.select(F.col("group").alias("tree"), "subroot", "proof"), "group-proofs")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, after = [F.col("doc_id"), F.col("source"), F.col("lang")], [F.col("text")]
    # One more than the largest long is still a number.
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_of(*before, more.cast("decimal(20,0)"), *after))
    with scratch(spark) as paths:
        leaves = stored(documents.select(tree_key(F.col("lang")).alias("tree"), leaf_of(*before, F.col("n_chars"), *after).alias("digest"), "doc_id", tampered.alias("tampered")), "leaves")
        made = manifest(leaves, ["doc_id"])

        def verified(item: Column, proof: Column) -> Column:
            return F.struct(
                item["doc_id"].alias("doc_id"), item["digest"].alias("leaf"), siblings_digest(proof).alias("proof_sha256"),
                folded(F.coalesce(item["tampered"], item["digest"]), proof).alias("folded_root"),
            )

        found = proofs(made.groups, group_proofs(made), verified).withColumn("root", F.lit(made.root))
        out = stored(found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")), "verified")
        paths.discard(out.stored_at)
    return out
