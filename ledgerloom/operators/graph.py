"""Family graphs: edges, components, generations, closures, lifespans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.facts import first_of_type, weakest
from ledgerloom.storage import stored


def family_edges(families: DataFrame) -> DataFrame:
    """(source, target, kind) of families (family_id, husband, wife, children)."""
    parents = families.select("family_id", F.explode(F.array_compact(F.array("husband", "wife"))).alias("source"), "children")
    down = parents.select("source", F.explode("children").alias("target"), F.lit("parent").alias("kind"))
    a, b = F.least("husband", "wife"), F.greatest("husband", "wife")
    wed = families.where("husband is not null and wife is not null").select(a.alias("source"), b.alias("target"), F.lit("spouse").alias("kind"))
    return down.unionByName(wed).distinct()


def typed_links(families: DataFrame, persons: DataFrame) -> DataFrame:
    """(source, target, kind, family_id, hypothetical, status, confidence) of families whose members are known persons.

    A family has family_id, husband, wife, hypothetical_husband,
    hypothetical_wife, children, hypothetical_children and facts (type, status,
    confidences).  A disputed marriage makes its links disputed, a speculative
    one the couple a hypothesis, and a hypothetical member every link of its
    own.  A couple is linked once, by its first family.
    """
    marriage = first_of_type(F.col("facts"), "marriage")
    df = families.withColumn("_m", marriage).withColumns({"_weakest": weakest(F.col("_m.confidences")), "_disputed": F.coalesce(F.col("_m.status") == "disputed", F.lit(False))})
    none = F.array().cast("array<string>")
    one = lambda sure, maybe: F.filter(F.array(F.struct(F.col(sure).alias("id"), F.lit(False).alias("maybe")), F.struct(F.when(~F.col(maybe).eqNullSafe(F.col(sure)), F.col(maybe)).alias("id"), F.lit(True).alias("maybe"))), lambda p: p["id"].isNotNull())
    kids = F.coalesce("children", none)
    each = lambda ids, maybe: F.transform(ids, lambda c: F.struct(c.alias("id"), F.lit(maybe).alias("maybe")))
    df = df.withColumns({
        "_husbands": one("husband", "hypothetical_husband"), "_wives": one("wife", "hypothetical_wife"),
        "_children": F.concat(each(kids, False), each(F.array_except(F.coalesce("hypothetical_children", none), kids), True)),
    })
    keep = ["family_id", "_weakest", "_disputed"]
    parents = df.select(*keep, F.explode(F.concat("_husbands", "_wives")).alias("a"), "_children").select(*keep, "a", F.explode("_children").alias("b"))
    couples = df.select(*keep, F.explode("_husbands").alias("a"), "_wives").select(*keep, "a", F.explode("_wives").alias("b"))

    def known(pairs: DataFrame, kind: str, otherwise: Column) -> DataFrame:
        hypothetical = F.col("a.maybe") | F.col("b.maybe")
        status = F.when(hypothetical, "hypothesis").when(F.col("_disputed"), "disputed").otherwise(otherwise)
        links = pairs.select(F.col("a.id").alias("source"), F.col("b.id").alias("target"), F.lit(kind).alias("kind"), "family_id", hypothetical.alias("hypothetical"), status.alias("status"), F.col("_weakest").alias("confidence"))
        for end in ("source", "target"):
            # Listed persons are far more rows than the table they come from is large: never held whole by a task.
            links = links.join(persons.select(F.col("node").alias(end)).hint("merge"), end, "left_semi")
        return links

    speculative = F.when(F.col("_weakest") == "speculative", "hypothesis").otherwise("confirmed")
    wed = known(couples, "spouse", speculative).withColumns({"_low": F.least("source", "target"), "_high": F.greatest("source", "target")})
    rest = ["kind", "family_id", "hypothetical", "status", "confidence"]
    once = wed.groupBy("_low", "_high").agg(F.min_by(F.struct(*rest), F.struct("family_id", "hypothetical")).alias("l"))
    once = once.select(F.col("_low").alias("source"), F.col("_high").alias("target"), *(F.col(f"l.{c}").alias(c) for c in rest))
    return known(parents, "parent", F.lit("confirmed")).select("source", "target", *rest).unionByName(once)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached.

    Rounds of hooking to the smallest neighbour and contracting the edges; the
    tables shrink from round to round and are written out between them.
    """
    edges = stored(edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct(), "edges")
    roots = nodes.select("node", F.col("node").alias("component"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("low")).select("v", F.least("v", "low").alias("to")), "step")
        roots = stored(roots.join(step, F.col("component") == F.col("v"), "left").select("node", F.coalesce("to", "component").alias("component")), "roots")
        one, two = step.select(F.col("v").alias("a"), F.col("to").alias("x")), step.select(F.col("v").alias("b"), F.col("to").alias("y"))
        edges = stored(edges.join(one, "a").join(two, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return roots


def reachable(edges: DataFrame) -> DataFrame:
    """(source, target) pairs joined by a path, of any length: each round doubles the length of paths known.

    Only pairs that the round before found are extended.  A node on a cycle
    reaches itself.  Meant for family graphs, whose closures are a few times
    their size.
    """
    known = new = stored(edges.select("source", "target").distinct(), "paths")
    while not new.isEmpty():
        ahead = known.select(F.col("source").alias("target"), F.col("target").alias("_far"))
        longer = new.join(ahead, "target").select("source", F.col("_far").alias("target")).distinct()
        new = stored(longer.join(known, ["source", "target"], "left_anti"), "new-paths")
        known = stored(known.unionByName(new), "paths")
    return known


def relation_counts(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Ancestors and descendants of each node."""
    closure = reachable(parents)
    down = closure.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n_descendants"))
    up = closure.groupBy(F.col("target").alias("node")).agg(F.count(F.lit(1)).alias("n_ancestors"))
    return nodes.select("node").join(down, "node", "left").join(up, "node", "left").fillna(0)


def generations(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(node, generation): 0 without parents, else one more than the largest of theirs; null behind a cycle.

    Each round settles the nodes whose last parents the round before settled,
    and drops the edges below those, so that the edges shrink and chains of any
    length come to their end.
    """
    edges = stored(parents.select("source", "target").distinct(), "parents")
    front = stored(nodes.select("node").join(edges.select(F.col("target").alias("node")), "node", "left_anti").withColumn("generation", F.lit(0)), "generation-0")
    written, schema, k = [front.stored_at], front.schema, 0
    while not front.isEmpty():
        k += 1
        above = front.select(F.col("node").alias("source"))
        below = edges.join(above, "source", "left_semi").select(F.col("target").alias("node")).distinct()
        left = stored(edges.join(above, "source", "left_anti"), f"parents-{k}")
        front = stored(below.join(left.select(F.col("target").alias("node")), "node", "left_anti").withColumn("generation", F.lit(k)), f"generation-{k}")
        written.append(front.stored_at)
        edges = left
    # One scan of all levels' files, however many there are.
    settled = nodes.sparkSession.read.schema(schema).parquet(*written)
    return nodes.select("node").join(settled, "node", "left")


def own_lifespan(floruit_from: Column, floruit_to: Column, birth: Column, death: Column, fact_from: Column, fact_to: Column) -> Column:
    """A lifespan and where it comes from, by the best evidence there is."""
    span = lambda a, b, how: F.struct(a.cast("int").alias("low"), b.cast("int").alias("high"), F.lit(how).alias("how"))
    return (
        F.when(floruit_from.isNotNull(), span(floruit_from, floruit_to, "floruit")).when(birth.isNotNull() & death.isNotNull(), span(birth, death, "dates"))
        .when(birth.isNotNull(), span(birth, birth + 90, "birth")).when(death.isNotNull(), span(death - 90, death, "death"))
        .when(fact_from.isNotNull(), span(fact_from - 20, fact_to + 30, "facts")).otherwise(span(F.lit(None), F.lit(None), "unknown"))
    )


def propagated_lifespans(spans: DataFrame, edges: DataFrame, sweeps: int = 4) -> DataFrame:
    """Unknown lifespans bounded by those of children, parents and spouses, all at once in each sweep.

    A sweep uses the sweep before throughout, so over chains of unknowns the
    bounds may differ from updating person by person.
    """
    # How far a relative's years reach, by (kind of edge, end that is unknown).
    reach = {("parent", "source"): (-50, 65), ("parent", "target"): (15, 130), ("spouse", "source"): (-15, 15), ("spouse", "target"): (-15, 15)}
    for _ in range(sweeps):
        known = spans.where("low is not null")
        found = None
        for (kind, end), (a, b) in reach.items():
            other = "target" if end == "source" else "source"
            e = edges.where(F.col("kind") == kind).select(F.col(end).alias("node"), F.col(other).alias("_other"))
            high = F.col("_high") if kind == "spouse" else F.col("_low")
            one = e.join(known.select(F.col("node").alias("_other"), F.col("low").alias("_low"), F.col("high").alias("_high")), "_other").select("node", (F.col("_low") + a).alias("l"), (high + b).alias("h"))
            found = one if found is None else found.unionByName(one)
        widest = found.groupBy("node").agg(F.min("l").alias("l"), F.max("h").alias("h"))
        spans = stored(spans.join(widest, "node", "left").select("node", F.coalesce("low", "l").alias("low"), F.coalesce("high", "h").alias("high")), "spans")
    return spans
