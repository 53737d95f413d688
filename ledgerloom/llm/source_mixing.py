"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Each source gets a budget of words.  A source is taken whole as often as its
budget holds it; what remains is a fraction of an epoch, and which documents
it gets is a weighted draw without replacement: every document has an
exponential key -ln(u) / weight, u being a hash of its id, source and text, and
documents are taken in the order of their keys.  Sizes are summed up in that
order, and the document that crosses the budget is cut at it, so each source
gets its budget to the word.

Sums run over ranges of (source, key), so a source of any size is spread over
tasks.  Targets are shared in rounds over the table of sources: whatever its
cap holds back goes to the others, until none is above.

Edge cases: a null text has no words; a null source is a source, the last; a
source without words gets none; an id that is null or repeats is told apart by
the text, and rows that repeat altogether are taken one by one in any order; a
weight that is null, zero or negative counts as the least weight; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.places import placed, running
from ledgerloom.llm.text import SPACED_WORD
from ledgerloom.storage import broadcast_if_small, scratch, stored

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: How often a source is taken at most.
MOST_EPOCHS = 3
#: Weight of a document by its label: poor and good; UNLABELLED without one.
QUALITY = {0: 0.5, 1: 2.0}
UNLABELLED = 1.0
LEAST_WEIGHT = 1e-6
SEED = "mix-1"


def chance(*columns: Column) -> Column:
    """A number above 0 and below 1 that depends on the columns alone."""
    name = F.md5(F.concat_ws(":", F.lit(SEED), *(F.coalesce(c.cast("string"), F.lit("-")) for c in columns)))
    return (F.conv(F.substring(name, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def sampling_key(u: Column, weight: Column) -> Column:
    """The exponential key by which a document is drawn: the smaller, the earlier."""
    return -F.log(u) / F.greatest(F.coalesce(weight, F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))


def targets(sources: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """Stored sources (source_size, weight, other columns) with ``target``: their share of all words by weight, none above ``most`` times its size."""
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, sharing, capped_before = total or 0, weights or 1, None
    while True:
        share = F.lit(float(rest)) * F.col("weight") / F.lit(float(sharing))
        capped = share > most * F.col("source_size")
        held, weight = sources.where(capped).agg(F.coalesce(F.sum(most * F.col("source_size")), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if weight == capped_before or weight == 0:
            return sources.withColumn("target", F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(share))
        rest, sharing, capped_before = total - held, weights - weight, weight


def source_key(source: Column) -> Column:
    """A source as a key without nulls."""
    return F.coalesce(F.concat(F.lit("."), source), F.lit(""))


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, source, of, size, u) of every document; the only read of the texts."""
    text, source = F.coalesce("text", F.lit("")), F.col("source").cast("string")
    u = chance(F.col("doc_id"), source, F.md5(text))
    return documents.select("doc_id", source.alias("source"), source_key(source).alias("of"), F.regexp_count(text, F.lit(SPACED_WORD)).cast("long").alias("size"), u.alias("u"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for measured documents with a ``weight``.

    ``taken`` is how many words the mix takes of a document: its size for each
    epoch, and in the last one all, a part or none.
    """
    key = sampling_key(F.col("u"), F.col("weight").cast("double"))
    rows = stored(documents.select("doc_id", "source", "of", "size", key.alias("key")), "mix-keys")
    sums = rows.groupBy("of", "source").agg(F.sum("size").alias("source_size")).withColumns({"all": F.lit(0), "last": F.col("source").isNull()})
    numbered = placed(stored(sums, "mix-sources"), "all", ["last", "source"])
    nth = (F.col("place") % len(weights)).cast("int")
    weighed = stored(numbered.select("of", "source_size", F.array(*map(F.lit, weights))[nth].alias("weight")), "mix-weights")
    shares = targets(weighed, most).withColumn("budget", F.floor(F.col("target") + 0.5))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    shares = shares.withColumn("epochs", epochs).withColumn("left", F.col("budget") - F.col("epochs") * F.col("source_size"))
    shares = stored(shares.select("of", "source_size", "target", "epochs", "left"), "mix-shares")
    drawn = running(rows, "of", ["key", "doc_id", "size"], "size").join(broadcast_if_small(shares), "of")
    last = F.least(F.col("size"), F.greatest(F.col("left") - F.col("before"), F.lit(0)))
    return drawn.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).alias("taken"))


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) of each labelled document; of several labels the best counts."""
    best = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    weight = F.lit(UNLABELLED)
    for quality, w in QUALITY.items():
        weight = F.when(F.col("quality") == quality, w).otherwise(weight)
    return best.select("doc_id", weight.alias("weight"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    with scratch(spark) as paths:
        weights = stored(label_weights(labels), "mix-labels")
        rows = measured(documents).join(broadcast_if_small(weights), "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(UNLABELLED)))
        out = stored(mix(rows).drop("source"), "mixed")
        paths.discard(out.stored_at)
    return out
