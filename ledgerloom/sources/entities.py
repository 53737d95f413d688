"""Canonical entities in Markdown files with a YAML head, and what relations they make."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACT = "struct<type:string,date:string,place_id:string,status:string>"
PERSON = f"id string, names array<struct<given:string,surname:string,primary:boolean>>, facts array<{FACT}>, parent_family string, spouse_families array<string>, private boolean"
FAMILY = f"id string, husband string, wife string, children array<string>, hypothetical_children array<string>, facts array<{FACT}>"
PLACE = "id string, name string, coords array<double>"


@F.pandas_udf(T.StringType())
def yaml_as_json(text: pd.Series) -> pd.Series:
    """YAML heads as JSON; dates stay text, broken heads become null."""
    import json

    import yaml

    def one(head: str | None) -> str | None:
        try:
            return None if head is None else json.dumps(yaml.load(head, yaml.BaseLoader), ensure_ascii=False)
        except yaml.YAMLError:
            return None

    return text.map(one)


def front_matter(value: Column) -> Column:
    """What stands between the first two lines of three dashes."""
    return F.nullif(F.regexp_extract(value, r"(?s)\A---\s*\n(.*?)\n---", 1), F.lit(""))


def entities(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Entities of one kind from their files; files without a readable head are left out."""
    files = spark.read.option("wholetext", True).text(pattern)
    parsed = files.select(F.from_json(yaml_as_json(front_matter(F.col("value"))), schema).alias("e"))
    return parsed.where("e.id is not null").select("e.*")


def person_facts(persons: DataFrame, families: DataFrame) -> DataFrame:
    """Facts of persons, then of families, numbered in order of their owners."""
    own = lambda df, kind: df.select(F.lit(kind).alias("owner_kind"), F.col("id").alias("owner"), F.posexplode("facts").alias("nth", "f")).select("owner_kind", "owner", "nth", "f.*")
    return own(persons, "person").unionByName(own(families, "family"))


def primary_names(persons: DataFrame) -> DataFrame:
    """A person's primary name, else the first."""
    chosen = F.coalesce(F.get(F.filter("names", lambda n: n["primary"]), F.lit(0)), F.get("names", F.lit(0)))
    return persons.select("id", chosen.alias("n")).select("id", "n.given", "n.surname")


def markdown_rows(lines: DataFrame, order: str = "line_no", line: str = "line", section: str | None = None) -> DataFrame:
    """Cells of Markdown tables, those below one heading alone if wanted; (file, line_no, cells)."""
    from pyspark.sql import window as W

    w = W.Window.partitionBy("file").orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0)
    heading = F.when(F.col(line).startswith("#"), F.trim(F.regexp_replace(line, "^#+", "")))
    df = lines.withColumn("_section", F.last(heading, ignorenulls=True).over(w))
    rows = df.where(F.col(line).rlike(r"^\s*\|.*\|\s*$") & ~F.col(line).rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    if section is not None:
        rows = rows.where(F.col("_section") == section)
    cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return rows.select("file", order, cells.alias("cells"))


def places_geojson(places: DataFrame, facts: DataFrame) -> DataFrame:
    """Places with coordinates and the facts that happened there, as GeoJSON features."""
    here = facts.where("place_id is not null").groupBy(F.col("place_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("date", "type", "owner"))).alias("facts"))
    df = places.where("coords is not null").join(here, "id", "left")
    shape = F.struct(F.lit("Point").alias("type"), F.array(F.col("coords")[1], F.col("coords")[0]).alias("coordinates"))
    properties = F.struct("id", "name", "facts")
    return df.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), properties.alias("properties"))).alias("feature"))


def integrity(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Files (path, content) against what they should be (path, size, sha256): ok, changed or missing."""
    have = files.select("path", F.length("content").alias("_size"), F.sha2("content", 256).alias("_sha"))
    state = F.when(F.col("_sha").isNull(), "missing").when((F.col("_size") == F.col("size")) & (F.col("_sha") == F.col("sha256")), "ok").otherwise("changed")
    return expected.join(have, "path", "left").select("path", state.alias("state"))
