"""Queries that put layers of evidence together, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import assembly
from ledgerloom.plans.queries import query
from ledgerloom.sources import archive_tables, entities

_N = "regexp_extract_all(url, '\\d+')"


@query(f"""WITH n AS (SELECT page_id, {_N} AS n FROM pages), c AS (
  SELECT page_id, array_to_string(n[i:i + 2], '-') AS candidate FROM (SELECT page_id, n, unnest(range(1, len(n) - 1)) AS i FROM n)
  UNION ALL SELECT page_id, array_to_string(n[i:i + 1], '-') FROM (SELECT page_id, n, unnest(range(1, len(n))) AS i FROM n)) SELECT page_id, candidate, count(*) AS times FROM c GROUP BY 1, 2""")
def name_candidates(t) -> DataFrame:
    """Numbers of URLs as what may be shelf marks."""
    return t("pages").select("page_id", F.explode(assembly.number_candidates(F.col("url"))).alias("candidate")).groupBy("page_id", "candidate").agg(F.count(F.lit(1)).alias("times"))


_HOSTS = "h AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS target FROM pages WHERE starts_with(url, 'https') UNION SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+/[a-z]+)', 1) FROM pages WHERE contains(url, 'example.com'))"


def _targets(t) -> DataFrame:
    host, folder = F.regexp_extract("url", "^(https?://[^/]+)", 1), F.regexp_extract("url", "^(https?://[^/]+/[a-z]+)", 1)
    return t("pages").where("startswith(url, 'https')").select(host.alias("target")).union(t("pages").where("contains(url, 'example.com')").select(folder.alias("target"))).distinct()


@query(f"""WITH {_HOSTS} SELECT url AS path, arg_max(target, length(target)) AS target FROM (SELECT DISTINCT url FROM pages) LEFT JOIN h ON url = target OR starts_with(url, target || '/') GROUP BY 1""")
def longest_prefix_join(t) -> DataFrame:
    return assembly.longest_prefix(t("pages").select(F.col("url").alias("path")).distinct(), _targets(t))


@query(f"""WITH {_HOSTS} SELECT DISTINCT url AS path FROM pages WHERE NOT EXISTS (SELECT 1 FROM h WHERE url = target OR starts_with(url, target || '/'))""")
def uncovered_paths(t) -> DataFrame:
    return assembly.uncovered(t("pages").select(F.col("url").alias("path")).distinct(), _targets(t).withColumnRenamed("target", "path"))


@query("""WITH a AS (SELECT o_custkey AS run, min(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT o_custkey AS run, max(o_orderkey) AS k FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT c_custkey AS run, coalesce(a.k, b.k) AS case_key, CASE WHEN a.k IS NOT NULL THEN 0 WHEN b.k IS NOT NULL THEN 1 END AS channel FROM customer LEFT JOIN a ON a.run = c_custkey LEFT JOIN b ON b.run = c_custkey""")
def resolved_by_channels(t) -> DataFrame:
    runs = t("customer").select(F.col("c_custkey").alias("run"))
    one = t("orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("run")).agg(F.min("o_orderkey").alias("case_key"))
    two = t("orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("run")).agg(F.max("o_orderkey").alias("case_key"))
    return assembly.resolved(runs, [one, two])


@query("""WITH a AS (SELECT p_partkey AS k, nullif(CASE WHEN p_size < 20 THEN '' ELSE p_brand END, '') AS brand, CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS size FROM part WHERE p_size > 10),
b AS (SELECT l_partkey AS k, 'line' AS brand, max(l_linenumber) AS size FROM lineitem GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.brand, b.brand) AS brand, coalesce(a.size, b.size) AS size, CASE WHEN a.k IS NULL THEN 1 ELSE 0 END AS layer FROM a FULL JOIN b ON a.k = b.k""")
def layered_registry(t) -> DataFrame:
    """Parts over order lines: earlier layers win, empty fields are filled."""
    first = t("part").where("p_size > 10").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") < 20, "").otherwise(F.col("p_brand")).alias("brand"), F.when(F.col("p_size") <= 40, F.col("p_size")).alias("size"))
    second = t("lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.lit("line").alias("brand"), F.max("l_linenumber").alias("size"))
    return assembly.first_layer_wins([first, second], "k")


@query("""WITH r AS (SELECT l_orderkey AS case_key, max(l_linenumber) AS pages_max, count(*) AS n_runs, count(DISTINCT l_returnflag) AS e, min(l_returnflag) AS one FROM lineitem GROUP BY 1), c AS (SELECT o_orderkey AS case_key, 4 AS frames FROM orders)
SELECT case_key, coalesce(pages_max, 0)::BIGINT AS pages_max, round_even(least(1.0::DOUBLE, coalesce(pages_max, 0)::DOUBLE / frames), 4)::DOUBLE AS coverage,
  CASE WHEN n_runs IS NULL THEN 'none' WHEN pages_max < 4 * 0.99 THEN 'partial' WHEN e > 1 THEN 'both' ELSE one END AS read_stage FROM c LEFT JOIN r USING (case_key)""")
def reading_stages(t) -> DataFrame:
    """Orders as cases of four frames, their lines as runs."""
    cases = t("orders").select(F.col("o_orderkey").alias("case_key"), F.lit(4).alias("frames"))
    runs = t("lineitem").select(F.col("l_orderkey").alias("case_key"), F.col("l_returnflag").alias("engine"), F.col("l_linenumber").cast("long").alias("pages"), F.col("l_shipdate").alias("updated"))
    return assembly.with_reading(cases, runs).select("case_key", "pages_max", "coverage", "read_stage")


@query("SELECT user_id, event_id FROM events QUALIFY (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) % 4 = 2")
def page_shard(t) -> DataFrame:
    return assembly.page_share(t("events").select("user_id", "event_id"), ["event_id"], 2, 4, ["user_id"])


@query("""WITH n AS (SELECT DISTINCT c_nationkey AS g, substr(c_name, 1, 9) AS prefix, substr(c_name, 10)::BIGINT AS n FROM customer), i AS (SELECT *, n - row_number() OVER (PARTITION BY g ORDER BY n) AS k FROM n)
SELECT g, 'Customer#' AS prefix, '' AS suffix, min(n) AS "first", max(n) AS "last", count(*) AS n FROM i GROUP BY g, k""")
def name_ranges(t) -> DataFrame:
    return assembly.name_ranges(t("customer").select(F.col("c_nationkey").alias("g"), "c_name"), "g", "c_name")


@query("""SELECT doc_id AS path, CASE WHEN n_chars % 7 = 0 THEN 'changed' WHEN lang = 'es' THEN 'missing' ELSE 'ok' END AS state FROM documents WHERE NOT (n_chars % 7 = 0 AND lang = 'es')
UNION ALL SELECT doc_id, 'missing' FROM documents WHERE n_chars % 7 = 0 AND lang = 'es'""")
def integrity_check(t) -> DataFrame:
    content = F.col("text").cast("binary")
    expected = t("documents").select(F.col("doc_id").alias("path"), (F.length(content) + F.when(F.col("n_chars") % 7 == 0, 1).otherwise(0)).alias("size"), F.sha2(content, 256).alias("sha256"))
    files = t("documents").where("lang <> 'es'").select(F.col("doc_id").alias("path"), content.alias("content"))
    return entities.integrity(files, expected)


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages) SELECT href, count(DISTINCT page_id) AS n_pages FROM a GROUP BY 1""")
def link_targets(t) -> DataFrame:
    return archive_tables.links(t("pages")).groupBy("href").agg(F.count_distinct("page_id").alias("n_pages"))
