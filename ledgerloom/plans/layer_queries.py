"""Queries that number, cover and overlay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import layers
from ledgerloom.plans.queries import query

_VALUE = "l_returnflag || '-' || l_linestatus || '-' || l_suppkey::VARCHAR"


@query(f"""WITH r AS (SELECT *, {_VALUE} AS v, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem),
d AS (SELECT v, row_number() OVER (ORDER BY min(k)) - 1 AS id FROM r GROUP BY v) SELECT l_orderkey, l_linenumber, l_partkey, id AS code FROM r JOIN d USING (v)""")
def dictionary_encoded(t) -> DataFrame:
    """Marks of order lines as numbers in the order in which they first occur."""
    value = F.concat_ws("-", "l_returnflag", "l_linestatus", F.col("l_suppkey").cast("string"))
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", value.alias("v"))
    return layers.encoded(rows, "v", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "code").drop("l_extendedprice")


_SPANS = """s AS (SELECT c_nationkey AS nation, epoch(o_orderdate)::BIGINT // 86400 AS lo, epoch(o_orderdate)::BIGINT // 86400 + o_orderkey % 60 - 2 AS hi FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 60 >= 2 AND c_custkey % 9 = 0),
p AS (SELECT nation, pt, sum(step) AS step FROM (SELECT nation, lo AS pt, 1 AS step FROM s UNION ALL SELECT nation, hi + 1, -1 FROM s) GROUP BY ALL),
d AS (SELECT nation, pt AS low, lead(pt) OVER w - 1 AS high, sum(step) OVER w AS depth FROM p WHERE step <> 0 WINDOW w AS (PARTITION BY nation ORDER BY pt))"""


def _spans(t) -> DataFrame:
    day = F.floor(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400).cast("long")
    orders = t("orders").join(t("customer").where("c_custkey % 9 = 0").select("c_custkey", F.col("c_nationkey").alias("nation")), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select("nation", day.alias("lo"), (day + F.col("o_orderkey") % 60 - 2).alias("hi"))


@query(f"WITH {_SPANS} SELECT nation, low, high, depth::BIGINT AS depth FROM d WHERE depth > 0")
def coverage_depths(t) -> DataFrame:
    """Orders as spans of days that sources cover, some ending before they start, by nation."""
    return layers.depths(_spans(t), ["nation"], "lo", "hi")


@query(f"""WITH {_SPANS}, n AS (SELECT *, CASE WHEN low - 1 > lag(high) OVER (PARTITION BY nation ORDER BY low) THEN 1 ELSE 0 END AS new FROM d WHERE depth > 0),
r AS (SELECT *, sum(new) OVER (PARTITION BY nation ORDER BY low) AS run FROM n), c AS (SELECT nation, min(low) AS low, max(high) AS high, max(depth)::BIGINT AS deepest FROM r GROUP BY nation, run)
SELECT *, lead(low) OVER (PARTITION BY nation ORDER BY low) - high - 1 AS gap_after FROM c""")
def coverage_gaps(t) -> DataFrame:
    """The same as stretches without a gap, and what is missing between them."""
    return layers.covered(layers.depths(_spans(t), ["nation"], "lo", "hi"), ["nation"])


_LAYER = """CASE WHEN event_id % 3 = 0 THEN '{"a": {"x": ' || event_id::VARCHAR || ', "y": [1, 2]}, "p": ' || props || '}' WHEN event_id % 3 = 1 THEN '{"a": {"z": {"w": "' || event_type || '"}}, "p": {"q": ' || event_id::VARCHAR || '}}' WHEN event_id % 7 > 0 THEN '{"a": {"x": "last", "z": {"v": 1}}}' END"""


@query(f"""WITH RECURSIVE l AS (SELECT user_id, event_id, {_LAYER} AS s FROM events), n AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM l WHERE s IS NOT NULL),
m(user_id, k, s) AS (SELECT user_id, k, s::JSON FROM n WHERE k = 1 UNION ALL SELECT m.user_id, n.k, json_merge_patch(m.s, n.s::JSON) FROM m JOIN n ON n.user_id = m.user_id AND n.k = m.k + 1),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1)
SELECT user_id, s->>'$.a.x' AS x, s->>'$.a.y' AS y, s->>'$.a.z.w' AS w, s->>'$.a.z.v' AS v, s->>'$.p.k' AS k, s->>'$.p.q' AS q FROM f""")
def overlaid_settings(t) -> DataFrame:
    """Events as layers of their user's settings, nested, missing and replaced."""
    k = F.col("event_id").cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    one = text('{"a": {"x": ', k, ', "y": [1, 2]}, "p": ', F.col("props"), "}")
    two = text('{"a": {"z": {"w": "', F.col("event_type"), '"}}, "p": {"q": ', k, "}}")
    way = F.col("event_id") % 3
    layer = F.when(way == 0, one).when(way == 1, two).when(F.col("event_id") % 7 > 0, '{"a": {"x": "last", "z": {"v": 1}}}')
    found = layers.overlaid(t("events").select("user_id", "event_id", layer.alias("settings")), "user_id", "event_id", "settings")
    paths = {"x": "a.x", "y": "a.y", "w": "a.z.w", "v": "a.z.v", "k": "p.k", "q": "p.q"}
    return found.select("user_id", *(layers.setting(F.col("settings"), p).alias(c) for c, p in paths.items()))
