"""Queries over events as submissions, heartbeats and attempts, in batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ledgerloom.plans.queries import query
from ledgerloom.storage import new_path, remove
from ledgerloom.streaming import keyed

#: Submissions a few minutes apart repeat each other; users are silent for hours.
REMEMBERED, SILENT = 6 * 3600, 12 * 3600

_ADMITTED = f"""WITH RECURSIVE n AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
walk(event_id, user_id, event_type, k, us, created, is_new) AS (
  SELECT event_id, user_id, event_type, k, us, us, true FROM n WHERE k = 1
  UNION ALL SELECT n.event_id, n.user_id, n.event_type, n.k, n.us, CASE WHEN n.us - w.created > {REMEMBERED} * 1000000::BIGINT THEN n.us ELSE w.created END, n.us - w.created > {REMEMBERED} * 1000000::BIGINT
  FROM walk w JOIN n ON n.user_id = w.user_id AND n.event_type = w.event_type AND n.k = w.k + 1)
SELECT event_id, user_id, event_type FROM walk WHERE is_new"""


def _submissions(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.concat_ws("/", "user_id", "event_type").alias("key"))


def _as_stream(t, name: str) -> DataFrame:
    """A given table, a file or a folder of files, as a stream."""
    table = t(name)
    folder, leaf = table.inputFiles()[0].rsplit("/", 1)
    return table.sparkSession.readStream.schema(table.schema).option("pathGlobFilter", "*.parquet" if folder.endswith(f"/{name}.parquet") else leaf).parquet(folder)


def _to_the_end(stream: DataFrame) -> DataFrame:
    """What a stream gives once all its input is read."""
    spark = stream.sparkSession
    out, state = new_path(spark, "streamed"), new_path(spark, "streaming")
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    remove(spark, state)
    return spark.read.schema(stream.schema).parquet(out)


@query(_ADMITTED)
def idempotent_stream(t) -> DataFrame:
    """Submissions of users that create a job; counted from the one that created the job before."""
    return keyed.idempotent_batch(_submissions(t("events")), "key", "ts", "event_id", REMEMBERED).select("event_id", "user_id", "event_type")


@query(_ADMITTED)
def idempotent_live(t) -> DataFrame:
    """The same with the events as a stream and the jobs as keyed state."""
    found = keyed.idempotent(_submissions(_as_stream(t, "events")), "key", "ts", "event_id", REMEMBERED)
    return _to_the_end(found).select("event_id", "user_id", "event_type")


_SILENT = f"""WITH b AS (SELECT user_id, event_type, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_us, (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) AS end_us FROM events)
SELECT user_id AS job, event_type AS page, us + {SILENT} * 1000000::BIGINT AS stopped_us FROM b WHERE coalesce(next_us, end_us) - us > {SILENT} * 1000000::BIGINT"""


@query(_SILENT)
def silent_jobs(t) -> DataFrame:
    """Users as jobs that fall silent, with the page that goes to quarantine."""
    return keyed.silent_jobs_batch(t("events"), "user_id", "ts", "event_id", "event_type", SILENT)


@query(_SILENT)
def silent_jobs_live(t) -> DataFrame:
    """The same as a stream, with a timer for each job."""
    beats = _as_stream(t, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _to_the_end(keyed.silent_jobs(beats, "user_id", "ts", "event_id", "event_type", SILENT))


#: Attempts after the first.
RETRIES = 4


@query(f"""WITH RECURSIVE a AS (
  SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS attempt, (o_orderkey % 5)::INT AS code,
    (SELECT list('p' || l_linenumber::VARCHAR ORDER BY l_linenumber) FROM (SELECT DISTINCT l_linenumber FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'N')) AS missing FROM orders),
tries AS (SELECT run, attempt, code, coalesce(missing, []::VARCHAR[]) AS missing FROM a WHERE attempt <= {RETRIES + 1}),
walk(run, attempt, over_now, seen_before, quarantined, missing, attempts) AS (
  SELECT run, 0, false, 1000000, []::VARCHAR[], []::VARCHAR[], 0 FROM tries WHERE attempt = 1
  UNION ALL
  SELECT run, attempt, over_now OR len(gone) = 0 OR attempt > {RETRIES}, CASE WHEN over_now THEN seen_before ELSE len(gone) END,
    CASE WHEN NOT over_now AND attempt <= {RETRIES} AND len(gone) > 0 AND code <> 0 AND len(gone) >= seen_before THEN list_append(quarantined, gone[1]) ELSE quarantined END,
    CASE WHEN over_now THEN missing ELSE gone END, CASE WHEN over_now THEN attempts ELSE attempt END
  FROM (SELECT w.run, t.attempt, w.over_now, w.seen_before, w.quarantined, w.missing, w.attempts, t.code, list_filter(t.missing, lambda p: NOT list_contains(w.quarantined, p)) AS gone
    FROM walk w JOIN tries t ON t.run = w.run AND t.attempt = w.attempt + 1) x)
SELECT run, attempts, array_to_string(quarantined, ',') AS quarantined, array_to_string(missing, ',') AS missing FROM walk QUALIFY row_number() OVER (PARTITION BY run ORDER BY attempt DESC) = 1""")
def supervised_runs(t) -> DataFrame:
    """Customers as runs, their orders as attempts, returned lines as pages that were not read."""
    missing = t("lineitem").where("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_set("l_linenumber")), lambda n: F.concat(F.lit("p"), n.cast("string"))).alias("missing"))
    orders = t("orders").join(missing, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    attempt = F.row_number().over(W.Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    attempts = orders.select(F.col("o_custkey").alias("run"), attempt.alias("attempt"), (F.col("o_orderkey") % 5).alias("code"), "missing")
    found = keyed.supervised(attempts, "run", RETRIES)
    return found.select("run", "attempts", F.array_join("quarantined", ",").alias("quarantined"), F.array_join("missing", ",").alias("missing"))
