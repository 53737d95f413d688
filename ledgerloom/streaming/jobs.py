"""Job events: last states, heartbeats as sessions, the progress protocol, upserts; what needs state with a time to live is in ``keyed``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.notes import last_wins
from ledgerloom.storage import hadoop_fs

PROTOCOL_VERSION = 1
PREFIX = "@progress "
EVENT = "v int, phase string, i int, n int, item string, done int, skipped int, failed int, message string"
FINAL = ("done", "error", "cancelled")


def progress_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """Protocol lines as events; other lines, broken JSON and foreign versions are none."""
    event = F.from_json(F.substring(line, len(PREFIX) + 1, 1 << 30), EVENT)
    return lines.where(F.col(line).startswith(PREFIX)).withColumn("_e", event).where(F.col("_e.v") == PROTOCOL_VERSION).select(*[c for c in lines.columns if c != line], "_e.*")


def plain_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """The lines that are no events: each line goes one way or the other."""
    event = F.from_json(F.substring(line, len(PREFIX) + 1, 1 << 30), EVENT)
    return lines.where(~(F.col(line).startswith(PREFIX) & F.coalesce(event["v"] == PROTOCOL_VERSION, F.lit(False))))


def heartbeat_sessions(beats: DataFrame, owner: str, at: str = "ts", stale: str = "45 seconds", watermark: str | None = None) -> DataFrame:
    """Stretches of heartbeats without a gap of the stale time, for streams and tables alike."""
    rows = beats.withWatermark(at, watermark) if watermark else beats
    found = rows.groupBy(owner, F.session_window(at, stale).alias("_w")).agg(F.count(F.lit(1)).alias("n_beats"))
    return found.select(owner, F.col("_w.start").alias("started"), F.col("_w.end").alias("stale_at"), "n_beats")


def since(events: DataFrame, cursor: int, most: int = 2000) -> DataFrame:
    """Events after a cursor, the oldest first; a reader passes the last one's number next time."""
    return events.where(F.col("seq") > cursor).orderBy("seq").limit(most)


def last_states(events: DataFrame, job: str = "job_id", seq: str = "seq") -> DataFrame:
    """Each job's state: the first final one if there is any, for final states never change, else the last."""
    final = F.col("state").isin(*FINAL)
    first_final = F.min_by(F.when(final, F.col("state")), F.when(final, F.col(seq)))
    return events.groupBy(job).agg(F.coalesce(first_final, F.max_by("state", seq)).alias("state"), F.max(seq).alias("seq"))


def recovered(states: DataFrame) -> DataFrame:
    """After a restart, jobs that had not finished are errors."""
    return states.withColumn("state", F.when(F.col("state").isin(*FINAL), F.col("state")).otherwise("error"))


#: Parts of an upserted table, by hash of the key; a batch rewrites those it touches.
BUCKETS = 64


def _manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, int]]:
    """The newest complete version of an upserted table, and which version each of its parts was last written by."""
    fs, where = hadoop_fs(spark, f"{path}/_versions/*/_SUCCESS")
    versions = sorted(int(status.getPath().getParent().getName()) for status in fs.globStatus(where) or [])
    if not versions:
        return -1, {}
    rows = spark.read.schema("bucket int, version long").json(f"{path}/_versions/{versions[-1]:020d}").where("bucket is not null").collect()
    return versions[-1], {r["bucket"]: r["version"] for r in rows}


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of an upserted table, None before its first batch."""
    _, parts = _manifest(spark, path)
    return spark.read.parquet(*(f"{path}/{version:020d}/bucket={bucket}" for bucket, version in sorted(parts.items()))) if parts else None


def upserted(batch: DataFrame, epoch: int, path: str, key: str, order: str) -> None:
    """Put the last row of each key of a batch into the table at ``path``.

    Parts that the batch touches are written anew beside the old ones; the
    list of parts, written last, makes them count.  Whatever a crash leaves is
    never read, and a batch that is repeated changes nothing.
    """
    spark = batch.sparkSession
    version, parts = _manifest(spark, path)
    if epoch <= version:
        return
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
    touched = [r["bucket"] for r in batch.select(bucket.alias("bucket")).distinct().collect()]
    old = [f"{path}/{parts[b]:020d}/bucket={b}" for b in touched if b in parts]
    rows = last_wins(batch.unionByName(spark.read.parquet(*old)) if old else batch, key, order)
    rows.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{epoch:020d}")
    listed = spark.createDataFrame(sorted((parts | dict.fromkeys(touched, epoch)).items()), "bucket int, version long")
    listed.coalesce(1).write.mode("overwrite").json(f"{path}/_versions/{epoch:020d}")


def upsert_batches(stream: DataFrame, path: str, key: str, order: str, checkpoint: str):
    """A query that keeps the last row of each key in the upserted table at ``path``."""
    put = lambda batch, epoch: upserted(batch, epoch, path, key, order)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stale(newest_source: Column, built: Column, slack_seconds: float = 1) -> Column:
    """Whether a derived table is older than its source; unknown where either time is."""
    return F.when(newest_source.isNull() | built.isNull(), "unknown").when(newest_source.cast("double") > built.cast("double") + slack_seconds, "stale").otherwise("fresh")
