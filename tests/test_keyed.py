"""Keyed state: streams and finished logs give equal rows, by the rule counted from the first submission."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import keyed

START = datetime(2024, 1, 1)
ROWS = "id long, key string, at timestamp, page string"


def at(seconds):
    return START + timedelta(seconds=seconds)


def plain(rows, ttl):
    last, out = {}, []
    for i, key, when, _ in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        if not key or key not in last or (when - last[key]).total_seconds() > ttl:
            out.append(i)
            if key:
                last[key] = when
    return sorted(out)


def test_time_to_live_counts_from_the_job_that_was_created(spark):
    rows = [(1, "a", at(0), "p"), (2, "a", at(400), "p"), (3, "a", at(800), "p"), (4, "a", at(1000), "p"), (5, "a", at(1401), "p")]
    got = keyed.idempotent_batch(spark.createDataFrame(rows, ROWS), "key", "at", "id")
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 5] == plain(rows, 600)


def test_batch_edges(spark):
    rows = [(1, None, at(0), "p"), (2, "", at(0), "p"), (3, "a", None, "p"), (4, "a", at(0), "p"), (5, "a", at(0), "p"), (6, "a", at(600), "p"), (7, "a", at(600.000001), "p"), (8, "b", at(-5000), "p")]
    got = keyed.idempotent_batch(spark.createDataFrame(rows, ROWS), "key", "at", "id")
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 4, 7, 8]
    assert keyed.idempotent_batch(spark.createDataFrame([], ROWS), "key", "at", "id").count() == 0


@pytest.mark.parametrize("batch_rows", ["10000", "3"])
def test_batch_against_the_plain_rule(spark, batch_rows):
    """A hot key, silences, ties; also where a run is cut into many batches."""
    rng = random.Random(5)
    rows, when = [], 0.0
    for i in range(800):
        when += rng.choice([0, 1, 30, 200, 590, 601, 5000])
        rows.append((i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}", at(when), "p"))
    rng.shuffle(rows)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, batch_rows)
    try:
        got = keyed.idempotent_batch(spark.createDataFrame(rows, ROWS).repartition(6), "key", "at", "id")
        assert sorted(r["id"] for r in got.collect()) == plain(rows, 600)
    finally:
        spark.conf.set(setting, before)


def _streamed(spark, rows, folder, transform):
    """Rows in five files, read one file a micro-batch."""
    for k in range(5):
        part = [r for r in rows if (r[2] - START).total_seconds() // 2000 == k]
        spark.createDataFrame(part, ROWS).coalesce(1).write.parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    found = transform(stream)
    found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination(240)
    return spark.read.schema(found.schema).parquet(f"{folder}/out").collect()


def test_streams_agree_with_batches(spark, tmp_path):
    rng = random.Random(6)
    times = sorted(rng.sample(range(10_000), 120))
    rows = [(i, f"k{rng.randrange(4)}", at(s), f"p{i % 7}") for i, s in enumerate(times)]
    table = spark.createDataFrame(rows, ROWS)
    got = _streamed(spark, rows, tmp_path / "a", lambda s: keyed.idempotent(s, "key", "at", "id"))
    want = keyed.idempotent_batch(table, "key", "at", "id").collect()
    assert sorted(r["id"] for r in got) == sorted(r["id"] for r in want) == plain(rows, 600)
    got = _streamed(spark, rows, tmp_path / "b", lambda s: keyed.silent_jobs(s, "key", "at", "id", "page", 300))
    want = keyed.silent_jobs_batch(table, "key", "at", "id", "page", 300).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 4


def test_supervised(spark):
    attempts = [
        ("ok", 1, 0, []), ("ok", 2, 1, ["late"]),
        # One page ends the process twice, then the rest is read.
        ("stuck", 1, 1, ["a", "b"]), ("stuck", 2, 1, ["a", "b"]), ("stuck", 3, 0, ["a"]),
        # Progress every time: nothing goes to quarantine, and after the last attempt one page is missing.
        ("slow", 1, 1, ["a", "b", "c"]), ("slow", 2, 1, ["a", "b"]), ("slow", 3, 1, ["b"]),
        ("fails", 1, 3, ["x"]), ("fails", 2, 3, ["x"]), ("none", 1, None, None),
    ]
    rows = spark.createDataFrame(attempts, "run string, attempt int, code int, missing array<string>")
    got = {r["run"]: (r["attempts"], r["quarantined"], r["reasons"], r["missing"], r["complete"]) for r in keyed.supervised(rows, "run", 2).collect()}
    assert got == {
        "ok": (1, [], [], [], True), "stuck": (3, ["a"], ["ends the process twice"], [], True), "slow": (3, [], [], ["b"], False),
        "fails": (2, ["x"], ["fails twice"], ["x"], False), "none": (1, [], [], [], True),
    }
    assert keyed.supervised(rows.limit(0), "run", 2).count() == 0


def test_a_silent_job_is_stopped_once(spark):
    rows = spark.createDataFrame([(1, "a", at(0), "p1"), (2, "a", at(10), "p2"), (3, "a", at(100), "p3"), (4, "b", at(99), None), (5, "c", None, "p")], ROWS)
    got = keyed.silent_jobs_batch(rows, "key", "at", "id", "page").select("job", "page", (F.col("stopped_us") - 1704067200 * 1000000).alias("s")).collect()
    assert [tuple(r) for r in got] == [("a", "p2", 55_000_000)]
