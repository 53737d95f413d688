"""Keyed state with a time to live: submissions admitted once, silent jobs stopped, attempts supervised.

The same rules run over streams, as ``transformWithState`` with value state and
event-time timers, and over finished logs.  A stream answers at once: rows of
a micro-batch are taken in the order of their times, and a batch and a stream
agree wherever rows that belong together out of order arrive together.

Edge cases: a row without a key is admitted always, as nothing can be said to
repeat it; a row without a time is not admitted; of equal times the smaller
``order`` comes first; a row that comes late, before a job it would repeat,
repeats it as well.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds for which a submission is remembered, and after which a job without a sign of life is stopped.
TTL, STALE = 600, 45
#: Groups of keys whose state is kept together: a call for each key costs far more than its rows.
GROUPS = 1024
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_ones(times: np.ndarray, ttl: int, created: int | None) -> tuple[list[int], int | None]:
    """Positions in sorted times that are no repeat of the last one that counted, and that one's time in the end."""
    found, at = [], 0
    if created is not None:
        at = int(np.searchsorted(times, created + ttl, "right"))
    while at < len(times):
        found.append(at)
        created = int(times[at])
        at = int(np.searchsorted(times, created + ttl, "right"))
    return found, created


def _admit(key: str, run: str, ttl: int):
    """Rows sorted by key, run and time, a batch at a time; what was created last goes on to the next batch."""

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, created = None, None
        for batch in batches:
            if not len(batch):
                continue
            names = list(zip(batch[key].to_pylist(), batch[run].to_pylist(), strict=True))
            times = batch["_us"].to_numpy()
            starts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            kept: list[int] = []
            for lo, hi in zip(starts, starts[1:], strict=False):
                if names[lo] != held:
                    held, created = names[lo], None
                found, created = first_ones(times[lo:hi], ttl, created)
                kept += [lo + k for k in found]
            yield batch.take(pa.array(kept, pa.int64()))

    return admit


def idempotent_batch(submissions: DataFrame, key: str, at: str, order: str, seconds: int = TTL) -> DataFrame:
    """Submissions of a finished log that create a job: the first of a key, and each first one after the last job's time to live.

    A key's log falls into runs wherever it is silent for longer than that,
    and each run starts with a job of its own; runs are found on counts of
    time to live alone, so a key is dealt out by its runs.  Within one run the
    rows pass in order, with the last job in memory and nothing else.
    """
    ttl = seconds * 1_000_000
    us = F.unix_micros(F.col(at).cast("timestamp"))
    named = submissions.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").withColumn("_us", us).where("_us is not null")
    named = named.withColumn("_span", F.floor(F.col("_us") / ttl))
    by_time = W.Window.partitionBy(key).orderBy("_span")
    spans = named.groupBy(key, "_span").agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    after_silence = F.col("_lo") - F.coalesce(F.lag("_hi").over(by_time), F.lit(-(1 << 62))) > ttl
    runs = spans.withColumn("_first", F.when(after_silence, F.col("_span"))).select(key, "_span", F.max("_first").over(by_time).alias("_run"))
    dealt = named.join(runs, [key, "_span"]).repartition(key, "_run").sortWithinPartitions(key, "_run", "_us", order)
    created = dealt.mapInArrow(_admit(key, "_run", ttl), dealt.schema).select(*submissions.columns)
    return created.unionByName(submissions.where((F.coalesce(F.col(key).cast("string"), F.lit("")) == "") & F.col(at).isNotNull()))


class _Grouped(StatefulProcessor):
    """State of a group of keys as one value, {key: [time in microseconds, ...]}, with a timer for whichever is over first."""

    def __init__(self, key: str, at: str, order: str, wait_us: int) -> None:
        self.key, self.at, self.order, self.wait = key, at, order, wait_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", T.StructType([T.StructField("json", T.StringType())]))

    def load(self) -> dict:
        return dict(json.loads(self.held.get()[0])) if self.held.exists() else {}

    def save(self, held: dict) -> None:
        if held:
            self.held.update((json.dumps(list(held.items())),))
            self.handle.registerTimer((min(v[0] for v in held.values()) + self.wait) // 1000 + 1)
        else:
            self.held.clear()

    def keyed(self, rows) -> Iterator[tuple]:
        """Each key with its rows in order."""
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch[batch[self.at].notna()].sort_values([self.key, self.at, self.order], kind="stable")
        keys = [None] * len(batch) if batch[self.key].isna().all() else batch[self.key].tolist()
        starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
        for lo, hi in zip(starts, [*starts[1:], len(keys)], strict=True):
            yield keys[lo], batch.iloc[lo:hi]

    def over(self, held: dict, timers) -> dict:
        """What is over by the watermark, taken out of what is held."""
        due = {k: v for k, v in held.items() if v[0] + self.wait < timers.getCurrentWatermarkInMs() * 1000}
        for k in due:
            del held[k]
        return due

    def close(self) -> None:
        pass


class Submissions(_Grouped):
    """Remembers each key's last job for the time to live, counted from the submission that created it."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, kept = self.load(), []
        for name, batch in self.keyed(rows):
            found, created = first_ones(micros(batch[self.at]), self.wait, held[name][0] if name in held else None)
            held[name] = [created]
            kept.append(batch.iloc[found])
        self.save(held)
        if kept:
            yield pd.concat(kept, ignore_index=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # State goes once no row can come that it would make a repeat.
        held = self.load()
        if self.over(held, timerValues):
            self.save(held)
        return iter(())


def micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy("datetime64[us]").astype(np.int64)


def _group(key: str) -> Column:
    """The group of a key; rows without one are a group of their own, so that pandas keeps whole numbers whole."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int"))


def idempotent(submissions: DataFrame, key: str, at: str, order: str, seconds: int = TTL, late: str = "10 minutes") -> DataFrame:
    """The same over a stream; ``late`` is how late a row may come."""
    submissions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    named = submissions.withWatermark(at, late).where(F.col(key) != "")
    processor = Submissions(key, at, order, seconds * 1_000_000)
    return named.withColumn("_group", _group(key)).groupBy("_group").transformWithStateInPandas(processor, submissions.schema, "Append", "eventTime")


class Silence(_Grouped):
    """Stops a job that gives no sign of life for the stale time, and names the page that it was on."""

    def __init__(self, job: str, at: str, order: str, page: str, stale_us: int) -> None:
        super().__init__(job, at, order, stale_us)
        self.page = page

    def _stopped(self, found: list[tuple]) -> Iterator[pd.DataFrame]:
        if found:
            jobs, last = zip(*found, strict=True)
            yield pd.DataFrame({"job": jobs, "page": [page for _, page in last], "stopped_us": [us + self.wait for us, _ in last]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, stopped = self.load(), []
        for job, batch in self.keyed(rows):
            last = held.get(job)
            for us, page in zip(micros(batch[self.at]).tolist(), batch[self.page].tolist(), strict=True):
                if last is not None and us - last[0] > self.wait:
                    stopped.append((job, last))
                if last is None or us >= last[0]:
                    last = [us, page]
            held[job] = last
        self.save(held)
        yield from self._stopped(stopped)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.load()
        due = self.over(held, timerValues)
        if due:
            self.save(held)
        yield from self._stopped(list(due.items()))


def silent_jobs(beats: DataFrame, job: str, at: str, order: str, page: str, seconds: int = STALE, late: str = "0 seconds") -> DataFrame:
    """(job, page, stopped_us) of a stream's jobs as they fall silent: when each is stopped, and its page, which goes to quarantine."""
    beats.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = T.StructType([T.StructField("job", beats.schema[job].dataType), T.StructField("page", T.StringType()), T.StructField("stopped_us", T.LongType())])
    return beats.withWatermark(at, late).withColumn("_group", _group(job)).groupBy("_group").transformWithStateInPandas(Silence(job, at, order, page, seconds * 1_000_000), schema, "Append", "eventTime")


def silent_jobs_batch(beats: DataFrame, job: str, at: str, order: str, page: str, seconds: int = STALE) -> DataFrame:
    """The same over a finished log, which is known as far as its last row: a job silent to the end is stopped if the stale time had passed by then.

    Only the last row of each stale time of a job meets its neighbours, so a
    busy job brings few rows to the window.
    """
    stale = seconds * 1_000_000
    rows = beats.select(F.col(job).alias("job"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(order).alias("nth"), F.col(page).cast("string").alias("page")).where("us is not null")
    spans = rows.groupBy("job", F.floor(F.col("us") / stale).alias("span")).agg(F.min("us").alias("lo"), F.max(F.struct("us", "nth", "page")).alias("last"))
    end = rows.agg(F.max("us")).first()[0] or 0
    following = F.lead("lo").over(W.Window.partitionBy("job").orderBy("span"))
    silent = F.coalesce(following, F.lit(end // 1000 * 1000)) - F.col("last.us") > stale
    return spans.withColumn("silent", silent).where("silent").select("job", "last.page", (F.col("last.us") + stale).alias("stopped_us"))


def _attempt(most: int):
    """What an attempt adds to what is known: pages in quarantine, how many were missing, whether it is over."""

    def step(state: Column, a: Column) -> Column:
        gone = F.filter(a["missing"], lambda p: ~F.array_contains(state["quarantined"], p))
        over = state["over"] | (F.size(gone) == 0) | (a["attempt"] > most)
        stuck = ~state["over"] & (a["attempt"] <= most) & (F.size(gone) > 0) & (F.coalesce(a["code"], F.lit(0)) != 0) & (F.size(gone) >= state["before"])
        why = F.when(a["code"] == 3, "fails twice").otherwise("ends the process twice")
        return F.struct(
            over.alias("over"),
            F.when(state["over"], state["before"]).otherwise(F.size(gone)).alias("before"),
            F.when(stuck, F.concat(state["quarantined"], F.array(F.get(gone, F.lit(0))))).otherwise(state["quarantined"]).alias("quarantined"),
            F.when(stuck, F.concat(state["reasons"], F.array(why))).otherwise(state["reasons"]).alias("reasons"),
            F.when(state["over"], state["missing"]).otherwise(gone).alias("missing"),
            F.when(state["over"], state["attempts"]).otherwise(a["attempt"]).alias("attempts"),
        )

    return step


def supervised(attempts: DataFrame, run: str, most: int) -> DataFrame:
    """Each run's outcome from its attempts (attempt from 1, code, missing pages in order): attempts that counted, quarantine with reasons, what is missing in the end.

    An attempt that missed as many pages as the one before and did not end well
    puts its first missing page into quarantine, so that the next attempt gets
    to the others.  There are ``most`` attempts after the first one at most.
    """
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("over"), F.lit(1 << 30).alias("before"), none.alias("quarantined"), none.alias("reasons"), none.alias("missing"), F.lit(0).alias("attempts"))
    tried = F.array_sort(F.collect_list(F.struct(F.col("attempt").cast("int").alias("attempt"), F.col("code").cast("int").alias("code"), F.coalesce("missing", none).alias("missing"))))
    found = attempts.where(F.col("attempt").between(1, most + 1)).groupBy(run).agg(F.aggregate(tried, start, _attempt(most)).alias("s"))
    return found.select(run, "s.attempts", "s.quarantined", "s.reasons", "s.missing", (F.size("s.missing") == 0).alias("complete"))
