"""Where intermediate tables live.

Executors share no local disk, so everything that outlives a stage goes below
``spark.checkpoint.dir``.  Only a local session, as in tests, may lack that
setting; it then gets a fresh temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a trailing slash."""
    found = spark.conf.get(_SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_SETTING} to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set(_SETTING, found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and return a scan of it.

    Cuts the lineage, survives the loss of executors and gives later stages
    statistics and column pruning.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    for paths in _SCOPES:
        paths.add(path)
    return table


def discard(table: DataFrame) -> None:
    """Delete what ``stored`` wrote for a table that nothing will read any more."""
    remove(table.sparkSession, table.stored_at)


#: Paths of tables stored in the scopes that are open, outermost first.
_SCOPES: list[set[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[set[str]]:
    """What is stored inside is deleted at the end, but for paths taken out of the set given."""
    paths: set[str] = set()
    _SCOPES.append(paths)
    try:
        yield paths
    finally:
        _SCOPES.pop()
        for path in paths:
            remove(spark, path)


#: Rows of a key or a few numbers that may be sent to every executor: some tens of MB.
BROADCAST_ROWS = 500_000


def shuffled(table: DataFrame) -> DataFrame:
    """A table marked to be shuffled where it is joined, together with what it meets.

    Spark judges a stored table by its files, and what it computes from one by
    that: names that differ in few letters compress a hundredfold, and the
    driver would gather millions of rows for a broadcast of "some MB".
    """
    return table.hint("merge")


def broadcast_if_small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow stored table, marked for broadcast if it has been counted and is small; else marked to be shuffled."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else shuffled(table)


def divided(rows: DataFrame, most: int) -> DataFrame:
    """Rows divided evenly, over tasks of ``most`` at most: few rows or a small file are one task, though each row may make hundreds."""
    return rows.repartition(max(1, -(-rows.count() // most)))


#: Rows of a few numbers that one task sorts or groups: some hundred MB.
TASK_ROWS = 1_000_000


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Narrow rows dealt out by some columns, to so many tasks that each has TASK_ROWS at most, if no key has more."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // TASK_ROWS)), *by)


#: Rows of several names that one task sorts: some hundred MB with what joins and aggregates hold of them.
NAMED_ROWS = 250_000


@contextmanager
def small_tasks(spark: SparkSession, rows: int = 0) -> Iterator[None]:
    """Jobs run inside give a task about NAMED_ROWS rows, however many there are, if no key of an aggregate has more.

    Of ``rows`` rows that are shuffled, tasks take equal parts and are joined
    only while small; of a key with very many the rows are split where they
    are joined.  Tables stored inside are files of so many rows, each a task.
    """
    conf = spark.conf
    parts = max(int(conf.get("spark.sql.shuffle.partitions")), -(-rows // NAMED_ROWS))
    inside = {
        "spark.sql.shuffle.partitions": str(parts), "spark.sql.files.maxRecordsPerFile": str(NAMED_ROWS), "spark.sql.files.maxPartitionBytes": "16m", "spark.sql.files.openCostInBytes": "16m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16m",
    }
    before = {key: conf.get(key) for key in inside}
    try:
        for key, value in inside.items():
            conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            conf.set(key, value)


def hadoop_fs(spark: SparkSession, path: str):
    """Hadoop file system and path object for ``path``, whatever store it is in."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = hadoop_fs(spark, path)
    fs.delete(where, True)
