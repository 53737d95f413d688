"""Word and byte expressions that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of digits, lower-case letters and anything beyond ASCII.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs of anything but ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"

#: Rows of whole texts in an Arrow batch; long texts make larger batches dangerous.
TEXT_BATCH = 64

#: UTF-8 bytes of item words in lower case, blanks for all between; no byte of a longer character is below 80.
_ITEM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def item_words(text: str | None) -> list[bytes]:
    """ITEM_WORD's matches in a text whose A to Z are lower case, in UTF-8."""
    return text.encode().translate(_ITEM_BYTES).split() if text else []


def spaced_words(text: str | None) -> list[bytes]:
    """SPACED_WORD's matches in a text whose A to Z are lower case, in UTF-8; both bytes methods know ASCII alone."""
    return text.encode().lower().split() if text else []


def ascii_lower(c: Column) -> Column:
    """Lower-case A to Z alone, leaving every other letter as it is."""
    return F.translate(c, UPPER, LOWER)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int = TEXT_BATCH) -> Iterator[None]:
    """Jobs run inside exchange at most ``rows`` rows at a time with Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def utf8_size(c: Column) -> Column:
    return F.octet_length(F.coalesce(c, F.lit(""))).cast("long")
