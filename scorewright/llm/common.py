"""What several operators of this package share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1_000
BATCH_BYTES = 8 * 1024 * 1024

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = r"[\x20\x09-\x0D]+"
BREAK = re.compile(rb"[\x20\x09-\x0D]")
PIECE = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand Python at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` at a time, so long texts stay within memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of a text column, without decoding them."""
    return iter(column.cast(pa.binary()).to_pylist())


def pieces(text: bytes, separators: re.Pattern[bytes] = BREAK, size: int = PIECE) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes, cut only at separators, so that no word is cut."""
    at = 0
    while len(text) - at > size:
        cut = separators.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    ``lower`` does that on texts without other letters and is much faster than ``translate``.
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column, separators: str = SPACES) -> Column:
    """The words between runs of separators, none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def fold(column: Column, key: Column, remainder: int, folds: int) -> Column:
    """``column`` where crc32 of the key as text leaves another remainder, else null."""
    return F.when(F.crc32(key.cast("string")) % folds != remainder, column)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
