"""Pieces of a group packed into parts of bounded size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.operators.ordered import running_totals

#: Bytes of one part unless the caller says otherwise; far below what one value may hold.
PART_BYTES = 64 * 1024 * 1024


def pack(pieces: DataFrame, group: Sequence[str], order: Sequence[str], size: str, *, max_bytes: int = PART_BYTES) -> DataFrame:
    """Add ``part``: pieces of a group with the same part follow each other and hold ``max_bytes`` at most.

    A piece longer than that is alone in its part; nothing is dropped or cut. Parts rise in the order of
    the pieces, but numbers may be left out: a part ends where the running size of the group passes a
    multiple of ``max_bytes``, and the piece that passes it is a part of its own. So every part follows
    from a running total, which works on slices, and no task has to walk through a whole group.
    """
    if max_bytes < 1:
        raise ValueError("max_bytes must be positive")
    sized = pieces.withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("bigint"))
    placed = running_totals(sized, group, order, {"_end": "_size"})
    cell = F.floor((F.col("_end") - F.col("_size")) / F.lit(max_bytes))
    passes = F.col("_end") > (cell + 1) * F.lit(max_bytes)
    return placed.withColumn("part", (2 * cell + passes.cast("bigint")).cast("bigint")).drop("_size", "_end")
