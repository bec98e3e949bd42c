"""Running totals, previous values and exact quantiles over groups of any size.

A window partitioned by a key sorts each group in one task, which fails when one key holds a large
share of all rows. Here the rows are range-partitioned on (keys, order) instead, so a big group is
cut into consecutive slices. Each slice is worked on alone and then shifted by a carry from the
slices before it; the carry table has one row per slice and key.

The sliced table is written to the shared folder: slice numbers come from the physical partition,
and reading them back from storage keeps them the same for every later use and every retry.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.scale import lookup_join, materialize

SLICE = "_slice"


def slice_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition on (keys, order), number the partitions, store the result.

    (keys, order) should be close to unique: equal values cannot be cut apart.
    """
    ranged = df.repartitionByRange(*keys, *order)
    return materialize(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")


def _within(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(SLICE, *keys).orderBy(*order)


def _across(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SLICE)


def add_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add to each row what the slices before hand over to its slice and key, NULL where there is nothing."""
    on = rows[SLICE] == carry[SLICE]
    for key in keys:
        on = on & rows[key].eqNullSafe(carry[key])
    carried = [c for c in carry.columns if c != SLICE and c not in keys]
    return rows.join(carry, on, "left").select(*[rows[c] for c in rows.columns], *[carry[c] for c in carried])


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, str]
) -> DataFrame:
    """Add inclusive running sums per key: ``totals`` maps new column -> summed column."""
    return _totals_of_slices(slice_by_range(df, keys, order), keys, order, totals)


def _totals_of_slices(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, str]
) -> DataFrame:
    sums = sliced.groupBy(SLICE, *keys).agg(*[F.sum(src).alias(f"_c_{new}") for new, src in totals.items()])
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(SLICE, *keys, *[F.sum(f"_c_{new}").over(before).alias(f"_c_{new}") for new in totals])
    upto = _within(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(src).over(upto).alias(f"_l_{new}") for new, src in totals.items()])
    both = add_carry(local, carry, keys)
    return both.select(
        *[c for c in sliced.columns if c != SLICE],
        *[(F.col(f"_l_{new}") + F.coalesce(F.col(f"_c_{new}"), F.lit(0))).alias(new) for new in totals],
    )


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Exact 1-based position of each row within its key; (keys, order) must be unique."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_totals(ones, keys, order, {name: "_one"}).drop("_one")


def with_previous(df: DataFrame, keys: Sequence[str], order: str, name: str, *, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Add the ``order`` value of the row before, per key (NULL for the first row)."""
    ordering = [order, *tiebreak]
    sliced = slice_by_range(df, keys, ordering)
    last = sliced.groupBy(SLICE, *keys).agg(F.max(order).alias("_last"))
    carry = last.select(SLICE, *keys, F.lag("_last").over(_across(keys)).alias("_carry"))
    local = sliced.withColumn("_local", F.lag(order).over(_within(keys, ordering)))
    both = add_carry(local, carry, keys)
    return both.select(*df.columns, F.coalesce("_local", "_carry").alias(name))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], *, weight: str | None = None
) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per key; ``probs`` maps output column -> share.

    Counts per distinct value are formed first (with map-side combining), then ranked in slices;
    only the one or two values next to each wanted rank are kept. ``weight`` names a column that
    says how often a row counts.
    """
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(times.alias("_n"))
    sliced = slice_by_range(counts, keys, [value])
    sizes = sliced.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    ranked = _totals_of_slices(sliced, keys, [value], {"_upto": "_n"})
    with_size = lookup_join(ranked, sizes, keys, spread=[value], how="inner", null_safe=True)
    picks: list[Column] = []
    for name, share in probs.items():
        low = F.floor((F.col("_size") - 1) * F.lit(share)) + 1
        high = F.least(low + 1, F.col("_size"))
        for part, rank in (("lo", low), ("hi", high)):
            holds = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
            picks.append(F.max(F.when(holds, F.col(value))).alias(f"_{part}_{name}"))
    found = with_size.groupBy(*keys).agg(F.max("_size").alias("_size"), *picks)
    out = []
    for name, share in probs.items():
        position = (F.col("_size") - 1) * F.lit(share)
        part = position - F.floor(position)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((low + (high - low) * part).cast("double").alias(name))
    return found.select(*keys, F.col("_size").alias("n_values"), *out)
