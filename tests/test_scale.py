"""Ordered operators and lookup joins, also with one key that holds most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scorewright import scale
from scorewright.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows, two thirds of them under one key, some under a NULL key, with equal values."""
    chance = random.Random(7)
    rows = []
    for i in range(3_000):
        key = "hot" if i % 3 else (None if i % 30 == 0 else f"k{i % 7}")
        rows.append((i, key, chance.randrange(400), chance.randrange(100)))
    return spark.createDataFrame(rows, "id BIGINT, k STRING, at BIGINT, v BIGINT").repartition(8).cache()


@pytest.fixture(autouse=True)
def many_slices(spark):
    """Keep Spark from merging these few rows into one partition, so that there are carries."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_slices_cut_the_hot_key(skewed):
    sliced = ordered.slice_by_range(skewed, ["k"], ["at", "id"])
    spans = sliced.where("k = 'hot'").groupBy("_slice").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).orderBy("_slice")
    found = spans.collect()
    assert len(found) >= 4
    assert all(a["hi"] <= b["lo"] for a, b in zip(found, found[1:]))


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_totals(skewed, keys):
    got = ordered.running_totals(skewed, keys, ["at", "id"], {"upto": "v"})
    upto = Window.partitionBy(*keys).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    assert same(got, skewed.withColumn("upto", F.sum("v").over(upto)))


def test_rank(skewed):
    got = ordered.with_rank(skewed, ["k"], ["at", "id"], "n")
    want = skewed.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("at", "id")).cast("bigint"))
    assert same(got, want)


def test_previous(skewed):
    got = ordered.with_previous(skewed, ["k"], "at", "before", tiebreak=["id"])
    want = skewed.withColumn("before", F.lag("at").over(Window.partitionBy("k").orderBy("at", "id")))
    assert same(got, want)


def test_quantiles(skewed):
    got = ordered.exact_quantiles(skewed, ["k"], "v", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0})
    want = skewed.groupBy("k").agg(
        F.count("v").alias("n"), *[F.percentile("v", p).alias(n) for n, p in zip("abcd", (0.5, 0.95, 0.0, 1.0))]
    )
    found = {r["k"]: r for r in got.collect()}
    for row in want.collect():
        assert found[row["k"]]["n_values"] == row["n"]
        for name in "abcd":
            assert found[row["k"]][name] == pytest.approx(row[name])


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_lookup_join_ways_agree(spark, skewed, how, null_safe):
    table = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "k STRING, x INT")
    small = scale.lookup_join(skewed, table, ["k"], spread=["id"], how=how, null_safe=null_safe)
    large = scale.lookup_join(
        skewed, table, ["k"], spread=["id"], how=how, null_safe=null_safe, may_broadcast=False
    )
    assert small.columns == large.columns
    assert same(small, large)
    on = skewed["k"].eqNullSafe(table["k"]) if null_safe else skewed["k"] == table["k"]
    assert large.count() == skewed.join(table, on, how).count()


def test_broadcast_bound(spark, monkeypatch):
    stored = scale.materialize(spark.range(100), "t")
    assert scale.fits_broadcast(stored)
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 99)
    assert not scale.fits_broadcast(stored)
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 1000)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 10)
    assert not scale.fits_broadcast(stored)


def test_broadcast_bound_counts_repeated_values(spark, monkeypatch):
    wide = spark.range(100).select("id", F.repeat(F.lit("x"), F.lit(10_000)).alias("s"), F.array(F.lit("y" * 100)).alias("a"))
    stored = scale.materialize(wide, "wide")
    assert scale.fits_broadcast(stored)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 1_000_000)
    assert not scale.fits_broadcast(stored)
    assert scale.fits_broadcast(scale.materialize(wide.limit(0), "none"))


def test_literal_table_is_bounded(spark):
    with pytest.raises(ValueError):
        scale.literal_table(spark, [(i,) for i in range(scale.LITERAL_ROWS + 1)], "a INT")


def test_scratch_lies_in_the_named_folder(spark):
    assert scale.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
