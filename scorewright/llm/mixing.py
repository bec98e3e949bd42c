"""Sources mixed to target weights by capped water-filling.

All sources together give as many words as the corpus has. Each source's target is its share by
weight, but at most ``max_epochs`` times its own size; what is cut off is shared again by weight among
the sources below their caps, until none is above. Then every document of a source is repeated the
whole number of times that target / size holds, and a seeded part of the documents once more: those
that come first in the order of md5(seed:doc_id), up to the words still wanted. The order of a source
is cut where its running sum comes closest to the target, so a source misses its target by half a
document at most.

The running sum never sorts a source in one task: sizes are summed per source and hash bin first
(``BINS`` bins), the bins before the cut are taken whole, and only the documents of the one bin with
the cut are ordered, by a sum over slices in range partitions.

Rows: one output row per document row. A null text has size 0 and takes 0 words; a null source is a
source of its own, last in order; rows that share a doc_id are told apart by size, and equal rows are
interchangeable. An empty table gives no rows. A source without words has the target 0. Extra
columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import SPACES
from scorewright.operators.ordered import running_totals, with_rank
from scorewright.scale import lookup_join, materialize

MAX_EPOCHS = 3
BINS = 4096
SEED = 7
ADDED = ("source_size", "target", "repeats", "taken")
HELPERS = ("_order", "_bin", "_whole", "_want", "_cut", "_before", "_more", "_sum")


def size_of(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACES.replace("[", "[^", 1))), F.lit(0)).cast("bigint")


def ranked_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1 to ``cycle``, repeating, for sources in code-point order, null last."""
    keyed = sources.select("source", F.col("source").isNull().alias("_last"), F.coalesce("source", F.lit("")).alias("_key"))
    ranked = with_rank(keyed, [], ["_last", "_key"], "rank")
    return ranked.select("source", (F.pmod(F.col("rank") - 1, F.lit(cycle)) + 1).alias("weight"))


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Targets of sources (source, source_size, weight): adds ``target``.

    A round sums the sources that are still below their caps; it ends when no further one is above.
    The sums are one row each; rounds raise the level of the free sources, so a capped one stays so.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    capped, rest, weights = 0, total, None
    free = F.lit(True)
    while True:
        found = sources.agg(
            F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0)).alias("weight"),
            F.coalesce(F.sum(F.when(~free, cap)), F.lit(0)).alias("full"),
            F.count(F.when(~free, 1)).alias("n"),
        ).first()
        if weights is not None and found["n"] == capped:
            break
        capped, rest, weights = found["n"], total - found["full"], found["weight"]
        if not weights:
            break
        share = F.lit(rest) * F.col("weight") / F.lit(weights)
        free = share <= cap
    if not weights:
        return sources.withColumn("target", cap.cast("double"))
    share = F.lit(rest) * F.col("weight") / F.lit(weights)
    return sources.withColumn("target", F.least(cap.cast("double"), share))


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, *, max_epochs: int = MAX_EPOCHS, seed: int = SEED
) -> DataFrame:
    """``docs`` with size, source_size, target (of its source), repeats and taken (repeats * size).

    ``docs`` has doc_id, source and size. ``weights`` (source, weight) must name every source once;
    without it the weights are those of ``ranked_weights``. Columns of ``docs`` named like added ones are
    replaced, those named like ``HELPERS`` go.
    """
    docs = docs.drop(*ADDED, *HELPERS)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_order")
    rows = materialize(docs.select("*", key), "sized")
    rows = rows.withColumn("_bin", F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    bins = materialize(rows.groupBy("source", "_bin").agg(F.sum("size").alias("_size")), "bins")
    sources = materialize(bins.groupBy("source").agg(F.sum("_size").alias("source_size")), "sources")
    weights = ranked_weights(sources) if weights is None else weights
    weighed = materialize(lookup_join(sources, weights, ["source"], spread=["source_size"], how="inner", null_safe=True), "weighed")
    targets = materialize(water_fill(weighed, max_epochs).drop("weight"), "targets")

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = targets.withColumn("_whole", whole.cast("bigint"))
    plan = materialize(plan.withColumn("_want", F.col("target") - F.col("_whole") * F.col("source_size")), "plan")

    upto = running_totals(bins, ["source"], ["_bin"], {"_upto": "_size"})
    cut = upto.join(plan, upto["source"].eqNullSafe(plan["source"])).where("_upto > _want").groupBy(upto["source"]).agg(
        F.min(F.struct("_bin", (F.col("_upto") - F.col("_size")).alias("before"))).alias("cut")
    )
    cuts = plan.join(cut, plan["source"].eqNullSafe(cut["source"]), "left").select(
        plan["source"], "source_size", "target", "_whole", "_want",
        F.coalesce(F.col("cut._bin"), F.lit(BINS)).alias("_cut"), F.coalesce("cut.before", F.lit(0)).alias("_before"),
    )
    known = lookup_join(rows, cuts, ["source"], spread=["_order"], how="inner", null_safe=True)
    known = materialize(known, "known")
    plain = known.where("_bin <> _cut").withColumn("_more", (F.col("_bin") < F.col("_cut")).cast("bigint"))
    edge = running_totals(known.where("_bin = _cut"), ["source"], ["_order", "doc_id", "size"], {"_sum": "size"})
    # Taken when the sum with this document is nearer to the wish than the sum without it.
    middle = F.col("_before") + F.col("_sum") - F.col("size") / 2
    edge = edge.withColumn("_more", ((F.col("_want") > 0) & (middle <= F.col("_want"))).cast("bigint")).drop("_sum")
    both = plain.unionByName(edge)
    repeats = F.col("_whole") + F.col("_more")
    return both.select(
        *docs.columns, "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).alias("taken")
    )
